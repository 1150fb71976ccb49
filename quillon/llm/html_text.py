"""HTML extraction by tree scoring: paragraphs pass points upwards, link density discounts, the best container wins."""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

# Element names of HTML by their role in parsing and layout.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "figcaption", "summary"}
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}, "thead": {"tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "thead": {"table"}, "option": {"select"}, "p": {"td", "th", "button", "object", "article", "section", "div", "li", "blockquote", "main", "body", "aside", "nav", "footer", "header", "form", "dd", "dt", "figure"}}
# Elements, roles and class words that never hold article text.
DROP = frozenset("script style noscript iframe template head title nav footer aside button input select textarea svg canvas object embed video audio dialog menu map math".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar tablist".split())
DROP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner breadcrumb breadcrumbs comment comments disqus respond replies responses cookie cookies consent gdpr notice notification alert footer header masthead hidden login signin signup menu menus nav navbar navigation newsletter subscribe subscription pager pagination paging popup modal overlay related recommended recommendations share sharing social sidebar sidebars side skip subscribe tags toolbar widget widgets".split()
)
READERS = frozenset("comment comments disqus respond replies responses".split())
POSITIVE = frozenset("article articles body content entry hentry main page post story text blog".split())

_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTRS = re.compile(r"((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_COMMENT = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z][^>]*(?:>|\Z)", re.S)
_WORDS = re.compile(r"[a-z]+")
_STATE = re.compile(r"(?:has|no|with|without|is)-|.*-(?:enabled|disabled|active|visible)$")
_WHITE = re.compile(r"\s+")


class Node:
    """An element; children are nodes and decoded texts."""

    __slots__ = ("attrs", "children", "name", "parent", "score", "length", "link")

    def __init__(self, name: str, attrs: str, parent: Node | None) -> None:
        self.name, self.attrs, self.parent = name, attrs, parent
        self.children: list = []
        self.score = 0.0
        self.length = self.link = 0

    def attr(self, *names: str) -> str:
        return " ".join(a or b or c for k, a, b, c in _ATTR.findall(self.attrs) if k.lower() in names) if self.attrs else ""


def parse(source: str) -> Node:
    """A tree of the page: void elements, raw text, implied ends and unclosed tags as browsers read them."""
    root = Node("html", "", None)
    stack, opened, i, n = [root], Counter(), 0, len(source)

    def text(s: str) -> None:
        if s:
            stack[-1].children.append(html.unescape(s) if "&" in s else s)

    def close(size: int) -> None:
        while len(stack) > size:
            opened[stack.pop().name] -= 1

    def place_of(names, stops=()) -> int:
        """Place in the stack of the outermost open element so named, above the innermost of `stops`; 0 if none is open."""
        found = 0
        if any(opened[x] for x in names):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in names:
                    found = k
                    if not stops:
                        break
                elif stack[k].name in stops:
                    break
        return found

    while i < n:
        j = source.find("<", i)
        if j < 0:
            text(source[i:])
            break
        if j > i:
            text(source[i:j])
        if (m := _COMMENT.match(source, j)) is not None:
            i = m.end()
            continue
        if (m := _OPEN.match(source, j)) is None:
            text("<")
            i = j + 1
            continue
        if (end := source.find(">", m.end())) < 0:  # no tag ends any more
            text(source[j:])
            break
        name, attrs, i = m[2].lower(), source[m.end() : end], end + 1
        if ('"' in attrs or "'" in attrs) and (whole := _ATTRS.match(source, m.end())) is not None:
            attrs, i = whole[1], whole.end()
        if m[1]:
            if k := place_of((name,)):
                close(k)
            continue
        if name == "html" or name == "body":
            root.attrs = root.attrs or attrs
            continue
        closes = ("p",) if name in CLOSES_P else IMPLIED.get(name, ())
        if closes and (k := place_of(closes, SCOPE.get(name if name in SCOPE else "p", ()))):
            close(k)
        new = Node(name, attrs, stack[-1])
        stack[-1].children.append(new)
        if name in RAW:
            end = _RAW_END[name].search(source, i)
            if end is None:
                i = n
            else:
                stop = source.find(">", end.end())
                i = n if stop < 0 else stop + 1
        elif name not in VOID and not attrs.endswith("/"):
            stack.append(new)
            opened[name] += 1
    return root


def words_of(node: Node) -> set[str]:
    """Words of an element's classes and id, less those that only say what a layout has or lacks (has-sidebar, no-comments)."""
    names = [x for x in node.attr("class", "id").lower().split() if not _STATE.match(x)]
    return set(_WORDS.findall(" ".join(names)))


def unwanted(node: Node) -> int:
    """2 if an element never holds article text, 1 if it looks like furniture, 0 if neither."""
    if node.name in DROP:
        return 2
    if node.name == "header":
        up = node.parent
        while up is not None and up.name not in ("article", "main"):
            up = up.parent
        if up is None:
            return 2
    if node.name == "form":
        return 1
    if not node.attrs:
        return 0
    low = node.attrs.lower()
    if re.search(r"(^|\s)hidden(\s|=|$)", low) or "display:none" in low.replace(" ", "") or 'aria-hidden="true"' in low:
        return 2
    if "class" in low or "id" in low:
        words = words_of(node)
        own = node.name in ("article", "main") or words & {"article", "main", "post", "entry", "story"} and not words & {"comment", "comments", "sidebar", "related", "ad", "ads", "nav", "footer", "share"}
        if not own and words & DROP_WORDS:
            return 2 if words & READERS else 1
    return int("role" in low and node.attr("role").lower().strip() in DROP_ROLES)


def prune(root: Node) -> None:
    """Take unwanted elements out; one that only looks like furniture stays if it holds most of the page's text outside links and every marked article."""
    doubt, todo = [], [root]
    while todo:
        node = todo.pop()
        kept = []
        for c in node.children:
            if isinstance(c, str):
                kept.append(c)
            elif (verdict := unwanted(c)) < 2:
                kept.append(c)
                todo.append(c)
                if verdict:
                    doubt.append(c)
        node.children = kept
    if not doubt:
        return
    free: dict[int, int] = {}
    for node in post_order(root):
        free[id(node)] = 0 if node.name == "a" else sum(len(c.strip()) if isinstance(c, str) else free[id(c)] for c in node.children)
    nodes = post_order(root)
    marked = sum(x.name in ("article", "main") and free[id(x)] > 0 for x in nodes)
    inside: dict[int, int] = {}
    for node in nodes:
        inside[id(node)] = (node.name in ("article", "main") and free[id(node)] > 0) + sum(inside[id(c)] for c in node.children if not isinstance(c, str))
    # An article marked as such elsewhere on the page decides: however short, it is not the furniture.
    gone = {id(x) for x in doubt if 2 * free[id(x)] <= free[id(root)] or inside[id(x)] < marked}
    for parent in {id(x.parent): x.parent for x in doubt}.values():
        parent.children = [c for c in parent.children if isinstance(c, str) or id(c) not in gone]


def post_order(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [c for c in node.children if not isinstance(c, str)]
    return out[::-1]


def score(root: Node) -> list[Node]:
    """Points of every container: from each paragraph by length and commas, fading upwards, less link density."""
    nodes = post_order(root)
    for node in nodes:
        for c in node.children:
            if isinstance(c, str):
                node.length += len(c.strip())
            else:
                node.length += c.length
                node.link += c.length if c.name == "a" else c.link
    touched: dict[int, Node] = {}
    rising: dict[int, float] = {}  # points that reach an element; half of them go on to the next one up
    for node in nodes:
        direct = [c for c in node.children if isinstance(c, str) or c.name not in BLOCK]
        size = sum(len(c.strip()) if isinstance(c, str) else c.length for c in direct)
        if size >= 25 and node is not root and node.name in BLOCK:
            commas = sum(c.count(",") if isinstance(c, str) else sum(t.count(",") for k in post_order(c) for t in k.children if isinstance(t, str)) for c in direct)
            up = node.parent if node.name in ("p", "pre", "li", "td", "dd", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote") else node
            rising[id(up)] = rising.get(id(up), 0.0) + 1 + commas + min(size / 100, 3)
        if points := rising.get(id(node), 0.0):
            node.score += points
            touched[id(node)] = node
            if node.parent is not None:
                rising[id(node.parent)] = rising.get(id(node.parent), 0.0) + points / 2
    for node in touched.values():
        words = set(_WORDS.findall(node.attr("class", "id", "itemprop", "role").lower())) if node.attrs else ()
        node.score += 25 * (node.name == "article" or bool(POSITIVE.intersection(words))) + 15 * (node.name == "main")
        node.score *= 1 - node.link / max(1, node.length)
    return list(touched.values())


def best_parts(root: Node) -> list[Node]:
    """The best container and those of its siblings that belong to it, in page order."""
    found = score(root)
    if not found:
        articles = [x for x in post_order(root)[::-1] if x.name in ("article", "main") and x.length]
        return [max(articles, key=lambda x: x.length)] if articles else [root]
    best = max(found, key=lambda x: x.score)
    up = best
    while up is not None:  # a section of an article stands for the whole article
        if up.name == "article" or up.name == "main" and best.name != "article":
            best = up
            break
        up = up.parent
    if best.parent is None or best.name == "article":
        others = [x for x in best.parent.children if not isinstance(x, str) and x is not best] if best.parent is not None else []
        if not any(x.name == "article" for x in others):
            return [best]
    limit = max(10, best.score * 0.2)
    kept = []
    for x in best.parent.children:
        if isinstance(x, str):
            continue
        same = x.attrs and best.attrs and x.attr("class") and x.attr("class") == best.attr("class")
        sparse = x.link / max(1, x.length) < 0.25
        if x is best or x.score + (best.score * 0.2 if same else 0) >= limit or (x.name == "p" and x.length > 80 and sparse) or (x.name in ("h1", "h2") and x.length and sparse and best.name not in ("body", "html")):
            kept.append(x)
    return kept


def text_blocks(parts: list[Node]) -> list[str]:
    """Texts of the blocks in page order, white space collapsed."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if s := _WHITE.sub(" ", "".join(run)).strip():
            out.append(s)
        run.clear()

    for part in parts:
        todo: list = [part]
        while todo:
            x = todo.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                run.append(x)
            else:
                if x.name in BLOCK:
                    flush()
                    todo.append(None)
                elif x.name in ("br", "img"):
                    run.append(" ")
                todo += x.children[::-1]
        flush()
    return out


def extract(source: str | None) -> str:
    """Main text of a page, its blocks joined by newlines; empty for a null or empty page."""
    if not source:
        return ""
    root = parse(source)
    prune(root)
    return "\n".join(text_blocks(best_parts(root)))


def _run(batches):
    for batch in batches:
        texts = [extract(x) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"]
        )


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (id_col, url_col, text, n_chars) with the main text of every whole page.

    Null, empty and text-free pages have the empty text. Of two containers with equal points the first in
    parsing order wins. Repeated rows, null ids and null addresses pass through; further columns are ignored.
    """
    small_batches(pages.sparkSession)
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind, address = base.schema["id"].dataType.simpleString(), base.schema["url"].dataType.simpleString()
    return base.mapInArrow(_run, f"id {kind}, url {address}, text string, n_chars long").toDF(id_col, url_col, "text", "n_chars")


def op7_html_text(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
