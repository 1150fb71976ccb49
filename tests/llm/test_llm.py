"""Each operator against brute force or its library, and on nulls, empty tables, repeats and clashing columns."""

import gzip
import hashlib
import html
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillon.llm import bpe, decontaminate, html_text, jaccard_join, language_id, license_scan, line_dedup, quality_rules, registry, token_counts, warc
from quillon.llm.common import connected_components

VOCAB = "/opt/tokenizers/word_bpe_49k.json"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", " ", None, "a", "A b\tc\x0bd", "x " * 5000, "naïve café Ünïté", "\x00\x85\x1c", "<|endoftext|> it's 12 ½", "a\nb\n\na"]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def frame(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)


def clashing(df):
    """The same rows with further columns named as the operators' own."""
    for c in ("id", "key", "fp", "sigs", "region", "line", "pos", "words", "term", "score", "host", "url", "n_tokens", "_key", "root"):
        df = df.withColumn(c, F.lit("x"))
    return df


# --- Jaccard join ---


def brute_components(rows, width=4, num=85, den=100):
    sets = {}
    for i, t in rows:
        low = "".join(c.lower() if c.isascii() else c for c in t or "")
        ws = [w for w in re.split(r"[\x20\x09-\x0d]+", low) if w]
        sets[i] = {tuple(ws[k : k + width]) for k in range(len(ws) - width + 1)} if len(ws) >= width else ({tuple(ws)} if ws else set())
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    common = Counter(p for ids in where.values() for p in itertools.combinations(sorted(ids), 2))
    for (a, b), n in common.items():
        if den * n >= num * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def noisy(seed, groups=12, size=14, words=60):
    rnd, out = random.Random(seed), []
    passage = [f"p{i}" for i in range(30)]
    for g in range(groups):
        n = rnd.choice([4, 5, 8, words, words * 2])
        base = [f"{rnd.choice('abcdef')}{rnd.randint(0, 99)}" for _ in range(n)]
        for _ in range(rnd.randint(1, size)):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, n // 25))):
                w[rnd.randrange(len(w))] = f"z{rnd.randint(0, 9)}"
            out.append(" ".join(passage + w if g % 3 == 0 else w))
    return out


@pytest.mark.parametrize("seed,limit", [(1, 4_000_000), (2, 400), (3, 60)])
def test_jaccard_equals_brute_force(spark, seed, limit):
    texts = noisy(seed) + ["", None, " ", "one", "One", "a b c d", "A b c\td"]
    want = brute_components(list(enumerate(texts)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(clashing(frame(spark, texts)), region_limit=limit).collect()}
    assert got == want


def test_region_links_equal_all_pairs():
    rnd = np.random.default_rng(5)
    base = [np.unique(rnd.integers(0, 10**9, rnd.integers(20, 80)).astype(np.uint64)) for _ in range(6)]
    sets = []
    for b in base:
        for _ in range(30):
            keep = b[rnd.random(len(b)) > rnd.choice([0.0, 0.03, 0.08, 0.15])]
            sets.append(np.unique(np.concatenate((keep, rnd.integers(0, 10**9, rnd.integers(0, 4)).astype(np.uint64)))))
    links = jaccard_join.Links(len(sets))
    for i, j in itertools.combinations(range(len(sets)), 2):
        if jaccard_join.near(sets[i], sets[j], 85, 100):
            links.join(i, j)
    assert jaccard_join.region_links(sets, 85, 100) == [links.find(i) for i in range(len(sets))]


def test_jaccard_edges_of_the_contract(spark):
    assert jaccard_join.jaccard_components(frame(spark, [])).count() == 0
    rows = spark.createDataFrame([(3, "a b c d e"), (3, "a b c d e"), (None, "a b c d e"), (1, "A B C D E"), (None, "other words")], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in jaccard_join.jaccard_components(rows).collect())
    assert got == [("1", "1"), ("3", "1"), ("3", "1"), ("None", "1"), ("None", "None")]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (200, 205), (205, 203), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 200: 200, 205: 200, 203: 200}


# --- BPE ---


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCAB)


def wild(n=400, seed=3):
    rnd, al = random.Random(seed), "aabbcdeehiinnoorstt'é ñ1.!<|endoftext|>sΣİς" + "ﬁ½٣कि́\x85\x1c​\x00😀A"
    return ["".join(rnd.choice(al) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


def test_bpe_equals_the_library(spark, docs, library):
    texts = [t for t in ODD] + wild() + ["<|startoftext|>a<|endoftext|>", "a" * 3000]
    df = docs.select("doc_id", "text").union(frame(spark, texts, 10**6).select("doc_id", "text"))
    rows = {r.doc_id: r.text or "" for r in df.collect()}
    got = {r.doc_id: r for r in bpe.bpe_encode(clashing(df), VOCAB).collect()}
    digests = {r.doc_id: r for r in bpe.bpe_encode(df, VOCAB, digests=True).collect()}
    assert len(got) == len(rows)
    for i, t in rows.items():
        want = library.encode(t, add_special_tokens=False).ids
        text = library.decode(want, skip_special_tokens=False)
        assert (got[i].ids, got[i].n_tokens, got[i].decoded) == (want, len(want), text)
        assert digests[i].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_every_code_point_is_split_and_folded_like_the_library(library):
    texts = [f"a{c}b {c}" for c in map(chr, (*range(1, 0xD800), *range(0xE000, 0x33480), *range(0xE0000, 0xE0200)))]
    got, counter = bpe.Encoder(VOCAB).encode(texts), token_counts.Counter(VOCAB)
    for t, ids, want in zip(texts, got, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids and counter.table(t)[-1] == len(want.ids), hex(ord(t[1]))


def test_speculation_is_verified():
    v = bpe.Vocabulary(VOCAB)
    words = ["unbelievable", "thethethe", "aaaaaaa", "zzxqj", "international"]
    assert v.encode_words(words) == [v.merge(w) for w in words]
    assert any(v.speculate(w) != v.merge(w) for w in words + ["hyperparameterization", "retionshanded"])


# --- token counts ---


def test_every_prefix_is_counted(library):
    counter = token_counts.Counter(VOCAB)
    for t in [x for x in ODD if x and len(x) < 200] + wild(150, 4) + ["it's we'LL don't", "-x -\n--y \n-", " \n x  ", "a" * 200]:
        want = [len(e.ids) for e in library.encode_batch([t[:k] for k in range(len(t) + 1)], add_special_tokens=False)]
        assert counter.table(t).tolist() == want, repr(t)


def test_prefixes_of_long_chunks(library):
    """Chunks that hold quotes, special strings and joining letters: every prefix equals the library, in linear time."""
    rnd, counter = random.Random(8), token_counts.Counter(VOCAB)
    chunks = ["".join(rnd.choice(al) for _ in range(700)) for al in ("abst'", "abc9'/+=", "'", "re'vl's<|", "กิดีอุ'า", "e\u0301a'o\u0308x", "a<|endoftext|>'s", "ㅎㅏㄴ\u1100\u1161\u11a8'", "İıΣς'S")]
    chunks += ["x'" + "<|endoftext|>" * 20 + "!<|endoftext|>?'re<|startoftext|>'ll9'd'", "'" + "a" * 300, "'re" * 200, "!'s!!'t''ve"]
    for t in chunks:
        want = [len(e.ids) for e in library.encode_batch([t[:k] for k in range(len(t) + 1)], add_special_tokens=False)]
        assert counter.table(t).tolist() == want, repr(t[:60])
    began = time.time()
    for t in ("it's" * 25_000, "กิดี'" * 20_000, "'" * 100_000, "abc9/'" * 16_000):
        counter.table(t)
    assert time.time() - began < 20


def test_totals_are_those_of_the_tables_without_making_them(library, monkeypatch):
    """Totals and longest prefixes equal the tables'; a table is made only for the piece in which the budget runs out."""
    counter, made = token_counts.Counter(VOCAB), []
    texts = [x for x in ODD if x] + wild(150, 4) + ["it's we'LL don't", " \n x  ", "a" * 200, "x'" + "<|endoftext|>" * 20 + "?'re'll9'd'", "กิดีอุ'า e\u0301a'o"]
    texts += [f"a{c}b {c}" for c in map(chr, (*range(1, 0x3000), *range(0xA000, 0xB000), *range(0x1E900, 0x1E980)))]
    wants = library.encode_batch(texts, add_special_tokens=False)
    for t, want in zip(texts, wants, strict=True):
        table, n = counter.table(t), len(want.ids)
        for budget in (-1, 0, 1, n // 2, n - 1, n, 2048):
            assert counter.count(t, budget) == (n, token_counts.longest_prefix(table, budget)), (t[:60], budget)
    fresh, piece = token_counts.Counter(VOCAB), token_counts.Counter.piece
    monkeypatch.setattr(token_counts.Counter, "piece", lambda self, p: made.append(p) or piece(self, p))
    text = "one twoish it's <|endoftext|> five " * 20
    run = token_counts._count(VOCAB, 50, False, bpe.differences())
    monkeypatch.setattr(token_counts, "_counter", lambda path, differs: fresh)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["one two it's", text])], names=["id", "text"])
    out = next(run([batch]))
    assert out.column("n_tokens").to_pylist() == [len(library.encode(t, add_special_tokens=False).ids) for t in ("one two it's", text)]
    assert len(made) == 1
    monkeypatch.undo()
    assert token_counts._counter(VOCAB, bpe.differences()) is token_counts._counter(VOCAB, bpe.differences())


def test_counts_and_budgets(spark, docs, library):
    df = docs.select("doc_id", "text").union(frame(spark, ODD, 10**6).select("doc_id", "text"))
    out = token_counts.token_counts(clashing(df), VOCAB, budget=50, with_table=True)
    rows = {r.doc_id: r.text or "" for r in df.collect()}
    for r in out.collect():
        t = rows[r.doc_id]
        assert (r.n_bytes, r.n_tokens) == (len(t.encode()), len(library.encode(t, add_special_tokens=False).ids))
        assert len(library.encode(t[: r.fit_chars], add_special_tokens=False).ids) <= 50
    cut = token_counts.truncate(out.join(df, "doc_id"), 20)
    assert all(len(library.encode(r.text, add_special_tokens=False).ids) <= 20 for r in cut.limit(50).collect())
    assert token_counts.token_counts(frame(spark, []), VOCAB).count() == 0


# --- language ID ---


def test_language_accuracy_on_held_out_rows(spark, sf, docs):
    got = registry.queries()["op3_language_id"](spark, sf).join(docs.select("doc_id", F.col("lang").alias("truth")), "doc_id").collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.truth for r in held) / len(held) > 0.97


def test_mixtures_and_undetermined(spark, docs):
    model = language_id.fit(docs)
    by = {r.lang: r.text for r in docs.where("length(text) > 2000").collect()}
    mixed = by["en"][:1500] + "\n" + by["fr"][:1500]
    rows = {r.doc_id: r for r in language_id.predict(clashing(frame(spark, [mixed, None, "12 34 !?", "", by["de"] * 20])), model).collect()}
    assert set(rows[0].shares) >= {"en", "fr"} and 0.3 < rows[0].shares["en"] < 0.7
    assert [rows[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and rows[1].score == 0 and rows[4].lang_pred == "de"
    assert [r.doc_id for r in language_id.with_language(frame(spark, [mixed, None, "12"]), model).collect()] == [0]
    none = language_id.fit(docs.where("false"))
    assert language_id.predict(frame(spark, ["words"]), none).first().lang_pred == "und"


def test_em_equals_a_plain_loop():
    rnd = np.random.default_rng(0)
    ll = rnd.normal(-5, 2, (40, 3))
    owner = np.repeat([0, 1], 20)
    shares, n = language_id.mixtures(ll.astype(np.float32), owner, 2)
    for d in range(2):
        x = ll[owner == d].astype(np.float32).astype(float)
        best = None

        def climb(p, x=x):
            for _ in range(language_id.STEPS):
                w = np.exp(x) * p
                p = (w / w.sum(1, keepdims=True)).mean(0)
            return p, np.log((np.exp(x) * p).sum(1)).sum()

        full, _ = climb(np.full(3, 1 / 3))
        order = np.argsort(-full, kind="stable")
        for k in (1, 2, 3):
            if k > 1 and np.sort(full)[::-1][k - 1] * 20 < 1:
                continue
            if k == 1:
                j = x.sum(0).argmax()
                p, fit = np.eye(3)[j], x[:, j].sum()
            else:
                start = np.where(np.isin(np.arange(3), order[:k]), np.maximum(full, 1e-6), 0)
                p, fit = climb(start / start.sum())
            s = fit - 0.5 * (k - 1) * math.log(20)
            best = (s, k, p) if best is None or s > best[0] else best
        assert n[d] == best[1] and np.allclose(shares[d], best[2], atol=1e-4)


# --- decontamination ---


def test_planted_items_are_found_and_nothing_else(spark, sf, docs):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    bench = {r.item_id: r.text for r in items.collect()}
    have = {(r.doc_id, k) for r in docs.collect() for k, t in bench.items() if t in (r.text or "")}
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminations(clashing(docs), items).collect()}
    assert have <= got and len(got - have) <= 1
    filler = " ".join(f"w{i}" for i in range(300))
    edited = bench[0].split()
    edited[3] = "changed"
    rows = frame(spark, [f"{filler} {bench[0].upper()} {filler}", filler + " " + " ".join(edited), filler, None, "", "!!! ...", " ".join(bench[0].split()[:6])])
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminations(rows, items).collect()} == {(0, 0), (1, 0)}
    kept = decontaminate.without_contaminated(rows, items)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5, 6] and kept.schema == rows.schema
    sharded = decontaminate.contaminations(docs, items, items_at_once=7)
    assert {(r.doc_id, r.item_id) for r in sharded.collect()} == got
    assert decontaminate.contaminations(docs, items.where("false")).count() == 0


def test_pruning_loses_no_piece(spark, sf, docs):
    rows = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    ix = decontaminate.Index([r.item_id for r in rows], [r.text for r in rows])
    texts = [r.text for r in docs.limit(30).collect()] + [r.text for r in rows[:5]]
    for w in decontaminate._words(texts):
        for a in range(0, max(1, len(w)), 64):
            t = np.unique(ix.terms(w[a : a + 128]))
            t = t[t < len(ix.vocab)]
            score = np.zeros(ix.n)
            for x in t:
                p = slice(ix.post_at[x], ix.post_at[x + 1])
                score[ix.post_piece[p]] += ix.post_share[p]
            bound = ix.bounds[t].sum(0)
            assert all(score[j] <= bound[j // decontaminate.BLOCK] + 1e-6 for j in range(ix.n))
            live = (bound >= 0.3)[None, :]
            _, piece, _ = ix.search(np.zeros(len(t), np.int64), t, live, 0.3) if len(t) else ((), np.zeros(0), ())
            assert set(np.asarray(piece).tolist()) == set(np.flatnonzero(score >= 0.3 - 1e-9).tolist())


# --- HTML ---


def test_articles_of_pages(spark, sf):
    for r in registry.queries()["op7_html_text"](spark, sf).join(spark.read.parquet(f"{sf}/pages.parquet").drop("url"), "page_id").collect():
        body = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


PAGE = """<html><body><header><h1>Site</h1></header><div id=wrap><div class="menu-top"><a href=x>Home</a></div><div class="post-content"><h2>Title</h2>
<p>Some text, with commas, that is long enough to count as a paragraph of the article.<p>Second &amp; last,  with <b>bold</b> words and an <a href=1>inline link</a> in it, long enough.
<ul><li>one<li>two</ul><script>var x = "<p>no</p>";</script><form><input>Search</form></div><div class="sidebar"><p>Side words, commas, more, and more, and more and more words here.</p></div>
<div id="comments"><p>A comment, very long, with commas, that, should, go, away, entirely.</p></div><div class="cookie-notice">We use cookies, yes.</div></div><footer>foot</footer>"""


def test_furniture_goes():
    assert html_text.extract(PAGE).split("\n") == ["Title", "Some text, with commas, that is long enough to count as a paragraph of the article.", "Second & last, with bold words and an inline link in it, long enough.", "one", "two"]


@pytest.mark.parametrize("source,want", [(None, ""), ("", ""), ("plain &lt;x&gt; &#8212; text", "plain <x> — text"), ("<p>a<br>b</p>", "a b"), ("<script>x</script>", ""), ("<a href='x", "<a href='x"), ("<!-- no --><p>yes</p>", "yes"), ("<div>" * 2000 + "deep", "deep")])
def test_odd_pages(source, want):
    assert html_text.extract(source) == want


BODY = "".join(f"<p>Paragraph {i} of the article, with words, commas, and enough length to count as text.</p>" for i in range(5))
WANT = "\n".join(f"Paragraph {i} of the article, with words, commas, and enough length to count as text." for i in range(5))


@pytest.mark.parametrize(
    "outer",
    ["<form id='aspnetForm'>%s</form>", "<div class='content has-sidebar'>%s</div>", "<div class='layout no-comments'>%s</div>", "<div class='post share-enabled'>%s</div>", "<div class='public-notice'>%s</div>"],
)
def test_the_article_stays_whatever_holds_it(outer):
    menu = "<nav><a href=1>Home</a></nav><div class='sidebar'><p>Side words, commas, and more and more words here.</p></div>"
    assert html_text.extract(f"<html><body>{menu}{outer % BODY}<footer>foot</footer></body></html>") == WANT


def test_reader_comments_go():
    said = "".join("<p>A reader says, at length, that this is so, and more, and more of it.</p>" for _ in range(9))
    for name in ("reader-responses", "comments", "comment-list"):
        assert html_text.extract(f"<body><article>{BODY}<div class='{name}'>{said}</div></article></body>") == WANT


@pytest.mark.parametrize("source", ["<a " * 300_000, "<b>" * 40_000 + "</i>" * 40_000, "<a \"" * 100_001 + ">", "<p>" * 40_000, "<div><b>" * 20_000, "<!-- " * 100_000])
def test_parsing_is_linear(source):
    began = time.time()
    html_text.extract(source)
    assert time.time() - began < 5


def test_nested_lists_keep_their_order():
    assert html_text.extract("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>").split("\n") == ["a", "b", "c", "d"]


def test_html_frame(spark):
    df = spark.createDataFrame([(1, None, None), (1, None, None), (None, "u", "<p>x</p>")], "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("id", F.lit(2))
    assert sorted((str(r.page_id), r.text) for r in html_text.main_text(df).collect()) == [("1", ""), ("1", ""), ("None", "x")]
    assert html_text.main_text(df.limit(0)).count() == 0


# --- WARC ---


def test_records_link_and_round_trip(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    responses = warc.responses_of_pages(pages)
    rows = warc.derivatives(responses).collect()
    source = {r.record_id: r for r in responses.collect()}
    assert len(rows) == 2 * len(source) and Counter(r.record_type for r in rows) == {"metadata": len(source), "conversion": len(source)}
    for r in rows:
        s = source[r.refers_to]
        assert r.target_uri == s.target_uri and r.headers["WARC-Refers-To"] == s.record_id and r.headers["WARC-Source-Payload-Digest"] == warc.digest(bytes(s.block).partition(b"\r\n\r\n")[2])
        assert r.block_digest == warc.digest(bytes(r.block)) and r.content_length == len(r.block)
        if r.record_type == "metadata":
            assert b"source-http-content-type: text/html; charset=utf-8" in bytes(r.block) and warc.digest(bytes(s.block)).encode() in bytes(r.block)
    data = b"".join(warc.serialise(r.headers, bytes(r.block)) for r in rows)
    assert [(h["WARC-Record-ID"], b) for h, b in warc.parse_records(gzip.compress(data))] == [(r.record_id, bytes(r.block)) for r in rows]
    assert len({r.record_id for r in rows}) == len(rows)


def test_warc_files_and_odd_responses(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\n\r\n<title>t</title><p>caf\xe9 &amp; x</p><script>no</script>"
    head = {"WARC-Type": "response", "WARC-Record-ID": "<urn:uuid:1>", "WARC-Target-URI": "http://a/", "WARC-Date": "2020-01-01T00:00:00Z", "Content-Length": str(len(block))}
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(warc.serialise(head, block)) + gzip.compress(warc.serialise(head | {"WARC-Type": "request"}, block)))
    got = warc.derivatives(warc.read_responses(spark, str(tmp_path / "a.warc.gz"))).collect()
    assert len(got) == 2 and bytes(next(r.block for r in got if r.record_type == "conversion")).decode() == "café & x"
    odd = spark.createDataFrame([(None, None, None, None, None, None)] * 2, "source_id string, record_id string, target_uri string, date string, headers map<string,string>, block binary")
    assert warc.derivatives(odd).count() == 4 and warc.derivatives(odd.limit(0)).count() == 0


def test_damaged_and_coded_responses():
    body = b"<p>one two</p>" * 3000
    chunked = b"".join(b"%x\r\n%s\r\n" % (len(body[i : i + 1000]), body[i : i + 1000]) for i in range(0, len(body), 1000)) + b"0\r\n\r\n"
    assert warc.dechunked(chunked) == body and warc.dechunked(b"no chunks") == b"no chunks" and warc.dechunked(b"") == b""
    raw = zlib.compressobj(9, zlib.DEFLATED, -15)
    for coding, data in (("gzip", gzip.compress(body)), ("deflate", zlib.compress(body)), ("deflate", raw.compress(body) + raw.flush()), ("", body)):
        assert warc.decoded([("Content-Encoding", coding)], data) == body.decode()
    assert warc.decoded([("Transfer-Encoding", "chunked"), ("Content-Encoding", "gzip")], b"%x\r\n" % len(gzip.compress(body)) + gzip.compress(body) + b"\r\n0\r\n\r\n") == body.decode()
    assert warc.decoded([("Content-Encoding", "gzip")], b"plain") == "plain"
    whole = warc.serialise({"WARC-Type": "response", "Content-Length": "3"}, b"abc")
    odd = warc.serialise({"WARC-Type": "response", "Content-Length": "three"}, b"abc")
    assert [b for _, b in warc.parse_records(odd + whole)] == [b"abc"]
    packed = gzip.compress(whole) + gzip.compress(whole * 2000)
    assert 1 <= len(warc.parse_records(packed[:-20])) <= 2001 and len(warc.parse_records(packed)) == 2001


def test_equal_pages_with_other_content_have_own_records(spark):
    pages = spark.createDataFrame([(1, "u", "a"), (1, "u", "b"), (1, "u", None)], "page_id long, url string, html string")
    assert len({r.record_id for r in warc.derivatives(warc.responses_of_pages(pages)).collect()}) == 6


# --- native operators ---


def test_license_headers_and_files(spark):
    t = license_scan.TEMPLATES
    wrap = lambda text: "\n".join(f"# {x}" for x in __import__("textwrap").wrap(text, 60))
    code = "\n\n" + "\n".join(f"value{i} = other{i} + {i}" for i in range(80))
    cases = {
        "SPDX-License-Identifier: MIT" + code: "MIT", "// SPDX-License-Identifier: Apache-2.0" + code: "Apache-2.0", "The MIT License (MIT)": "MIT", "GNU GENERAL PUBLIC LICENSE": "GPL-3.0",
        "Copyright (c) 2020 A. Person\n\n" + wrap(t["MIT"][4]): "MIT", wrap(t["GPL-3.0"][3]) + code: "GPL-3.0", wrap(t["Apache-2.0"][2]) + code: "Apache-2.0", wrap(t["BSD-3-Clause"][2]): "BSD-3-Clause", wrap(t["BSD-2-Clause"][1]): "BSD-2-Clause",
        "A licence to print money is not permission to fish." + code: None, "She asked for permission, then left the public domain of gossip.": None, "SPDX-License-Identifier: Zlib": None,
    }
    df = spark.createDataFrame([(i, "r", f"{i}/f", x) for i, x in enumerate(cases)], "id long, repo string, path string, text string")
    assert {r.id: r.own_license for r in license_scan.scan(df).collect()} == dict(enumerate(cases.values()))
    swapped = spark.createDataFrame([(1, None, "x", "MIT License"), (1, "x", None, "MIT License")], df.schema)
    assert license_scan.scan(swapped).count() == 2


def test_license_inheritance(spark):
    t = {k: v[0] for k, v in license_scan.TEMPLATES.items()}
    long = " ".join(["word"] * 60)
    rows = [(1, "r", "a/LICENSE", t["MIT"]), (2, "r", "a/b/x.txt", long), (3, "r", "a/b/y.txt", long + "\n" + t["Apache-2.0"].upper()), (4, "r", "c/z.txt", long), (5, "q", "a/b/x.txt", long), (6, "r", "a/b/c/d/w.txt", None), (7, None, "a/x", long), (8, "r", None, ""), (9, "r", "a/b/LICENSE", t["CC-BY-NC-4.0"]), (9, "r", "a/b/LICENSE", t["CC-BY-NC-4.0"])]
    df = spark.createDataFrame(rows, "id long, repo string, path string, text string").withColumn("license", F.lit("x")).withColumn("term", F.lit("y"))
    out = license_scan.scan(df).collect()
    got = {r.id: (r.license, r.origin, r.from_dir) for r in out}
    assert len(out) == 10
    assert got[1] == ("MIT", "own", None) and got[3] == ("Apache-2.0", "own", None)
    assert got[2] == ("CC-BY-NC-4.0", "inherited", "a/b") and got[6] == ("CC-BY-NC-4.0", "inherited", "a/b")
    assert all(got[i] == (None, "none", None) for i in (4, 5, 7, 8)) and got[9][0] == "CC-BY-NC-4.0"
    assert license_scan.scan(df.limit(0)).count() == 0


def test_native_queries_equal_sql(spark, sf):
    d = duckdb.connect()
    d.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    for name, q in registry.oracle_sql().items():
        df, want = registry.queries()[name](spark, sf), d.sql(q)
        order = sorted(df.columns)
        assert order == sorted(want.columns)
        a = Counter(tuple(r[c] for c in order) for r in df.collect())
        at = [want.columns.index(c) for c in order]
        assert a == Counter(tuple(r[i] for i in at) for r in want.fetchall()), name


def brute_repeats(text):
    ws = [w for w in re.split(r"[\x20\x09-\x0d]+", text or "") if w]
    seen = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    return len({i + k for i in range(len(ws) - 4) if seen[tuple(ws[i : i + 5])] > 1 for k in range(5)})


def test_quality_of_odd_texts(spark):
    rnd = random.Random(1)
    texts = [*ODD, *(" ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 60))) for _ in range(60)), "\n".join(["a b c d e f g h i j k"] * 2)]
    got = {r.doc_id: r for r in quality_rules.quality(clashing(frame(spark, texts))).collect()}
    for i, t in enumerate(texts):
        ws = [w for w in re.split(r"[\x20\x09-\x0d]+", t or "") if w]
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
        assert (got[i].n_words, got[i].word_chars, got[i].n_dup_lines, got[i].n_repeat_words) == (len(ws), sum(map(len, ws)), len(lines) - len(set(lines)), brute_repeats(t)), repr(t)
    assert quality_rules.quality(frame(spark, [])).count() == 0


def test_furniture_lines_deplete(spark):
    menu = "home news sport weather contact about us now"
    own = [" ".join(f"w{i}x{k}" for k in range(30)) for i in range(40)]
    texts = [f"{menu}\n{o}" for o in own] + [f"{menu}\nfew own words here only"] * 1 + [own[0] + " y"]
    got = quality_rules.quality(frame(spark, texts), max_share=0.2).orderBy("doc_id").collect()
    assert [r.n_left for r in got[:40]] == [30] * 40 and all(r.kept for r in got[:40]) and not got[40].kept and got[41].kept
    twice = frame(spark, texts).union(frame(spark, texts))
    assert [r.n_left for r in quality_rules.quality(twice, max_share=0.2).orderBy("doc_id").collect()][:4] == [30] * 4


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def similar(a, b):
    return abs(len(a) - len(b)) * 10 <= max(len(a), len(b)) and 10 * edits(a, b) <= max(len(a), len(b))


def brute_gone(rows):
    """Places that go: all but the first of each connected group of lines of five words and edit similarity 0.9."""
    occ = [(i, p, " ".join(w for w in x.lower().split(" ") if w)) for i, t in rows if t is not None for p, x in enumerate(t.split("\n"))]
    occ = [(i, p, x) for i, p, x in occ if x.count(" ") >= 4]
    uniq = sorted({x for _, _, x in occ})
    up = {x: x for x in uniq}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(uniq, 2):
        if find(a) != find(b) and similar(a, b):
            up[find(b)] = find(a)
    first = {}
    for i, p, x in sorted(occ):
        first.setdefault(find(x), (i, p))
    return {(i, p) for i, p, x in occ if first[find(x)] != (i, p)}, len(uniq)


def changed(rnd, line, vocab, what):
    w = line.split(" ")
    k = rnd.randrange(len(w))
    w[k] = rnd.choice(vocab) if what == "word" else w[k][:1] + rnd.choice("xyz") + w[k][2:] if what == "letter" else w[k] + "q"
    return " ".join(w[:k] + w[k + 1 :]) if what == "less" else " ".join(w)


def test_line_dedup_equals_all_pairs(spark):
    rnd = random.Random(2)
    vocab = ["".join(rnd.choice(["th", "an", "on", "er", "ti", "re", "s", "ou"]) for _ in range(rnd.randint(1, 4))) for _ in range(400)]
    base = [" ".join(rnd.choice(vocab) for _ in range(rnd.choice([5, 6, 9, 20, 40, 60]))) for _ in range(40)]
    texts = []
    for _ in range(60):
        lines = [rnd.choice(base) for _ in range(4)]
        lines = [changed(rnd, x, vocab, rnd.choice(["word", "letter", "more", "less"])) if rnd.random() < 0.6 else x for x in lines]
        texts.append("\n".join([*(x if rnd.random() < 0.7 else "  " + x.upper().replace(" ", "  ") + " " for x in lines), "short", ""]))
    texts += [None, "", "x" * 5000 + " a b c d e", "a b c d e " * 300]
    df = clashing(frame(spark, texts)).withColumn("_gone", F.lit("y")).withColumn("blocks", F.lit("z"))
    out = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    gone, n = brute_gone([(r.doc_id, r.text) for r in df.collect()])
    for i, text in enumerate(texts):
        assert out[i].text == (None if text is None else "\n".join(x for p, x in enumerate(text.split("\n")) if (i, p) not in gone)), i
        assert (out[i]._key, out[i]._gone, out[i].blocks) == ("x", "y", "z")
    assert sum(r.n_removed for r in out.values()) == len(gone) and len(gone) > 100 and n > 100
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_line_recall_of_planted_changes(spark):
    """Pairs of a line and its copy with one letter or one word changed: those within 0.9 are found."""
    rnd = random.Random(7)
    vocab = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9))) for _ in range(3000)]
    pairs = []
    for k in range(200):
        line = " ".join(rnd.choice(vocab) for _ in range(rnd.randint(6, 100)))
        pairs.append((line, changed(rnd, line, vocab, "letter" if k % 2 else "word")))
    texts = [x for pair in pairs for x in pair]
    out = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(frame(spark, texts)).collect()}
    want = [a != b and similar(a, b) for a, b in pairs]
    got = [out[2 * k] + out[2 * k + 1] == 1 for k in range(len(pairs))]
    assert sum(want) > 150 and all(not g for g, (a, b) in zip(got, pairs, strict=True) if a != b and not similar(a, b))
    assert sum(g for g, w in zip(got, want, strict=True) if w) >= 0.99 * sum(want)


def test_edit_similarity_is_exact(spark):
    rnd = random.Random(11)
    vocab = ["of", "the", "and", "thon", "ereti", "stouan", "x"]
    rows = []
    for _ in range(400):
        a = [rnd.choice(vocab) for _ in range(rnd.choice([5, 12, 40]))]
        b = list(a)
        for _ in range(rnd.randint(0, max(1, len(a) // 5))):
            k = rnd.randrange(len(b))
            b[k : k + 1] = rnd.choice([[], [rnd.choice(vocab)], [b[k], rnd.choice(vocab)], [b[k] + "s"]])
        rows.append((" ".join(a), " ".join(b) or "x"))
    long = [rnd.choice("abcdefgh") * rnd.randint(2, 7) + str(rnd.randint(0, 99)) for _ in range(700)]
    for share in (0.05, 0.1, 0.3):
        rows.append((" ".join(long), " ".join(x for w in long for x in ([w] if rnd.random() > share else rnd.choice([[], [w, "new"], [w + "e"]])))))
    rows.append((" ".join(["same"] * 600), " ".join(["same"] * 560)))
    got = spark.createDataFrame(rows, "x string, y string").select("x", "y", line_dedup.edit_similar(F.col("x"), F.col("y")).alias("s")).collect()
    want = [similar(r.x, r.y) for r in got]
    assert [r.s for r in got] == want and 50 < sum(want) < len(want)


def test_line_dedup_of_long_lines(spark):
    rnd = random.Random(4)
    words = [f"w{rnd.randint(0, 5000)}" for _ in range(9000)]
    other = [*words[:17], "other", "words", *words[18:5000], *words[5003:]]
    out = line_dedup.dedup_lines(frame(spark, [" ".join(words), " ".join(other), " ".join(words[::-1])])).orderBy("doc_id").collect()
    assert [(r.n_removed, r.text == "") for r in out] == [(0, False), (1, True), (0, False)]


def test_repeated_rows_stay_alike(spark):
    df = frame(spark, ["one two three four five six", "one two three four five six"])
    both = df.union(df)
    out = line_dedup.dedup_lines(both).collect()
    assert sorted((r.doc_id, r.text) for r in out) == [(0, "one two three four five six")] * 2 + [(1, "")] * 2
