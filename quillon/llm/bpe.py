"""BPE encoding and decoding: speculate with greedy longest match, verify adjacent pairs, merge what fails.

A sequence of tokens is what byte-pair encoding makes of a word exactly when no merge would have crossed the
border of two neighbours while both borders' parts existed. The check of all pairs of many words at once is a
walk down the right edge of the left token and the left edge of the right one, in whole arrays. Greedy longest
match proposes the tokens; only words with a failing pair are merged step by step. Letters, numbers and lower case
follow the library's Unicode tables: code points on which it departs from Python's are found by one sweep.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import struct
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenizers import Regex, normalizers, pre_tokenizers

from .common import small_batches

WHITE = "\t-\r \x85\xa0  -     　"
_CHUNK = re.compile(f"[^{WHITE}]+")
_ODD_SPACE = re.compile("[\x1c-\x1f]")
END = "</w>"
#: Texts of chunks between white space that a worker remembers.
CACHE = 250_000


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself where printable in Latin-1, else the next from U+0100."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, spare = {b: chr(b) for b in keep}, 256
    for b in range(256):
        if b not in table:
            table[b] = chr(spare)
            spare += 1
    return [table[b] for b in range(256)]


def lengths_by(tokens) -> dict[str, list[int]]:
    """Lengths, longest first, of the tokens with each two-letter start or end (one letter: those of one)."""
    found: dict[str, set[int]] = {}
    for t, key in tokens:
        found.setdefault(key, set()).add(len(t))
    return {k: sorted(v, reverse=True) for k, v in found.items()}


def _ranges(chars) -> str:
    """Body of a character class."""
    points, out = sorted(map(ord, chars)), []
    for x in points:
        if out and out[-1][1] == x - 1:
            out[-1][1] = x
        else:
            out.append([x, x])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


@functools.cache
def differences() -> tuple[str, str, dict[str, str]]:
    """Code points that the library classes or folds otherwise than Python does, from one sweep over all of them.

    (those that regex alone calls letters or numbers, those that the library alone does - each letters first, then
    a zero character, then numbers -, lower case of single code points). The library has Unicode tables of its own.
    """
    points = "".join(map(chr, (*range(1, 0xD800), *range(0xE000, 0x110000))))
    ours, theirs = [], []
    for kind in ("L", "N"):
        split = pre_tokenizers.Split(Regex(rf"\p{{{kind}}}+"), "removed", invert=True)
        lib = set("".join(t for t, _ in split.pre_tokenize_str(points)))
        own = set("".join(regex.findall(rf"\p{{{kind}}}+", points)))
        ours.append("".join(sorted(own - lib)))
        theirs.append("".join(sorted(lib - own)))
    low = normalizers.Lowercase().normalize_str("\0".join(points)).split("\0")
    fold = {c: x for c, x in zip(points, low, strict=True) if x != c.lower() and c != "\u03a3"}
    return "\0".join(ours), "\0".join(theirs), fold


class Vocabulary:
    """A word-end BPE file read into tables: token ids, merge ranks, and each token's two parts."""

    def __init__(self, path: str, differs: tuple | None = None) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.ids: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*self.ids.values(), *self.special.values()]) + 1
        self.names = [""] * self.size
        for t, i in (self.ids | self.special).items():
            self.names[i] = t
        self.middle = {t: i for t, i in self.ids.items() if not t.endswith(END)}
        self.final = {t[: -len(END)]: i for t, i in self.ids.items() if t.endswith(END)}
        self.longest_middle, self.longest_final = max(map(len, self.middle)), max(map(len, self.final))
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        made = np.full(self.size, -1, np.int64)  # rank of the merge that makes a token; -1: a symbol
        left, right = np.arange(self.size), np.arange(self.size)
        for r, (a, b) in enumerate(pairs):
            i, j, k = self.ids[a], self.ids[b], self.ids[a + b]
            self.rank.setdefault((i, j), (r, k))
            if made[k] < 0:
                made[k], left[k], right[k] = r, i, j
        self.made, self.left, self.right = made, left, right
        self.lists = made.tolist(), left.tolist(), right.tolist()
        keys = np.array([i * self.size + j for i, j in self.rank], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.array([r for r, _ in self.rank.values()], np.int64)[order]
        whole = np.flatnonzero(made >= 0)
        good = self.fits(left[whole], right[whole], made[whole]) & (made[left[whole]] < made[whole]) & (made[right[whole]] < made[whole])
        self.broken = set(whole[~good].tolist())  # tokens that merging never makes
        for i in self.broken:
            self.middle.pop(self.names[i], None)
            self.final.pop(self.names[i].removesuffix(END), None) if self.names[i].endswith(END) else None
        self.alphabet = byte_alphabet()
        self.bytes_map = {b: ord(c) for b, c in enumerate(self.alphabet)}
        less, more, fold = differs or differences()
        (not_letters, not_numbers), (letters, numbers) = less.split("\0"), more.split("\0")
        self.odd, self.fold = frozenset(less + more) - {"\0"}, str.maketrans(fold)
        self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+")
        ll, nn = (f"[[\\p{{{k}}}{_ranges(add)}]--[{_ranges(cut)}\\uffff]]" for k, add, cut in (("L", letters, not_letters), ("N", numbers, not_numbers)))
        self.letter, self.number = regex.compile(f"(?V1){ll}"), regex.compile(f"(?V1){nn}")
        self.exact = regex.compile(f"(?V1)'s|'t|'re|'ve|'m|'ll|'d|{ll}+|{nn}|(?:(?!{ll}|{nn})[^{WHITE}])+")
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pair_ok: dict[tuple[int, int], bool] = {}
        self.starts = lengths_by((t, t[:2]) for t in self.middle)
        self.middle_ends = lengths_by((t, t[-2:]) for t in self.middle)
        self.final_ends = lengths_by((t, t[-2:]) for t in self.final)

    def fits(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """For each pair of neighbours: no merge crosses their border (before the given rank, if any)."""
        x, y = np.array(a), np.array(b)
        until_x = np.full(len(x), 1 << 40) if before is None else np.array(before)
        until_y = until_x - (before is not None)
        ok, live = np.ones(len(x), bool), np.arange(len(x))
        while len(live):
            cx, cy = x[live], y[live]
            at = np.minimum(np.searchsorted(self.keys, cx * self.size + cy), len(self.keys) - 1)
            hit = (self.keys[at] == cx * self.size + cy) & (self.ranks[at] < until_x[live]) & (self.ranks[at] <= until_y[live])
            ok[live[hit]] = False
            mx, my = self.made[cx], self.made[cy]
            go = ~hit & ((mx >= 0) | (my >= 0))
            live, mx, my = live[go], mx[go], my[go]
            down_x, down_y = mx >= my, my >= mx
            i = live[down_x]
            until_x[i], x[i] = mx[down_x], self.right[x[i]]
            i = live[down_y]
            until_y[i], y[i] = my[down_y], self.left[y[i]]
        return ok

    def pair_fits(self, a: int, b: int) -> bool:
        """fits() of one pair, remembered."""
        if (got := self.pair_ok.get((a, b))) is None:
            if len(self.pair_ok) > 2_000_000:
                self.pair_ok.clear()
            x, y, ux, uy, got = a, b, 1 << 40, 1 << 40, True
            (made, left, right), rank = self.lists, self.rank
            while True:
                r = rank.get((x, y))
                if r is not None and r[0] < ux and r[0] <= uy:
                    got = False
                    break
                mx, my = made[x], made[y]
                if mx < 0 and my < 0:
                    break
                if mx >= my:
                    ux, x = mx, right[x]
                if my >= mx:
                    uy, y = my, left[y]
            self.pair_ok[a, b] = got
        return got

    def lower(self, text: str) -> str:
        """Lower case letter by letter, so a final sigma keeps no context."""
        return text.translate(self.fold).replace("\u03a3", "\u03c3").lower()

    def split(self, low: str) -> list[str]:
        """Words of a lower-case chunk."""
        return (self.words if self.odd.isdisjoint(low) else self.exact).findall(low)

    def pretokens(self, chunk: str) -> list[str | int]:
        """Words of a chunk without white space, in stand-in letters; special tokens as ids."""
        out: list[str | int] = []
        for part in self.split_special.split(chunk) if self.split_special and "<|" in chunk else (chunk,):
            if part in self.special:
                out.append(self.special[part])
            elif part.isascii():
                words = self.words.findall(part.lower())
                out += [w if w.isprintable() else "".join(self.alphabet[b] for b in w.encode()) for w in words]
            elif part:
                words = self.split(self.lower(unicodedata.normalize("NFC", part)))
                out += [w.encode().decode("latin-1").translate(self.bytes_map) for w in words]
        return out

    def speculate(self, word: str) -> list[int]:
        """Greedy longest match over the word and its end."""
        out, i, n = [], 0, len(word)
        middle, final, starts = self.middle, self.final, self.starts
        while True:
            if n - i <= self.longest_final and (t := final.get(word[i:])) is not None:
                out.append(t)
                return out
            for size in starts.get(word[i : i + 2], ()):
                if size < n - i and (t := middle.get(word[i : i + size])) is not None:
                    break
            else:
                size, t = 1, middle[word[i]]
            out.append(t)
            i += size

    def merge(self, word: str) -> list[int]:
        """Exact merging: the lowest rank first, leftmost among equals."""
        ids = [self.ids[c] for c in word[:-1]] + [self.ids[word[-1] + END]]
        if len(ids) <= 40:
            none, rank = (1 << 40, -1), self.rank
            pairs = [rank.get(p, none) for p in zip(ids, ids[1:], strict=False)]
            while pairs and (best := min(pairs))[1] >= 0:
                i = pairs.index(best)
                ids[i : i + 2] = [best[1]]
                del pairs[i]
                if i < len(pairs):
                    pairs[i] = rank.get((ids[i], ids[i + 1]), none)
                if i:
                    pairs[i - 1] = rank.get((ids[i - 1], ids[i]), none)
            return ids
        after, prior = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(r[0], i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := self.rank.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else len(ids)
            if j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j] = self.rank[a, b][1], -1
            after[i] = k = after[j]
            if k < len(ids):
                prior[k] = i
                if r := self.rank.get((ids[i], ids[k])):
                    heapq.heappush(heap, (r[0], i, ids[i], ids[k]))
            if (h := prior[i]) >= 0 and (r := self.rank.get((ids[h], ids[i]))):
                heapq.heappush(heap, (r[0], h, ids[h], ids[i]))
        return [t for t in ids if t >= 0]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Tokens of many words: speculation, one check of all pairs, merging of the words that fail."""
        guesses = [self.speculate(w) for w in words]
        count = np.array([len(g) for g in guesses])
        flat = np.array([t for g in guesses for t in g], np.int64)
        owner = np.repeat(np.arange(len(words)), count)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        bad = ~self.fits(flat[inner], flat[inner + 1])
        for i in np.unique(owner[inner[bad]]):
            guesses[i] = self.merge(words[i])
        return guesses


def chunks_of(text: str) -> list[str]:
    """Runs without white space."""
    return _CHUNK.findall(text) if _ODD_SPACE.search(text) else text.split()


class Encoder:
    """Encodes texts chunk by chunk, remembering what it has seen."""

    def __init__(self, path: str, differs: tuple | None = None) -> None:
        self.vocab = Vocabulary(path, differs)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.ids: dict[str, bytes] = {}

    def learn(self, chunks: set[str]) -> None:
        if len(self.ids) > CACHE:
            self.ids.clear()
        parts = [(c, self.vocab.pretokens(c)) for c in chunks]
        ids = self.ids
        words = list({w for _, p in parts for w in p if isinstance(w, str) and w not in ids})
        for w, tokens in zip(words, self.vocab.encode_words(words) if words else (), strict=True):
            ids[w] = struct.pack(f"<{len(tokens)}I", *tokens)
        for c, p in parts:
            self.known[c] = b"".join([ids[w] if isinstance(w, str) else struct.pack("<I", w) for w in p])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, little-endian unsigned 32-bit."""
        split = [chunks_of(t) for t in texts]
        new = set().union(*split)
        if len(self.known) + len(new) > CACHE:
            self.older, self.known = self.known, {}
        fresh = new.difference(self.known)
        for c in fresh.intersection(self.older):
            self.known[c] = self.older[c]
        if fresh := fresh.difference(self.older):
            self.learn(fresh)
        get = self.known.__getitem__
        return [b"".join(map(get, s)) for s in split]

    def decode(self, ids: bytes) -> str:
        """Token names joined by one space, as the file names no decoder."""
        names = self.vocab.names
        return " ".join([names[i] for i in np.frombuffer(ids, "<u4").tolist()])


def _batches(values: list, rows: int = 128):
    for i in range(0, len(values), rows):
        yield values[i : i + rows]


def _encode(path: str, digests: bool, differs: tuple):
    def run(batches):
        enc = Encoder(path, differs)
        for batch in batches:
            for a in range(0, batch.num_rows, 128):
                part = batch.slice(a, 128)
                ids = enc.encode([t or "" for t in part.column(1).to_pylist()])
                cols = [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64())]
                names = ["id", "n_tokens"]
                if digests:
                    cols.append(pa.array([hashlib.sha256(x).hexdigest() for x in ids]))
                    cols.append(pa.array([hashlib.sha256(enc.decode(x).encode()).hexdigest() for x in ids]))
                    names += ["ids_sha256", "decoded_sha256"]
                else:
                    flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
                    ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids])))
                    cols.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)))
                    cols.append(pa.array([enc.decode(x) for x in ids]))
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def bpe_encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Rows (id_col, n_tokens, ids, decoded), or their SHA-256 digests instead of ids and text.

    `vocabulary` is the path of a word-end BPE file that each executor can open. No special tokens are added;
    their strings within a text become their ids. A null text is the empty one: no tokens. Repeated rows and null
    ids are encoded like any others; further columns, whatever their names, are ignored. Texts are never cut.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    rest = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return base.mapInArrow(_encode(vocabulary, digests, differences()), f"id {kind}, n_tokens long, {rest}").withColumnRenamed("id", id_col)


def op2_bpe_codec(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), digests=True)
