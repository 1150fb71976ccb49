"""Benchmark decontamination: a BM25 index of the test items, block-max pruning, overlap verification.

Items are cut into pieces of at most `PIECE` words and indexed; pieces lie in blocks, and for each term and
block the index holds the largest share of a piece's own score that the term can give. Every passage of a
training text (128 words, each starting 64 after the last) is a query: the block bounds of its terms are summed,
and only blocks whose sum reaches the threshold are scored, so every piece above the threshold is found. For a
document with a hit the item's question and answer are then looked for in its whole text by word n-grams.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, mix, small_batches, text_buffer, word_hashes

_U = np.uint64
#: Words of an item's piece, of a passage's half, and pieces of a block.
PIECE, HALF, BLOCK = 64, 64, 8
#: BM25's constants, and the share of a piece's own score from which it is retrieved.
K1, B, THRESHOLD = 1.2, 0.75, 0.6
#: Words of a verified n-gram, and the shares of an item's question and answer that must be found.
GRAM, QUESTION, ANSWER = 4, 0.5, 0.5
#: Items that one index may hold; a larger benchmark is split over several, each passed over the texts.
ITEMS_AT_ONCE = 20_000

# Bytes between words: ASCII that is neither letter nor digit.
_GAPS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def item_parts(text: str) -> tuple[str, str]:
    """Question and answer of an item: the answer is its last line or sentence, if anything precedes it."""
    parts = [p for p in _SENTENCE.split(text) if p.strip()]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, "")


def _words(texts: list[str]) -> list[np.ndarray]:
    raw, offs = text_buffer(pa.array([t.lower() for t in texts], pa.large_string()))
    h, at = word_hashes(raw, offs, _GAPS)
    return [h[at[i] : at[i + 1]] for i in range(len(texts))]


def grams(words: np.ndarray, width: int = GRAM) -> np.ndarray:
    """Hashes of the word n-grams in order; a shorter text is one n-gram of its own length."""
    width = min(width, len(words))
    if not width:
        return np.zeros(0, _U)
    out = np.zeros(len(words) - width + 1, _U)
    for k in range(width):
        out = mix(out + words[k : len(words) - width + 1 + k], 1)
    return out


class Index:
    """Inverted index of the items' pieces with term bounds by block."""

    def __init__(self, ids: list, texts: list[str]) -> None:
        self.ids = ids
        words = _words(texts)
        self.parts = [tuple(np.unique(grams(w)) for w in _words(list(item_parts(t)))) for t in texts]
        pieces, self.item = [], []
        for i, w in enumerate(words):
            for a in range(0, len(w), PIECE):
                pieces.append(w[a : a + PIECE])
                self.item.append(i)
        n = len(pieces)
        self.vocab, seen = np.unique(np.concatenate([np.unique(p) for p in pieces]), return_counts=True) if n else (np.zeros(0, _U), [])
        # Blocks hold pieces with like common words, so that their bounds are tight.
        common = self.vocab[np.argsort(-np.asarray(seen), kind="stable")[:24]]
        order = sorted(range(n), key=lambda j: np.isin(common, pieces[j]).tolist())
        pieces, self.item = [pieces[j] for j in order], np.array(self.item, np.int64)[order]
        length = np.array([len(p) for p in pieces], float)
        rows, cols, tf = [], [], []
        for j, p in enumerate(pieces):
            t, c = np.unique(np.searchsorted(self.vocab, p), return_counts=True)
            rows.append(t)
            cols.append(np.full(len(t), j))
            tf.append(c)
        term, piece, tf = (np.concatenate(x) if n else np.zeros(0, np.int64) for x in (rows, cols, tf))
        df = np.bincount(term, minlength=len(self.vocab))
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[piece] / max(1.0, length.mean() if n else 1)))
        own = np.bincount(piece, impact, minlength=n)
        share = impact / np.maximum(own[piece], 1e-12)
        order = np.argsort(term, kind="stable")
        self.post_piece, self.post_share = piece[order], share[order]
        self.post_at = np.searchsorted(term[order], np.arange(len(self.vocab) + 1))
        self.n, self.n_blocks = n, -(-n // BLOCK)
        self.bounds = np.zeros((len(self.vocab) + 1, self.n_blocks), np.float32)
        np.maximum.at(self.bounds, (term, piece // BLOCK), share.astype(np.float32) * np.float32(1.00001))

    def terms(self, words: np.ndarray) -> np.ndarray:
        """Term of each word; words that no item has get the one past the last."""
        if not len(self.vocab):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.vocab, words), len(self.vocab) - 1)
        return np.where(self.vocab[at] == words, at, len(self.vocab))

    def search(self, passage: np.ndarray, terms: np.ndarray, live: np.ndarray, threshold: float) -> tuple[np.ndarray, ...]:
        """(passage, piece, share) at or above the threshold, for sorted (passage, term) pairs.

        `live` says which blocks of a passage may reach it; postings in other blocks are skipped.
        """
        lens = self.post_at[terms + 1] - self.post_at[terms]
        at = np.repeat(self.post_at[terms] - np.concatenate(([0], np.cumsum(lens)[:-1])), lens) + np.arange(lens.sum())
        who, piece = np.repeat(passage, lens), self.post_piece[at]
        ok = live[who, piece // BLOCK]
        cell, slot = np.unique(who[ok] * self.n + piece[ok], return_inverse=True)
        score = np.bincount(slot, self.post_share[at[ok]], minlength=len(cell))
        hit = score >= threshold - 1e-9
        return cell[hit] // self.n, cell[hit] % self.n, score[hit]

    def verify(self, item: int, found: np.ndarray) -> tuple[float, float]:
        """Shares of an item's question and answer n-grams among a document's sorted n-grams."""
        out = []
        for part in self.parts[item]:
            if not len(part):
                out.append(1.0)
            elif not len(found):
                out.append(0.0)
            else:
                at = np.minimum(np.searchsorted(found, part), len(found) - 1)
                out.append(float((found[at] == part).mean()))
        return out[0], out[1]


def matches(index: Index, raw: np.ndarray, offs: np.ndarray, threshold: float, question: float, answer: float) -> list[tuple]:
    """(row, item, best share, question share, answer share) of the texts' verified items."""
    words, at = word_hashes(raw, offs, _GAPS)
    if not len(words) or not index.n:
        return []
    terms = index.terms(words)
    known = terms < len(index.vocab)
    count = np.diff(at)
    halves = np.maximum(1, -(-count // HALF))
    first = np.concatenate(([0], np.cumsum(halves)))
    half = np.repeat(first[:-1], count) + (np.arange(len(words)) - np.repeat(at[:-1], count)) // HALF
    vocab = len(index.vocab)
    half, term = half[known], terms[known]
    opens = np.zeros(first[-1], bool)
    opens[first[:-1]] = True
    # A passage is a half and the next of its text: each half belongs to its own and to the one before.
    back = ~opens[half]
    key = np.unique(np.concatenate((half * vocab + term, (half[back] - 1) * vocab + term[back])))
    cell, term = key // vocab, key % vocab
    starts = np.searchsorted(cell, np.arange(first[-1]))
    filled = np.flatnonzero(np.diff(np.append(starts, len(cell))))
    bound = np.zeros((first[-1], index.n_blocks), np.float32)
    if len(filled):
        bound[filled] = np.add.reduceat(index.bounds[term], starts[filled], axis=0)
    live = bound >= threshold
    out = []
    owner = np.repeat(np.arange(len(count)), halves)
    by_row: dict[int, dict[int, float]] = {}
    pick = live.any(1)[cell]
    for who, piece, share in zip(*(x.tolist() for x in index.search(cell[pick], term[pick], live, threshold)), strict=True) if pick.any() else ():
        held, item = by_row.setdefault(int(owner[who]), {}), int(index.item[piece])
        held[item] = max(held.get(item, 0.0), share)
    for row, items in by_row.items():
        w = words[at[row] : at[row + 1]]
        found = {}
        for item, share in sorted(items.items()):
            widths = [len(p) for p in index.parts[item]]
            if not any(widths):
                continue
            q, a = index.verify(item, found.setdefault(GRAM, np.unique(grams(w))))
            if q < question or a < answer:
                q2, a2 = _short(index, item, w, found)
                q, a = max(q, q2), max(a, a2)
            if q >= question and a >= answer:
                out.append((row, item, share, q, a))
    return out


def _short(index: Index, item: int, w: np.ndarray, found: dict) -> tuple[float, float]:
    """verify() for parts of fewer than GRAM words: they are one n-gram of 1 to GRAM - 1 words."""
    q = a = 0.0
    for width in range(1, GRAM):
        x, y = index.verify(item, found.setdefault(width, np.unique(grams(w, width))))
        q = max(q, x if len(index.parts[item][0]) == 1 else 0.0)
        a = max(a, y if len(index.parts[item][1]) == 1 else 0.0)
    return q, a


_OUT = ["id", "item_id", "bm25_share", "question_share", "answer_share"]


def _run(shared, threshold: float, question: float, answer: float):
    def run(batches):
        index = shared.value
        for batch in batches:
            texts = batch.column(1)
            if any(t is not None and not t.isascii() for t in texts.to_pylist()):
                texts = pa.array([t.lower() if t is not None else None for t in texts.to_pylist()], pa.large_string())
            raw, offs = text_buffer(texts)
            rows = []
            for a, b in blocks(offs):
                rows += [(a + r, *x) for r, *x in matches(index, raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a], threshold, question, answer)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array([index.ids[i] for i in cols[1]], shared.value.kind), *[pa.array(c, pa.float64()) for c in cols[2:]]], names=_OUT
            )

    return run


def indexes(items: DataFrame, item_id: str, item_text: str, items_at_once: int) -> list[Index]:
    """One index, or one for each shard of about `items_at_once` items."""
    bench = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).where("text is not null")
    shards, out = max(1, -(-bench.count() // items_at_once)), []
    for shard in range(shards):
        own = bench if shards == 1 else bench.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(shards)) == shard)
        rows = own.orderBy("item_id", "text").toArrow()
        out.append(Index(rows.column(0).to_pylist(), rows.column(1).to_pylist()))
        out[-1].kind = rows.schema.field(0).type
    return out


def contaminations(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    threshold: float = THRESHOLD, question: float = QUESTION, answer: float = ANSWER, items_at_once: int = ITEMS_AT_ONCE,
) -> DataFrame:
    """Rows (id_col, item_id, bm25_share, question_share, answer_share): items found in a text, each once a row.

    Letters are lower-cased and ASCII punctuation separates words. Null or wordless texts and items match
    nothing; repeated rows are reported for each row; null ids stay null. An item of one sentence is all
    question. The benchmark is read in shards of `items_at_once` items, so what is broadcast has that bound.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind, item_kind = base.schema["id"].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    out = None
    for index in indexes(items, item_id, item_text, items_at_once):
        shared = spark.sparkContext.broadcast(index)
        found = base.mapInArrow(_run(shared, threshold, question, answer), f"id {kind}, item_id {item_kind}, bm25_share double, question_share double, answer_share double")
        out = found if out is None else out.union(found)
    return out.withColumnRenamed("id", id_col)


def _clean(shared, at: int, threshold: float, question: float, answer: float):
    def run(batches):
        for batch in batches:
            texts = batch.column(at)
            if any(t is not None and not t.isascii() for t in texts.to_pylist()):
                texts = pa.array([t.lower() if t is not None else None for t in texts.to_pylist()], pa.large_string())
            raw, offs = text_buffer(texts)
            keep = np.ones(batch.num_rows, bool)
            for a, b in blocks(offs):
                for r, *_ in matches(shared.value, raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a], threshold, question, answer):
                    keep[a + r] = False
            yield batch.filter(pa.array(keep))

    return run


def without_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", items_at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """The rows of docs in whose text contaminations() finds no item; all columns stay as they are."""
    small_batches(docs.sparkSession)
    for index in indexes(items, item_id, item_text, items_at_once):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        docs = docs.mapInArrow(_clean(shared, docs.columns.index(text_col), THRESHOLD, QUESTION, ANSWER), docs.schema)
    return docs


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminations(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
