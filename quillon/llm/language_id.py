"""Language ID by multilingual mixture inference.

Each language has a model of character n-grams (1 to 3 letters, within words and over their borders). A word's
likelihood under a language is that of its n-grams. A document is a mixture: expectation-maximisation estimates
the share of each language in its words. Of the nested sets of its likeliest languages the one with the best
penalised likelihood (half a log of the words for each further share) is kept, and its shares are refitted.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Hashed n-gram cells of a language, the longest n-gram, and the added count of an unseen one.
CELLS, WIDEST, SMOOTH = 1 << 15, 3, 0.5
#: The models are fitted on about so many labelled documents of each language, chosen by hash.
SAMPLE_PER_LANGUAGE = 3000
#: Iterations of expectation-maximisation for each set of languages.
STEPS = 12
CACHE = 400_000
_LETTERS = re.compile(r"[^\W\d_]+")


class Cells(dict):
    """Cell of an n-gram, remembered."""

    def __missing__(self, gram: str) -> int:
        if len(self) > CACHE:
            self.clear()
        self[gram] = cell = zlib.crc32(gram.encode()) % CELLS
        return cell


_CELL = Cells()


def cells_of(word: str) -> list[int]:
    """Cells of the n-grams of one lower-case word and its borders."""
    b, cell = f" {word} ", _CELL
    out = [cell[c] for c in word]
    for n in range(2, WIDEST + 1):
        out += [cell[b[i : i + n]] for i in range(len(b) - n + 1)]
    return out


def _learn(batches):
    """(lang, text) -> n-gram counts of this task by language."""
    counts: dict[str, np.ndarray] = {}
    known: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            have = counts.setdefault(lang, np.zeros(CELLS))
            cells = []
            for w in (text or "").split():
                if (got := known.get(w)) is None:
                    if len(known) > CACHE:
                        known.clear()
                    got = known[w] = np.array([c for x in _LETTERS.findall(w.lower()) for c in cells_of(x)], np.int64)
                cells.append(got)
            if cells:
                have += np.bincount(np.concatenate(cells), minlength=CELLS)
    for lang, have in counts.items():
        at = np.flatnonzero(have)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int64()), pa.array(have[at].astype(np.int64))], names=["lang", "cell", "n"])


class Model:
    """Log-probabilities of n-gram cells: languages x CELLS."""

    def __init__(self, langs: list[str], counts: np.ndarray) -> None:
        self.langs = langs
        total = counts.sum(1, keepdims=True)
        self.logp = np.log((counts + SMOOTH) / (total + SMOOTH * CELLS)).astype(np.float32).T.copy()


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE_PER_LANGUAGE, learn_from=None) -> Model:
    """Learn from labelled rows (where `learn_from` holds): all of a language, or about `sample` of them by hash.

    What reaches the driver are the counts: languages x CELLS numbers, whatever the rows. Without any labelled
    row the model has no language and every prediction is `und`.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), (F.lit(True) if learn_from is None else learn_from).alias("use"))
    base = base.where("use and lang is not null")
    sizes = base.groupBy("lang").agg(F.count("*").alias("rows"))
    draw = F.pmod(F.xxhash64("text"), F.lit(1_000_003)) * F.col("rows") < F.lit(1_000_003 * sample)
    rows = base.join(F.broadcast(sizes), "lang").where(draw).select("lang", "text")
    got = rows.mapInArrow(_learn, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique().tolist())
    counts = np.zeros((len(langs), CELLS))
    if len(got):
        counts[np.searchsorted(langs, got["lang"].to_numpy(dtype=str)), got["cell"].to_numpy()] = got["n"].to_numpy()
    return Model(langs, counts)


def mixtures(ll: np.ndarray, owner: np.ndarray, docs_total: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares of each language by document, zero outside its chosen set, and how many were chosen.

    `ll`: words x languages log-likelihoods; `owner`: the document of each word, ascending. Sets of any
    size are judged. The likelihood is concave in the shares, so no mixture exceeds that of the shares of all
    languages by more than their largest slope less the words; a set is left out only if even that bound
    doesn't beat its penalty.
    """
    k = ll.shape[1]
    top = ll.max(1)
    like = np.exp((ll - top[:, None]).T)  # a row for each language, its largest 1
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    who, words = owner[first], np.diff(np.append(first, len(owner)))

    def climb(like: np.ndarray, words: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shares and log-likelihoods after STEPS rounds; like: languages x words, shares: languages x documents."""
        starts = np.concatenate(([0], np.cumsum(words)[:-1]))
        for step in range(STEPS + 1):
            total = np.zeros(like.shape[1], like.dtype)
            for j in range(k):
                total += like[j] * np.repeat(shares[j].astype(like.dtype), words)
            np.maximum(total, 1e-30, out=total)
            if step == STEPS:
                return shares, np.add.reduceat(np.log(total).astype(np.float64), starts)
            np.reciprocal(total, out=total)
            shares = np.stack([shares[j] * np.add.reduceat((like[j] * total).astype(np.float64), starts) / words for j in range(k)])

    full, fit = climb(like, words, np.full((k, len(first)), 1 / k))
    total = np.zeros(like.shape[1], like.dtype)
    for j in range(k):
        total += like[j] * np.repeat(full[j].astype(like.dtype), words)
    np.reciprocal(np.maximum(total, 1e-30), out=total)
    slope = np.max([np.add.reduceat((like[j] * total).astype(np.float64), first) for j in range(k)], axis=0)
    bound = fit + np.maximum(slope - words, 0) + 1e-3 + 1e-5 * words  # and what single precision may hide
    order = np.argsort(-full, axis=0, kind="stable")
    place = np.argsort(order, axis=0, kind="stable")
    alone = np.add.reduceat((ll - top[:, None]).astype(np.float64), first, axis=0).T
    one = alone.argmax(0)
    best, chosen = alone.max(0), np.ones(len(first), np.int64)
    shares = np.zeros((k, len(first)))
    shares[one, np.arange(len(first))] = 1
    for size in range(2, k + 1):
        docs = np.flatnonzero(bound - 0.5 * (size - 1) * np.log(words) > best)
        if not len(docs):
            break
        pick = np.repeat(np.isin(np.arange(len(first)), docs), words)
        start = np.where(place[:, docs] < size, np.maximum(full[:, docs], 1e-6), 0)
        now, fitted = climb(np.ascontiguousarray(like[:, pick]), words[docs], start / start.sum(0))
        score = fitted - 0.5 * (size - 1) * np.log(words[docs])
        better = score > best[docs]
        at = docs[better]
        best[at], shares[:, at], chosen[at] = score[better], now[:, better], size
    out, n = np.zeros((docs_total, k)), np.zeros(docs_total, np.int64)
    out[who], n[who] = shares.T, chosen
    return out, n


class Predictor:
    """Shares of texts; the rows of likelihoods of chunks are remembered."""

    def __init__(self, model: Model) -> None:
        self.model, self.row, self.word, self.used = model, {}, {}, 0
        self.rows = np.zeros((1024, len(model.langs)), np.float32)
        self.real = np.zeros(1024, bool)

    def learn(self, chunks) -> None:
        """Rows of new chunks: a chunk of one word shares the word's row, others get the sum of theirs."""
        split = {c: _LETTERS.findall(c.lower()) for c in chunks}
        fresh = list({w for ws in split.values() for w in ws if w not in self.word})
        several = [c for c, ws in split.items() if len(ws) != 1]
        need = self.used + len(fresh) + len(several)
        while need > len(self.rows):
            self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
            self.real = np.concatenate((self.real, np.zeros_like(self.real)))
        if fresh:
            cells = [cells_of(w) for w in fresh]
            starts = np.concatenate(([0], np.cumsum([len(c) for c in cells])[:-1]))
            at = self.used + np.arange(len(fresh))
            self.rows[at] = np.add.reduceat(self.model.logp[[x for c in cells for x in c]], starts, axis=0)
            self.real[at] = True
            self.word.update(zip(fresh, at.tolist(), strict=True))
            self.used += len(fresh)
        for c, ws in split.items():
            if len(ws) == 1:
                self.row[c] = self.word[ws[0]]
                continue
            self.rows[self.used] = self.rows[[self.word[w] for w in ws]].sum(0) if ws else 0
            self.real[self.used] = bool(ws)
            self.row[c] = self.used
            self.used += 1

    def shares(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        split = [t.split() for t in texts]
        new = set().union(*split)
        fresh = new.difference(self.row)
        if self.used + len(fresh) > 2 * CACHE or len(self.row) > CACHE:
            self.row, self.word, self.used = {}, {}, 0
            fresh = new
        self.learn(fresh)
        get = self.row.__getitem__
        index = np.array([i for s in split for i in map(get, s)], np.int64)
        owner = np.repeat(np.arange(len(texts)), [len(s) for s in split])
        ok = self.real[index] if len(index) else np.zeros(0, bool)
        index, owner = index[ok], owner[ok]
        if not len(index) or not self.model.langs:
            return np.zeros((len(texts), len(self.model.langs))), np.zeros(len(texts), np.int64)
        return mixtures(self.rows[index], owner, len(texts))


def _predict(shared):
    def run(batches):
        predictor = Predictor(shared.value)
        langs = shared.value.langs
        for batch in batches:
            for a in range(0, batch.num_rows, 128):
                part = batch.slice(a, 128)
                shares, n = predictor.shares([t or "" for t in part.column(1).to_pylist()])
                top = shares.argmax(1) if len(langs) else np.zeros(len(n), int)
                pred = [langs[j] if m else "und" for j, m in zip(top, n, strict=True)]
                score = [float(min(1.0, shares[i, j])) if n[i] else 0.0 for i, j in enumerate(top)]
                mixed = [{langs[j]: float(row[j]) for j in np.argsort(-row, kind="stable")[:m]} if m else {} for row, m in zip(shares, n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array([list(x.items()) for x in mixed], pa.map_(pa.string(), pa.float64()))],
                    names=["id", "lang_pred", "score", "shares"],
                )

    return run


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, lang_pred, score, shares): the language with the largest share, that share, and all chosen.

    `und` with score 0 and no shares if the text is null or has no letter. Ties go to the language first in
    the alphabet. Repeated rows and null ids are judged like others; further columns are ignored.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = base.mapInArrow(_predict(shared), f"id {kind}, lang_pred string, score double, shares map<string,double>")
    return out.withColumnRenamed("id", id_col)


def _keep(shared, at: int):
    def run(batches):
        predictor = Predictor(shared.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 128):
                part = batch.slice(a, 128)
                _, n = predictor.shares([t or "" for t in part.column(at).to_pylist()])
                yield part.filter(pa.array(n > 0))

    return run


def with_language(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text has a language; what predict() calls `und` goes. All columns stay as they are."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_keep(shared, docs.columns.index(text_col)), docs.schema)


def held_out(id_col: str = "doc_id"):
    """True for the documents that nothing is learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1, F.lit(False))


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, learn_from=~held_out())
    out = predict(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "shares")
