"""Operators against the whole of what they promise."""

import random
import time

import duckdb
import numpy as np
from pyspark.sql import functions as F

from quillon.llm import common, jaccard_join, language_id, line_dedup, quality_rules
from test_llm import brute_components, frame


def changed(rnd, line, edits):
    s = list(line)
    for _ in range(edits):
        at, kind = rnd.randrange(len(s)), rnd.random()
        if kind < 0.6:
            s[at] = rnd.choice("abcdefghijklmnopqrstuvwxyz")
        elif kind < 0.8:
            s.insert(at, rnd.choice("abcdefghijklmnopqrstuvwxyzß𝔞"))
        else:
            del s[at]
    return " ".join("".join(s).split())


def groups_of(lines, least=0.9):
    """Groups by edit similarity of all pairs, without any filter."""
    pairs = duckdb.sql("SELECT a, b FROM (VALUES " + ",".join(f"({i}, '{x}')" for i, x in enumerate(lines)) + ") s(a, x), (VALUES " + ",".join(f"({i}, '{x}')" for i, x in enumerate(lines)) + f") t(b, y) WHERE a < b AND abs(length(x) - length(y)) <= greatest(length(x), length(y)) * {1 - least} + 1e-9 AND levenshtein(x, y) <= floor(greatest(length(x), length(y)) * {1 - least} + 1e-9)").fetchall()
    up = list(range(len(lines)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        up[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(len(lines))], len(pairs)


def test_lines_are_linked_by_edit_similarity_alone(spark):
    rnd = random.Random(8)
    syllables = ["en", "tion", "ou", "he", "ach", "st", "ing", "ver", "keit", "a", "in", "re", "ß"]
    lines = []
    for n in [6, 9, 15, 30, 60, 120] * 8:
        base = " ".join("".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4))) for _ in range(n))
        lines += [base, changed(rnd, base, 1), changed(rnd, base, int(len(base) * rnd.choice([0.03, 0.05, 0.09])))]
    lines = [x for x in dict.fromkeys(lines) if x.count(" ") >= 4]
    want, n_pairs = groups_of([x.lower() for x in lines])
    out = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(frame(spark, lines)).collect()}
    assert n_pairs > 80
    assert [i for i in range(len(lines)) if out[i]] == [i for i, root in enumerate(want) if root != i]


def test_long_lines_by_characters(spark):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(40)]
    other = [w[:3] + "z" + w[4:] if i % 8 == 0 else w for i, w in enumerate(words)]
    out = line_dedup.dedup_lines(frame(spark, [" ".join(words), " ".join(other)])).orderBy("doc_id").collect()
    assert [r.n_removed for r in out] == [0, 1]


def test_lines_of_few_words_over_and_over_meet(spark):
    words = [f"{a}{b}ord" for a in "abcdefgh" for b in "klmn"]
    lines = []
    for k in range(30):
        line = [words[k]] * 400 if k % 2 else [words[k], words[(k + 7) % 32], words[(k + 13) % 32]] * 150
        lines += [" ".join(line), " ".join([*line[:50], f"new{k}", *line[52:]])]
    out = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(frame(spark, lines)).collect()}
    assert [out[i] for i in range(60)] == [0, 1] * 30


def test_shuffles_go_with_the_table_they_made(spark):
    """What a step shuffled does not stay beside the next one's: line_dedup and jaccard_join ran out of disk by that."""
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: sum(str(f.getName()).startswith("shuffle_") for f in _listed(blocks.getAllFiles()))
    before, setting = files(), spark.conf.get(common.SHUFFLE_CLEANUP)
    table = common.materialise(spark.range(1000).repartition(7, "id"), "shuffled")
    for _ in range(50):  # files are deleted in the background
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and table.count() == 1000 and spark.conf.get(common.SHUFFLE_CLEANUP) == setting


def _listed(files):
    return [files.apply(i) for i in range(files.size())]


def test_shared_passages_chain_no_regions(spark, monkeypatch):
    """Texts that share a few passages but no link were tied into one region of nearly all, which no task could join."""
    rnd = random.Random(6)
    own = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    passages = [own(12) for _ in range(15)]
    texts = [own(60) + rnd.choice(passages) + own(60) + rnd.choice(passages) + own(rnd.randrange(20, 120)) for _ in range(300)]
    texts += [x[: rnd.randrange(len(x) - 4)] + ["other"] + x[4:] if i % 3 else [*x[:-9], *own(rnd.randrange(1, 25))] for i, x in enumerate(texts[:60])]
    rows = list(enumerate([" ".join(x) for x in texts]))
    wanted = []
    kept = lambda df, label: wanted.append(common.materialise(df, label)) or wanted[-1] if label == "wanted" else common.materialise(df, label)
    monkeypatch.setattr(jaccard_join, "materialise", kept)
    out = jaccard_join.jaccard_components(frame(spark, [x for _, x in rows]), width=5, num=80)
    got, want = {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()}, brute_components(rows, 5, 80)
    linked = sum(i != first for i, (_, first) in want.items())
    assert got == want and linked >= 15
    assert max(r["count"] for r in wanted[0].groupBy("region").count().collect()) <= 20 and wanted[0].count() <= 200


def test_furniture_leaves_the_text(spark):
    own = [f"word{i} of this page alone, and more of its own words\n\nend {i}" for i in range(30)]
    texts = [f"Home | About\n{x}\n home | about " for x in own] + [None, "a single page\n\t"]
    out = {r.doc_id: r for r in quality_rules.cleaned(frame(spark, texts)).collect()}
    assert [out[i].clean_text for i in range(32)] == own + [None, texts[31]]
    assert all(out[i].n_left == len(own[i].split()) and out[i].n_words == out[i].n_left + 6 for i in range(30))


def test_documents_with_short_lines_of_their_own_stay(spark):
    import corpus_pipeline

    notice = "this notice stands in every page of the house"
    texts = [f"{notice}\nshared short", f"{notice}\nonly verse here\n", f"{notice}\nshared short", f"{notice}\n \n", "shared short"]
    out = {r.doc_id: r.text for r in corpus_pipeline.fresh_lines(spark, frame(spark, texts), "").collect()}
    assert out == {0: texts[0], 1: "only verse here\n", 4: "shared short"}


def test_one_foreign_word_and_six_languages_are_found():
    few = np.full((20, 3), -20.0)
    few[:, 0] = -12
    few[7] = [-20, -12, -20]
    many = np.full((70, 7), -30.0)
    many[np.arange(70), np.arange(70) % 7] = -12
    shares, n = language_id.mixtures(few.astype(np.float32), np.zeros(20, np.int64), 1)
    assert n[0] == 2 and abs(shares[0, 1] - 0.05) < 0.01
    shares, n = language_id.mixtures(many.astype(np.float32), np.zeros(70, np.int64), 1)
    assert n[0] == 7 and np.allclose(shares[0], 1 / 7, atol=1e-3)


def test_no_set_is_skipped_that_would_win():
    rnd = np.random.default_rng(4)
    for _ in range(60):
        k, words = int(rnd.integers(2, 7)), int(rnd.integers(3, 60))
        ll = rnd.normal(-9, 1, (words, k))
        ll[np.arange(words), rnd.choice(k, words, p=rnd.dirichlet(np.full(k, 0.3)))] += rnd.uniform(1, 8)
        x = ll.astype(np.float32).astype(float)

        def climb(p):
            for _ in range(language_id.STEPS):
                w = np.exp(x) * p
                p = (w / w.sum(1, keepdims=True)).mean(0)
            return p, np.log((np.exp(x) * p).sum(1)).sum()

        full, _ = climb(np.full(k, 1 / k))
        order, best = np.argsort(-full, kind="stable"), (x.sum(0).max(), 1)
        for size in range(2, k + 1):
            start = np.where(np.isin(np.arange(k), order[:size]), np.maximum(full, 1e-6), 0)
            best = max(best, (climb(start / start.sum())[1] - 0.5 * (size - 1) * np.log(words), size), key=lambda b: b[0])
        assert language_id.mixtures(x.astype(np.float32), np.zeros(words, np.int64), 1)[1][0] == best[1]


def test_line_tables_go_before_the_text_is_read(spark, monkeypatch):
    """The tables of all lines stayed on disk beside the next stage's."""
    held = {}
    kept = lambda df, label: held.setdefault(label, common.materialise(df, label))
    monkeypatch.setattr(line_dedup, "materialise", kept)
    out = line_dedup.dedup_lines(frame(spark, ["one two three four five six"] * 3))
    paths = [spark._jvm.org.apache.hadoop.fs.Path(held[x].inputFiles()[0]).getParent() for x in ("lines", "unique")]
    assert not any(x.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(x) for x in paths)
    assert sorted(r.n_removed for r in out.collect()) == [0, 1, 1]


def test_lines_of_other_letters_are_not_joined(spark, monkeypatch):
    """Lines that share a block alone make no joined row if edits can't make their letter counts alike; like ones still meet."""
    rnd, rows, real = random.Random(21), {}, line_dedup.materialise

    def counted(df, label):
        out = real(df, label)
        rows.setdefault(label, out.count())
        return out

    monkeypatch.setattr(line_dedup, "materialise", counted)
    lines = []
    for _ in range(40):
        few = rnd.sample("etaoinsrhdlucgbfkmpwxyz", 4)
        lines.append(" ".join(["alphabet", "monument", *("".join(rnd.choice(few) for _ in range(6)) for _ in range(7))]))
    lines += [changed(rnd, lines[i], 2) for i in (20, 30)]
    out = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(frame(spark, lines)).collect()}
    assert [i for i in range(len(lines)) if out[i]] == [40, 41]
    assert rows["rest"] < 80  # of some 800


def test_letter_counts_refuse_no_similar_line(spark):
    rnd, rows = random.Random(22), []
    for n in (6, 12, 40, 150, 900, 4000):
        for _ in range(12):
            line = " ".join("".join(rnd.choice("eeeettaoinshrdluñß𝔞") for _ in range(rnd.randrange(1, 9))) for _ in range(n))
            rows.append((line, changed(rnd, line, int(len(line) * 0.088))))
    df = spark.createDataFrame(rows, "x string, y string")
    for side in "xy":
        letters = [c.alias(f"letters{k}") for k, c in enumerate(line_dedup._letters(F.col(side), F.length(side)))]
        df = df.withColumn({"x": "a", "y": "b"}[side], F.struct(F.length(side).alias("length"), *letters))
    got = df.select(line_dedup._spellable("a", "b", 0.9).alias("kept")).collect()
    assert all(r.kept for r in got) and len(got) == len(rows)


def counted_rows(monkeypatch):
    """Rows of each table that line_dedup writes, by label."""
    rows, real = {}, line_dedup.materialise

    def counted(df, label):
        out = real(df, label)
        rows.setdefault(label, []).append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "materialise", counted)
    return rows


def test_lines_with_a_common_passage_are_told_apart_in_the_join(spark, monkeypatch):
    """Unlike lines that share a long passage passed the letter counts, and each pair of them left the join."""
    rnd, rows = random.Random(23), counted_rows(monkeypatch)
    syllables = ["th", "an", "on", "er", "ti", "re", "s", "ou"]
    line = lambda n: " ".join("".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4))) for _ in range(n))
    passage = line(25)
    lines = [f"{line(25)} {passage}" for _ in range(40)]
    lines += [changed(rnd, lines[i], 8) for i in (3, 30)]
    out = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(frame(spark, lines)).collect()}
    assert [i for i in range(len(lines)) if out[i]] == [40, 41]
    assert rows["rest"][0] < 40  # of some 500


def test_near_copies_are_tied_before_all_pairs_meet(spark, monkeypatch):
    """Copies of one line at similarities about 0.9 were held against one line of a block, then all against all."""
    rnd, rows = random.Random(24), counted_rows(monkeypatch)
    base = [f"{rnd.choice('abcdefgh')}{rnd.randrange(10**5)}" for _ in range(50)]
    lines = [" ".join(w if rnd.random() > 0.055 else f"{rnd.choice('klmnop')}{rnd.randrange(10**5)}" for w in base) for _ in range(120)]
    want, n_pairs = groups_of(lines)
    out = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(frame(spark, lines)).collect()}
    assert [i for i in range(len(lines)) if out[i]] == [i for i, root in enumerate(want) if root != i]
    assert n_pairs > 500 and rows["rest"][0] < 500


def test_windows_tell_no_similar_lines_apart(spark):
    rnd, rows = random.Random(25), []
    for n in (6, 12, 40, 150, 600):
        for k in range(16):
            words = ["".join(rnd.choice("etaoinshrdluñß𝔞") for _ in range(rnd.randrange(1, 9))) for _ in range(n)]
            line = " ".join(words)
            few = int(len(line) * 0.088)
            at = rnd.choice([0, len(line) // 2, len(line)])
            rows.append((line, [changed(rnd, line, few), line[:at] + "x" * few + line[at:], line[few:], line[: len(line) - few]][k % 4]))
    m, n = F.length("x"), F.length("y")
    allowed = line_dedup._allowed(F.greatest(m, n), 0.9)
    df = spark.createDataFrame([(p, q) for p, q in rows if 0.9 * max(len(p), len(q)) <= min(len(p), len(q))], "x string, y string")
    pairs = df.union(df.select("y", "x")).select(line_dedup._apart(F.col("x"), F.col("y"), m, n, allowed, 4000).alias("apart"))
    got = [r.apart for r in pairs.collect()]
    assert len(got) > 100 and not any(got)


def test_cells_are_joined_in_parts(spark, monkeypatch):
    """All cells' rows, each with its line's text, were shuffled at once: the pipeline ran out of disk by that on 0.51 GB."""
    rnd, rows = random.Random(26), counted_rows(monkeypatch)
    base = [f"{rnd.choice('abcdefgh')}{rnd.randrange(10**5)}" for _ in range(50)]
    lines = [" ".join(w if rnd.random() > 0.07 else f"{rnd.choice('klmnop')}{rnd.randrange(10**5)}" for w in base) for _ in range(80)]
    want, _ = groups_of(lines)
    out = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(frame(spark, lines)).collect()}
    assert [i for i in range(len(lines)) if out[i]] == [i for i, root in enumerate(want) if root != i]
    assert len(rows["met"]) == line_dedup.PARTS and all(n < sum(rows["met"]) for n in rows["met"])
