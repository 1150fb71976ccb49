"""Steps whose work or memory grew faster than their rows, and results at odd values."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quillon.functions.expr import average_rank, round_scaled
from quillon.operators import families, metrics, models, pit, retrieval, splits
from quillon.plans import queries


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rounding_is_that_of_the_sql(spark):
    """Scores of six digits that end in 50 were rounded up by their decimals, where the SQL scales the number."""
    x = [(i * 100 + 50) / 1e6 for i in range(3000)] + [-0.00145, 0.0]
    want = [r[0] for r in duckdb.execute("select round(unnest(?), 4)", [x]).fetchall()]
    df = spark.createDataFrame(list(enumerate(x)), "i int, x double")
    assert [r[0] for r in df.orderBy("i").select(round_scaled("x", 4)).collect()] == want
    assert spark.createDataFrame([(None,)], "x double").select(round_scaled("x", 4)).first()[0] is None


def test_widths_are_read_in_one_pass(spark):
    """No frame slides: sums over widths are differences of sums from the first event on."""
    rows = [(f"{i}", "ab"[i % 2], t, i) for i, t in enumerate([1, 1, 5, 6, 6, 9, 14, 15, 15, 40])]
    df = spark.createDataFrame(rows, "sample_id string, item_id string, timestamp long, v int")
    out = pit.visible_sums(df, df.select("sample_id", "item_id", "timestamp"), ["item_id"], {"v": F.col("v"), "half": F.col("v") / 2}, {"w": 9, "all": None})
    for r in out.collect():
        seen = [v for _, item, t, v in rows if item == r.item_id and r.timestamp - 9 < t < r.timestamp]
        assert (r.v_w, r.half_w) == (sum(seen), sum(seen) / 2)
    whole = pit.visible_sums(df, df.select("sample_id", "item_id", "timestamp"), ["item_id"], {"v": F.col("v")}, {"w": 9, "all": None})
    frames = plan_of(whole)
    assert "RangeFrame, -8" not in frames and "unboundedpreceding$(), -9" in frames


@pytest.mark.parametrize("descending", [True, False])
def test_average_ranks_of_ties_nulls_and_nan(spark, descending):
    values = [3.0, None, 1.0, 3.0, float("nan"), None, 2.0, 3.0]
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate(values)] + [("h", 9, None)], "g string, i int, v double")
    got = {r.i: r.r for r in df.select("i", average_rank("v", ["g"], descending).alias("r")).collect()}
    want = [3.0, 7.5, 6.0, 3.0, 1.0, 7.5, 5.0, 3.0] if descending else [6.0, 1.5, 3.0, 6.0, 8.0, 1.5, 4.0, 6.0]
    assert [got[i] for i in range(8)] == want and got[9] == 1.0


def test_ranks_share_one_sort(spark):
    """Each ranked column had two windows, each of which sorted and held the task's rows again."""
    df = spark.createDataFrame([("s", "g", "u", "i", 1, 1.0, 2)], "sample_id string, group_id string, user_id string, item_id string, timestamp long, read_time double, position int")
    assert plan_of(families.candidate_ranks(df, ["read_time", "position"])).count("Window ") == 1
    assert plan_of(families.past_exposure(df, {"7d": 7, "30d": 30}, True)).count("Window ") == 3


def test_quantiles_without_a_table_of_all_values(spark):
    """percentile() held every distinct time in one task."""
    rnd = random.Random(2)
    for rows in ([rnd.randrange(10**12) for _ in range(301)], [5, 5, 5, 9], [-7, 10**15], [3], [None, 4, 6], []):
        df = spark.createDataFrame([(v,) for v in rows], "timestamp long")
        want = df.agg(F.expr("percentile(timestamp, array(0.7, 0.85))")).first()[0] or [None, None]
        assert splits.exact_quantiles(df, "timestamp", [0.7, 0.85], 16) == list(want)
        assert "percentile" not in plan_of(splits.quantile_split(df))


def sessions(spark, seed=4):
    """Events of few items, so that a trigger has more edges than are joined and sessions have edges of their own."""
    rnd = random.Random(seed)
    rows = [(f"e{u:02d}-{t:02d}", f"u{u}", f"u{u}", f"i{min(rnd.randrange(40), rnd.randrange(40)):02d}", 100 * t, t) for u in range(40) for t in range(30)]
    seq = spark.createDataFrame(rows, "event_id string, session_id string, user_id string, item_id string, timestamp long, step int")
    return seq, retrieval.retrieval_queries(seq).where("timestamp > 2500")


@pytest.mark.parametrize("own", [False, True])
def test_bounded_edges_give_the_lists_of_all_edges(spark, own, monkeypatch):
    seq, q = sessions(spark)
    kept, stored = {}, retrieval.stored
    monkeypatch.setattr(retrieval, "stored", lambda df, label, **k: kept.setdefault(label, stored(df, label, **k)))
    edges, mine = retrieval.transitions(seq), retrieval.transitions(seq, True)
    got = retrieval.transition_recall(q, edges, 4, mine if own else None)
    n = {(r.src, r.dst): r.n for r in edges.collect()}
    less = {(r.session_id, r.src, r.dst): r.n for r in mine.collect()} if own else {}
    lists = {}
    for r in got.orderBy("query_id", "rank").collect():
        lists.setdefault(r.query_id, []).append((r.item_id, r.score))
    import math

    for r in q.collect():
        best = {}
        for back, src in enumerate(reversed(r.history[-5:])):
            for (a, b), c in n.items():
                c -= less.get((r.session_id, a, b), 0)
                if a == src and c > 0 and b not in r.history:
                    best[b] = max(best.get(b, 0), round(math.log1p(c) / (back + (1 if own else 2)), 6))
        assert lists.get(r.query_id, []) == sorted(best.items(), key=lambda x: (-x[1], x[0]))[:4]
    # Not all edges of a trigger are joined.
    assert kept["best-edges"].count() < 5 * len(n)


def test_lists_are_filled_without_a_row_for_each_hot_item(spark):
    q = spark.createDataFrame([("a", ["h1", "x"]), ("b", ["y"])], "query_id string, history array<string>")
    ranked = spark.createDataFrame([("a", "h2", 2), ("a", "z", 1)], "query_id string, item_id string, rank int")
    hot = spark.createDataFrame([(f"h{i}", i) for i in range(1, 9)], "item_id string, rank int")
    out = {}
    for r in retrieval.fill_to_k(ranked, q, hot, 4).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.item_id, r.rank, r.filled))
    assert out == {"a": [("z", 1, False), ("h2", 2, False), ("h3", 3, True), ("h4", 4, True)], "b": [(f"h{i}", i, True) for i in range(1, 5)]}


def test_the_events_are_read_once_for_a_pool(spark, sf, monkeypatch):
    """Each channel, the pool and the number of queries made events, split and queries anew."""
    seen, sequence = [], queries.R.sequence
    monkeypatch.setattr(queries.R, "sequence", lambda *a: seen.append(a) or sequence(*a))
    queries.rank_metrics_ablation(spark, sf)
    assert len(seen) == 1


def test_ablation_does_not_sort_the_pool_for_each_variant(spark):
    rows = [("a", "i1", 1, None, "i2"), ("a", "i2", 2, 1, "i2"), ("a", "i3", None, 2, "i2"), ("b", "i1", 1, None, "i1"), ("c", "i1", 1, 1, "i9")]
    pool = spark.createDataFrame(rows, "query_id string, item_id string, x int, y int, target string")
    out = metrics.channel_ablation(pool, ["x", "y"], "query_id", "target", 1, 4)
    assert plan_of(out).count("Window ") == 1
    assert {r.variant: r.recall_1 for r in out.collect()} == {"only_x": 0.25, "only_y": 0.25, "without_x": 0.25, "without_y": 0.25, "all": 0.5}


@pytest.mark.parametrize("name", ["lr", "fm"])
def test_a_model_is_fitted_on_rows_written_once(spark, sf, name, monkeypatch):
    """Each pass of a fit joined orders, lines and parts anew."""
    plans, fitted = [], models.fitted
    monkeypatch.setattr(models, "fitted", lambda x, *a: plans.append(plan_of(x)) or fitted(x, *a))
    out = queries.queries()[f"{name}_scores"](spark, sf)
    assert len(plans) == 1 and "Join" not in plans[0] and out.count() > 0
