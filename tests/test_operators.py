"""Hand-computed results, causality, and refusals."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon import provenance
from quillon.functions.expr import last_n, rank_pct
from quillon.operators import families, metrics, models, pit, profiles, retrieval, splits
from quillon.plans import relations
from quillon.sources import readers


def impressions(spark):
    rows = [(i, f"u{i % 2}", [10, 20, 30], [10] if i % 2 else [20]) for i in range(8)]
    return spark.createDataFrame(rows, "impression_id int, user_id string, shown array<int>, clicked array<int>")


def test_explode_keeps_positions_and_labels(spark):
    got = splits.explode_impressions(impressions(spark), "shown", "clicked")
    assert got.count() == 24 and got.agg(F.sum("label")).first()[0] == 8
    assert {(r.position, r.item_id) for r in got.collect()} == {(0, "10"), (1, "20"), (2, "30")}


def test_candidate_faults(spark):
    df = spark.createDataFrame([(1, [], []), (2, [1, 1], []), (3, [1], [2]), (4, [1, 2], [2]), (5, None, None)], "id int, s array<int>, c array<int>")
    assert {r.id: r.fault for r in splits.candidate_faults(df, "s", "c").collect()} == {1: "empty", 2: "repeated", 3: "unseen click", 5: "empty"}


def test_stable_negative_is_the_digest(spark):
    got = {r.impression_id: r.negative for r in splits.stable_negative(impressions(spark), "impression_id", "shown", "clicked").collect()}
    for i, n in got.items():
        left = [20, 30] if i % 2 else [10, 30]
        assert n == left[int.from_bytes(hashlib.blake2b(str(i).encode(), digest_size=8).digest(), "little") % 2]


def sample_rows(spark, rows):
    return spark.createDataFrame(rows, "sample_id string, group_id string, user_id string, item_id string, timestamp long, label int, policy string, scene string")


def test_validation_refuses(spark):
    good = sample_rows(spark, [("a", "g", "u", "i", 1, 1, "standard", "s"), ("b", "g", "u", "j", 1, 0, "standard", "s")])
    assert splits.require_valid(good) is good
    for rows in ([("a", "g", "u", "i", 1, 1, "p", "s"), ("a", "g", "u", "j", 1, 0, "p", "s")], [("a", "g", "u", "i", 1, 2, "p", "s")], [("a", "g", " ", "i", 1, 1, "p", "s")], [("a", "g", "u", "i", 1, 1, "p", "s"), ("b", "g", "v", "i", 1, 1, "p", "s")], []):
        with pytest.raises(ValueError):
            splits.require_valid(sample_rows(spark, rows))


def test_split_boundaries(spark):
    df = sample_rows(spark, [(str(t), str(t), "u", "i", t, 1, p, "s") for t in (0, 10, 20, 30) for p in ("standard",)] + [("r", "r", "u", "i", 5, 1, "random", "s"), ("q", "q", "u", "i", 25, 1, "random", "s")])
    got = {r.sample_id: r.split for r in splits.temporal_split(df, 0, 10, 20, 30).collect()}
    assert got == {"0": "train", "10": "validation", "20": "test", "30": None, "r": None, "q": "test"}
    with pytest.raises(ValueError):
        splits.temporal_split(df, 0, 0, 1, 2)


def test_metrics_on_ties(spark):
    rows = [("g1", "2", 1, 0.8), ("g1", "1", 0, 0.8), ("g1", "4", 1, 0.2), ("g1", "3", 0, 0.2), ("g2", "7", 0, 0.5), ("g2", "5", 1, 0.5), ("g2", "6", 0, 0.1)]
    df = spark.createDataFrame(rows, "group_id string, sample_id string, label int, score double")
    got = metrics.group_metrics(df).agg(F.avg("auc"), F.avg("mrr")).first()
    assert got[0] == pytest.approx(0.625) and got[1] == pytest.approx(((1 / 2 + 1 / 4) / 2 + 1) / 2)


def test_multi_click_and_one_class(spark):
    df = spark.createDataFrame([("g", "1", 1, 0.9), ("g", "2", 0, 0.8), ("g", "3", 1, 0.7)], "group_id string, sample_id string, label int, score double")
    r = metrics.group_metrics(df).first()
    assert (r.auc, r.mrr) == (0.5, pytest.approx((1 + 1 / 3) / 2))
    one = spark.createDataFrame([(1, 0.5), (1, 0.5)], "label int, score double")
    assert metrics.binary_metrics(one).first().auc is None


def test_rank_pct(spark):
    df = spark.createDataFrame([("g", 3.0), ("g", 2.0), ("g", 1.0)], "g string, v double")
    assert [r[0] for r in df.select(rank_pct("v", ["g"]).alias("r")).orderBy("r").collect()] == pytest.approx([1 / 3, 2 / 3, 1])


def test_last_n(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([1],), ([],)], "a array<int>")
    assert [r[0] for r in df.select(last_n("a", 2)).collect()] == [[2, 3], [1], []]


def test_simultaneous_events_are_invisible(spark):
    df = sample_rows(spark, [(str(i), str(i), "u", "x", t, 1, "standard", "s") for i, t in enumerate((100, 100, 200, 1100))])
    got = {r.sample_id: r for r in pit.visible_sums(df, df.select("sample_id", "item_id", "timestamp"), ["item_id"], {"n": F.lit(1)}, {"w": 1000, "all": None}).collect()}
    assert [(got[str(i)].n_w, got[str(i)].n_all) for i in range(4)] == [(0, 0), (0, 0), (2, 2), (1, 3)]


def test_future_labels_change_nothing(spark, sf):
    x = relations.samples(spark, sf)
    cut = relations.TEST_START
    flipped = x.withColumn("label", F.when(F.col("timestamp") >= cut, 1 - F.col("label")).otherwise(F.col("label")))
    for f in (families.interaction_features, families.long_term_profile, families.topic_affinity):
        a, b = (f(y, relations.INTERVAL, relations.DELAY, cut) for y in (x, flipped))
        assert a.exceptAll(b).isEmpty()


def test_random_clicks_are_no_history(spark):
    rows = [("0", "0", "u", "a", 100, 1, "standard", "s"), ("1", "1", "u", "b", 200, 1, "random", "s"), ("2", "2", "u", "c", 300, 0, "standard", "s"), ("3", "3", "u", "d", 1100, 1, "standard", "s")]
    got = {r.sample_id: r.history for r in families.visible_history(sample_rows(spark, rows), 2, 1, 0).collect()}
    assert got == {"0": "", "1": "a", "2": "a", "3": "a"}


def test_same_second_basket(spark):
    seq = spark.createDataFrame([("a", "u", "u", "1", 1000, 1), ("b", "u", "u", "2", 2000, 2), ("c", "u", "u", "3", 2000, 3)], "event_id string, session_id string, user_id string, item_id string, timestamp long, step int")
    strict = {r.query_id: r.history for r in retrieval.retrieval_queries(seq).collect()}
    assert strict == {"b": ["1"], "c": ["1"]}
    assert {r.query_id: r.history for r in retrieval.retrieval_queries(seq, strict=False).collect()}["c"] == ["1", "2"]


def test_purchases_make_the_expected_queries(spark):
    buys = spark.createDataFrame([(1, s, f"2020-01-0{i}") for i, s in enumerate((10, 20, 10, 30, 40, 50), 1)], "client_id long, sku long, timestamp string")
    seq = readers.purchase_events(buys)
    got = {r.target: r.history for r in retrieval.retrieval_queries(seq).collect()}
    assert got["30"] == ["10", "20", "10"] and got["50"] == ["10", "20", "10", "30", "40"]
    assert seq.agg(F.min("timestamp")).first()[0] == 1577836800000


def test_nested_sessions(spark):
    talk = [("user", "hi", 1), ("music", "a", 1), ("assistant", "ok", 1), ("music", "b", 2)]
    s = spark.createDataFrame([("s", "u", "2020-01-01", talk)], "session_id string, user_id string, session_date string, conversations array<struct<role:string,content:string,turn_number:int>>")
    cat = spark.createDataFrame([("a",), ("b",)], "track_id string")
    assert [r.item_id for r in readers.session_events(s, cat).orderBy("step").collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        readers.session_events(s, cat.where("track_id = 'a'"))


def test_exposure_log_checks(spark):
    logs = spark.createDataFrame([("u", "1", 5, 1, 0, 0), ("u", "1", 5, 1, 0, 0), ("u", "2", 6, 0, 1, 0)], readers.EXPOSURE_SCHEMA)
    assert readers.exposure_log(logs).select("sample_id").distinct().count() == 3
    with pytest.raises(ValueError):
        readers.exposure_log(logs.withColumn("is_rand", F.lit(2)))
    with pytest.raises(ValueError):
        readers.adapter("nothing")


def test_dense_recall_equals_brute_force(spark):
    m = np.random.default_rng(0).normal(size=(60, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vector array<float>")
    got = retrieval.dense_recall(df.where("id % 10 = 0"), df, 5, block=2)
    unit = m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    for q in range(0, 60, 10):
        s = np.round(unit @ unit[q], 6)
        want = [i for i in sorted(range(60), key=lambda i: (-s[i], i)) if i != q][:5]
        assert [r.item_id for r in got.where(F.col("query_id") == q).orderBy("rank").collect()] == want


def test_models_beat_nothing(spark, sf):
    x = relations.with_split(relations.samples(spark, sf)).where("split is not null")
    for name in ("lr", "gbt"):
        out = models.scored(x, models.fitted(x, name, ["position", "read_time"], ["category"]))
        assert out.where("score < 0 or score > 1 or score is null").isEmpty()


def test_profile_of_no_events(spark):
    e = spark.createDataFrame([(1, "buy", 100, 2.0, 3)], "client_id long, action string, seconds long, price double, category int")
    r = {x.client_id: x for x in profiles.profile(e, spark.createDataFrame([(1,), (2,)], "client_id long"), 200).collect()}
    assert r[2].buy_count == 0 and r[1].buy_count == pytest.approx(0.6931, abs=1e-4)


def test_streams_equal_batches(spark, sf, tmp_path):
    from quillon.streaming import exposure

    out = exposure.run_once(exposure.sliding_exposure(exposure.event_stream(spark, sf), 3_600_000), "append")
    x = relations.exposures(spark, sf)
    want = pit.visible_sums(x, x.select("sample_id", "item_id", "timestamp"), ["item_id"], {"n": F.lit(1)}, {"w": 3_600_000})
    a = {(f"event:{r.event_id}", r.n_before) for r in out.collect()}
    assert a == {(r.sample_id, r.n_w) for r in want.collect()}
    assert exposure.run_once(exposure.sessions(exposure.event_stream(spark, sf)), "append").count() > 0


def test_manifests(spark, tmp_path):
    df = spark.range(10).withColumnRenamed("id", "timestamp")
    path = str(tmp_path / "t")
    m = provenance.write_frame(df, path)
    assert m["rows"] == 10 and provenance.verified(spark, path).count() == 10
    with pytest.raises(Exception):  # noqa: B017
        provenance.write_frame(df, path)
    spark.range(11).withColumnRenamed("id", "timestamp").write.mode("overwrite").parquet(path)
    with pytest.raises(ValueError):
        provenance.verified(spark, path)


def test_runs_and_report(tmp_path):
    with provenance.run(tmp_path / "a", {"seed": 1}) as m:
        (tmp_path / "a" / "metrics.json").write_text(json.dumps({"test": {"auc": 0.5}}))
        m["artifacts"]["metrics.json"] = ""
    rows = provenance.report([tmp_path / "a"], tmp_path / "r.csv")
    assert rows[0]["test.auc"] == 0.5
    (tmp_path / "a" / "metrics.json").write_text("{}")
    with pytest.raises(ValueError):
        provenance.report([tmp_path / "a"], tmp_path / "s.csv")
    with pytest.raises(RuntimeError), provenance.run(tmp_path / "b", {}):
        raise RuntimeError
    assert json.loads((tmp_path / "b" / "manifest.json").read_text())["status"] == "failed"


def test_score_merge():
    assert provenance.merged_scores([{"a": 0.5, "placeholder": -1}, {"b": 0.6}], ["a", "b"]) == {"a": 0.5, "b": 0.6}
    for files in ([{"a": 1}, {"a": 1}], [{"a": 1}], [{"a": float("nan"), "b": 1}]):
        with pytest.raises(ValueError):
            provenance.merged_scores(files, ["a", "b"])


def test_npy_source(spark, tmp_path):
    np.save(tmp_path / "v.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    got = readers.npy_vectors(spark, str(tmp_path / "v.npy")).orderBy("row").collect()
    assert [r.vector for r in got] == [[0, 1], [2, 3], [4, 5]]


def test_new_refusals_and_checks(spark):
    ok = spark.createDataFrame([("a", "s1", 1, 0.5), ("a", "s2", 0, 0.1)], "group_id string, sample_id string, label int, score double")
    assert metrics.require_scores(ok) is ok
    for bad in (ok.withColumn("score", F.lit(1.5)), ok.withColumn("score", F.lit(float("nan"))), ok.withColumn("label", F.lit(2)), ok.limit(0)):
        with pytest.raises(ValueError):
            metrics.require_scores(bad)
    one = ok.union(spark.createDataFrame([("b", "s3", 1, 0.5)], ok.schema))
    assert metrics.impression_metrics(one, []).first().n_groups == 1
    with pytest.raises(ValueError):
        metrics.impression_metrics(one, [], strict=True)
    assert {r.group_id: r.ndcg for r in metrics.group_ndcg(one.withColumn("label", 1 - F.col("label"))).collect()} == {"a": round(1 / np.log2(3), 6), "b": 0.0}
    assert metrics.propensity_score(1, 1, 1) == pytest.approx(1)


def test_column_and_time_checks(spark):
    df = spark.createDataFrame([("2020-01-01 00:00:00", None, 1), (None, None, 2)], "t string, x_7d int, y_30d int")
    assert splits.all_null_columns(df) == ["x_7d"] and splits.columns_like(df, ["_30d", "d"]) == ["y_30d", "x_7d"]
    assert str(splits.strict_timestamps(df, "t").first().t) == "2020-01-01 00:00:00"
    for column in ("x_7d", "z"):
        with pytest.raises(ValueError):
            splits.strict_timestamps(df.withColumn("z", F.lit("2020/01/01")), column)
    with pytest.raises(ValueError):
        splits.require_disjoint(df, df, "y_30d")
    splits.require_disjoint(df, df.withColumn("y_30d", F.lit(9)), "y_30d")


def test_snapshots_predictions_and_trials(spark):
    x = spark.createDataFrame([("u", 1), ("v", 1)], "user_id string, t int")
    snaps = spark.createDataFrame([(1, "u", [3])], "period int, user_id string, history array<int>")
    assert {r.user_id: r.history for r in splits.period_snapshot(x, snaps, F.col("t")).collect()} == {"u": [3], "v": []}
    with pytest.raises(ValueError):
        splits.period_snapshot(x, snaps, F.col("t"), strict=True)
    lists = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 2)], "query_id string, item_id int")
    truth = spark.createDataFrame([("b",), ("c",)], "query_id string")
    assert splits.prediction_faults(lists, truth, 2).first().asDict() == {"n_queries": 2, "missing": 1, "unknown": 1, "repeated": 1, "not_k": 1}
    trials = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", 0.1)], "trial string, ndcg double")
    assert models.best_trial(trials, "ndcg").first().trial == "a"
    names = ["query_id", "rank_hot", "score_hot", "minmax_hot", "z_hot", "agreement_top10"]
    assert models.feature_columns(names, True) == ["rank_hot", "score_hot"] and len(models.feature_columns(names, False)) == 5
    odd = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [1.0]), (5, None), (1, [3.0, 4.0])], "id int, v array<double>")
    assert {r.id: (r.n_rows, r.usable) for r in profiles.usable_vectors(odd, "id", "v", 2).collect()} == {1: (2, True), 2: (1, False), 3: (1, False), 4: (1, False), 5: (1, False)}
