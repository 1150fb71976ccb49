"""Config-driven runs: prepare samples, split, features, model, metrics, predictions and manifest in one folder."""

from __future__ import annotations

import json
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import provenance
from .operators import families, metrics, models, retrieval, splits

#: Feature families by config toggle: name -> (samples, config) -> features by sample_id.
FAMILIES = {
    "context_features": lambda s, c: families.context_features(s, F.col("split") == "train"),
    "interaction_features": lambda s, c: families.interaction_features(s, c["update_interval_ms"], c["feedback_delay_ms"], frozen_at(c)),
    "relative_temporal_features": lambda s, c: families.relative_freshness(s),
    "long_term_user_features": lambda s, c: families.long_term_profile(s, c["update_interval_ms"], c["feedback_delay_ms"], frozen_at(c)),
    "topic_affinity_features": lambda s, c: families.topic_affinity(s, c["update_interval_ms"], c["feedback_delay_ms"], frozen_at(c)),
    "candidate_statistical_ranks": lambda s, c: families.candidate_ranks(s, c.get("rank_sources", ["position"])),
    "session_exposure_features": lambda s, c: families.session_exposure(s),
    "past_candidate_exposure_features": lambda s, c: families.past_exposure(s, c.get("exposure_windows", {"5m": 300_000, "1h": 3_600_000}), c.get("exposure_momentum", False)),
    "past_candidate_engagement_features": lambda s, c: families.past_engagement(s, c.get("exposure_windows", {"5m": 300_000, "1h": 3_600_000})),
}


def frozen_at(config: dict) -> int | None:
    """The validation start under frozen feedback, none under delayed replay; nothing else is known."""
    mode = config.get("evaluation_feedback", "frozen")
    if mode not in ("frozen", "delayed_replay"):
        raise ValueError(f"unknown evaluation_feedback {mode!r}")
    return config["validation_start"] if mode == "frozen" else None


def boundary(value) -> int:
    """Epoch milliseconds of a boundary: a number, or an ISO time with its offset from UTC."""
    if isinstance(value, (int, float)):
        return int(value)
    from datetime import datetime

    t = datetime.fromisoformat(value.replace("Z", "+00:00"))
    if t.tzinfo is None:
        raise ValueError(f"{value!r} names no offset from UTC")
    return int(t.timestamp() * 1000)


def split_samples(samples: DataFrame, config: dict) -> DataFrame:
    """Samples with their split, or ValueError if one is empty or training has one class."""
    out = splits.temporal_split(samples, *(config[k] for k in ("train_start", "validation_start", "test_start", "test_end"))).where("split is not null")
    got = {r["split"]: (r["n"], r["p"]) for r in out.groupBy("split").agg(F.count("*").alias("n"), F.sum("label").alias("p")).collect()}
    missing = {"train", "validation", "test"} - set(got)
    if missing or not 0 < got["train"][1] < got["train"][0]:
        raise ValueError(f"empty splits {sorted(missing)} or one training class")
    return out


def feature_frame(samples: DataFrame, config: dict) -> tuple[DataFrame, list[str]]:
    """Samples joined with the switched-on families, in fixed order, and the names of their columns."""
    on = [f for f in FAMILIES if config.get(f)]
    parts = [FAMILIES[f](samples, config) for f in on]
    names = [c for p in parts for c in p.columns if c != "sample_id"]
    return reduce(lambda a, b: a.join(b, "sample_id", "left"), parts, samples), names


def run(spark, prepared: str, output: str, config: dict) -> dict:
    """Fit and evaluate `config['model']` (popularity, lr, fm or gbt) on prepared samples; returns the metrics."""
    config = config | {k: boundary(config[k]) for k in ("train_start", "validation_start", "test_start", "test_end")}
    with provenance.run(output, config) as manifest:
        samples = split_samples(splits.require_valid(provenance.verified(spark, prepared)), config)
        manifest["data"] = provenance.frame_digest(samples)
        if config["model"] == "popularity":
            scored = models.popularity(samples)
        else:
            frame, names = feature_frame(samples, config)
            numeric = names + [c for c in config.get("numeric", []) if c in samples.columns]
            categorical = [c for c in config.get("categorical", ["scene"]) if c in samples.columns]
            scored = models.scored(frame, models.fitted(frame, config["model"], numeric or ["timestamp"], categorical, seed=config.get("seed", 42)))
        keep = ["sample_id", "group_id", "user_id", "item_id", "label", "policy", "scene", "split", "score"]
        scored.where("split <> 'train'").select(*keep).write.mode("errorifexists").parquet(f"{output}/predictions")
        back = spark.read.parquet(f"{output}/predictions")
        out = {}
        for r in metrics.binary_metrics(back, ["split"]).collect():
            out.setdefault(r["split"], {})["binary"] = {k: r[k] for k in ("n_rows", "positives", "auc", "log_loss")}
        for r in metrics.impression_metrics(back, ["split"]).collect():
            out[r["split"]]["impression"] = {k: r[k] for k in ("n_groups", "auc", "mrr", "ndcg5", "ndcg10")}
        provenance.write_json(Path(output) / "metrics.json", out)
        manifest["artifacts"] = {"predictions": "", "metrics.json": ""}
    return out


def run_retrieval(spark, events: DataFrame, config: dict) -> dict:
    """Hot and item-CF recall over quantile splits: recall, MRR and distinct items at k for validation and test."""
    k = config.get("k", 20)
    labelled = splits.quantile_split(events, config.get("train_fraction", 0.7), config.get("validation_fraction", 0.85))
    train = labelled.where("split = 'train'")
    queries = splits.quantile_split(retrieval.retrieval_queries(events, strict=config.get("strict", True)))
    hot, near, out = retrieval.hot_items(train), retrieval.item_cf(train, config.get("neighbor_size", 20)), {}
    for part in ("validation", "test"):
        q = queries.where(F.col("split") == part)
        q = splits.even_sample(q, ["timestamp", "query_id"], config["max_queries_per_split"]) if config.get("max_queries_per_split") else q
        none = retrieval.trigger_recall(q, near.where("false"), k)
        for name, channel in (("hot", none), ("i2i_hot", retrieval.trigger_recall(q, near, k))):
            row = metrics.target_metrics(retrieval.fill_to_k(channel, q, hot, k), q, k).first()
            out.setdefault(part, {})[name] = row.asDict()
    return out


def load_config(path: str) -> dict:
    return json.loads(Path(path).read_text())
