"""Projections, validation, negative sampling, splits and folds."""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import MS_DAY

REQUIRED = ("sample_id", "group_id", "user_id", "item_id", "timestamp", "label", "policy", "scene")


def explode_impressions(impressions: DataFrame, items: str = "article_ids_inview", clicked: str = "article_ids_clicked") -> DataFrame:
    """A row for each candidate: its position, the size of its list, and whether it was clicked."""
    keep = [c for c in impressions.columns if c not in (items, clicked)]
    x = impressions.select(*keep, F.size(items).alias("candidate_count"), clicked, F.posexplode(items).alias("position", "item"))
    return x.withColumn("label", F.coalesce(F.array_contains(clicked, F.col("item")), F.lit(False)).cast("int")).withColumn("item_id", F.col("item").cast("string")).drop("item", clicked)


def candidate_faults(impressions: DataFrame, items: str = "article_ids_inview", clicked: str = "article_ids_clicked") -> DataFrame:
    """Impressions that are empty, repeat a candidate, or click one that was not shown, with the fault."""
    fault = (
        F.when(F.coalesce(F.size(items), F.lit(0)) <= 0, "empty")
        .when(F.size(F.array_distinct(items)) != F.size(items), "repeated")
        .when(F.size(F.array_except(F.coalesce(clicked, F.array().cast(impressions.schema[clicked].dataType)), F.col(items))) > 0, "unseen click")
    )
    return impressions.withColumn("fault", fault).where("fault is not null")


def validation_report(samples: DataFrame) -> DataFrame:
    """One row of counts; a valid relation has rows and otherwise zeros."""
    blank = F.greatest(*[(F.trim(F.col(c)) == "").cast("int") for c in ("sample_id", "group_id", "user_id", "item_id")])
    nulls = F.greatest(*[F.col(c).isNull().cast("int") for c in REQUIRED])
    rows = samples.agg(
        F.count("*").alias("n_rows"), F.sum(nulls).alias("null_rows"), F.sum(blank).alias("blank_ids"),
        F.sum((~F.col("label").isin(0, 1)).cast("int")).alias("bad_labels"), (F.count("sample_id") - F.count_distinct("sample_id")).alias("repeated_ids"),
    )
    mixed = samples.groupBy("group_id").agg(F.min(F.struct("timestamp", "user_id", "policy")).alias("a"), F.max(F.struct("timestamp", "user_id", "policy")).alias("b"))
    return rows.crossJoin(mixed.agg(F.coalesce(F.sum((F.col("a") != F.col("b")).cast("int")), F.lit(0)).alias("mixed_groups")))  # one row by one row


def require_valid(samples: DataFrame) -> DataFrame:
    """The samples, or ValueError naming what is wrong."""
    missing = set(REQUIRED) - set(samples.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    row = validation_report(samples).first().asDict()
    bad = {k: v for k, v in row.items() if k != "n_rows" and v} | ({"n_rows": 0} if not row["n_rows"] else {})
    if bad:
        raise ValueError(f"invalid samples: {bad}")
    return samples


def stable_negative(impressions: DataFrame, key: str, items: str, clicked: str) -> DataFrame:
    """Adds `negative`: one unclicked candidate, by BLAKE2b-64 of the key modulo their number (null if none)."""

    @F.pandas_udf("long")
    def draw(keys: pd.Series, sizes: pd.Series) -> pd.Series:
        digest = (int.from_bytes(hashlib.blake2b(str(k).encode(), digest_size=8).digest(), "little") for k in keys)
        return pd.Series([d % n if n else 0 for d, n in zip(digest, sizes, strict=True)])

    left = F.filter(F.col(items), lambda x: ~F.coalesce(F.array_contains(F.col(clicked), x), F.lit(False)))
    x = impressions.withColumn("_left", left).withColumn("_at", draw(F.col(key).cast("string"), F.size("_left")))
    return x.withColumn("negative", F.get("_left", F.col("_at").cast("int"))).drop("_left", "_at")


def sampled_groups(frame: DataFrame, key: str, mod: int, remainder: int) -> DataFrame:
    """Whole groups whose hash leaves the remainder: a reproducible sample."""
    if not 0 <= remainder < mod:
        raise ValueError("remainder outside the modulus")
    return frame.where(F.pmod(F.xxhash64(key), F.lit(mod)) == remainder)


def temporal_split(frame: DataFrame, train: int, validation: int, test: int, end: int) -> DataFrame:
    """Adds `split` by half-open intervals; random traffic trains and validates nothing but stays in the test."""
    if not train < validation < test < end:
        raise ValueError("boundaries must ascend")
    t, usual = F.col("timestamp"), F.col("policy") != "random"
    label = F.when((t >= train) & (t < validation) & usual, "train").when((t >= validation) & (t < test) & usual, "validation").when((t >= test) & (t < end), "test")
    return frame.withColumn("split", label)


def exact_quantiles(frame: DataFrame, by: str, shares: list[float], parts: int = 4096) -> list[float | None]:
    """Interpolated quantiles of a column of whole numbers, as percentile() gives them.

    percentile() holds every distinct value in one task. Here a range is counted in `parts` parts, then the part with the
    wanted place, until one value is left: the driver sees `parts` counts at a time.
    """
    n, low, high = frame.agg(F.count(by), F.min(by), F.max(by)).first()
    if not n:
        return [None] * len(shares)
    at = [(n - 1) * s for s in shares]
    ranges = {place: (place, low, high) for p in at for place in (math.floor(p), math.ceil(p))}
    while wide := {(lo, hi) for _, lo, hi in ranges.values() if lo < hi}:
        counts = {}
        for lo, hi in wide:
            width = (hi - lo) // parts + 1
            part = F.floor((F.col(by) - lo) / width) if hi - lo < 1 << 53 else F.expr(f"({by} - {lo}L) div {width}L")
            counts[lo, hi] = width, sorted(frame.where(F.col(by).between(lo, hi)).groupBy(part.alias("part")).count().collect())
        for place, (left, lo, hi) in ranges.items():
            if lo < hi:
                width, rows = counts[lo, hi]
                for part, c in rows:
                    if left < c:
                        break
                    left -= c
                ranges[place] = left, lo + part * width, min(hi, lo + (part + 1) * width - 1)
    value = lambda place: ranges[place][1]
    out = []
    for p in at:
        a, b = math.floor(p), math.ceil(p)
        out.append(float(value(a)) if value(a) == value(b) else (b - p) * value(a) + (p - a) * value(b))
    return out


def quantile_split(frame: DataFrame, low: float = 0.7, high: float = 0.85, by: str = "timestamp") -> DataFrame:
    """Adds `split` by two interpolated quantiles of a column; those of whole numbers are found first, in several passes over it."""
    if frame.schema[by].dataType.typeName() in ("long", "integer", "short", "byte"):
        q = [F.lit(v).cast("double") for v in exact_quantiles(frame.select(by), by, [low, high])]
    else:
        cut = frame.agg(F.expr(f"percentile({by}, array({low}, {high}))").alias("q"))
        frame = frame.crossJoin(F.broadcast(cut))  # one row
        q = [F.col("q")[0], F.col("q")[1]]
    label = F.when(F.col(by) < q[0], "train").when(F.col(by) < q[1], "validation").otherwise("test")
    return frame.withColumn("split", label).drop("q")


def source_split(frame: DataFrame, held: Column, fraction: float = 0.8, by: str = "timestamp") -> DataFrame:
    """Adds `split`: held rows are the test; the others train below an interpolated quantile of their own, else validate."""
    cut = frame.where(~held).agg(F.expr(f"percentile({by}, {fraction})").alias("_q"))
    label = F.when(held, "test").when(F.col(by) < F.col("_q"), "train").otherwise("validation")
    return frame.crossJoin(F.broadcast(cut)).withColumn("split", label).drop("_q")  # one row


def split_audit(frame: DataFrame, keys: list[str], split: str = "split") -> DataFrame:
    """For each key: its values, those found in several splits, and rows without a split; a clean split shares none."""
    parts = []
    for k in keys:
        seen = frame.groupBy(F.col(k).cast("string").alias("_v")).agg(F.count_distinct(split).alias("_n"), F.count_if(F.col(split).isNull()).alias("_u"))
        parts.append(seen.agg(F.lit(k).alias("key"), F.count("*").alias("n_values"), F.count_if(F.col("_n") > 1).alias("shared"), F.coalesce(F.sum("_u"), F.lit(0)).alias("unassigned_rows")))
    return reduce(DataFrame.unionByName, parts).select("key", "n_values", "shared", "unassigned_rows")


def require_disjoint(a: DataFrame, b: DataFrame, key: str) -> None:
    """ValueError if the frames have a value of the key in common."""
    if not a.join(b, key, "left_semi").isEmpty():
        raise ValueError(f"{key} in both frames")


def prediction_faults(predicted: DataFrame, truth: DataFrame, k: int, key: str = "query_id", item: str = "item_id") -> DataFrame:
    """One row of counts: queries without a list, lists without a query, lists with a repeated item, lists not of k items."""
    lists = predicted.groupBy(key).agg(F.count("*").alias("_n"), F.count_distinct(item).alias("_d"))
    x = truth.select(key, F.lit(1).alias("_t")).distinct().join(lists, key, "full")
    return x.agg(
        F.count_if(F.col("_t").isNotNull()).alias("n_queries"), F.count_if(F.col("_n").isNull()).alias("missing"), F.count_if(F.col("_t").isNull()).alias("unknown"),
        F.count_if(F.col("_d") < F.col("_n")).alias("repeated"), F.count_if(F.col("_d") != k).alias("not_k"),
    )


def all_null_columns(frame: DataFrame) -> list[str]:
    """Columns without any value, in order, from one pass."""
    row = frame.agg(*[F.count(F.col(f"`{c}`")).alias(str(i)) for i, c in enumerate(frame.columns)]).first()
    return [c for i, c in enumerate(frame.columns) if not row[i]]


def columns_like(frame: DataFrame, endings: list[str]) -> list[str]:
    """Columns that end in one of the endings, each once, by ending and then in order."""
    return list(dict.fromkeys(c for e in endings for c in frame.columns if c.endswith(e)))


def strict_timestamps(frame: DataFrame, column: str, pattern: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """The column as timestamps; ValueError if a value is set but doesn't follow the pattern."""
    if dict(frame.dtypes)[column].startswith("timestamp"):
        return frame
    if dict(frame.dtypes)[column] != "string":
        raise ValueError(f"{column} holds neither text nor timestamps")
    at = F.try_to_timestamp(F.col(column), F.lit(pattern))
    if not frame.where(F.col(column).isNotNull() & at.isNull()).isEmpty():
        raise ValueError(f"{column} has values outside {pattern}")
    return frame.withColumn(column, at)


def vocabulary_size(frame: DataFrame, *arrays: str) -> DataFrame:
    """One more than the greatest id in any of the array columns (1 for none)."""
    top = F.greatest(*[F.coalesce(F.array_max(c), F.lit(0)) for c in arrays]) if len(arrays) > 1 else F.coalesce(F.array_max(arrays[0]), F.lit(0))
    return frame.agg((F.coalesce(F.max(top), F.lit(0)) + 1).cast("long").alias("vocabulary"))


def period_snapshot(samples: DataFrame, snapshots: DataFrame, period: Column, strict: bool = False) -> DataFrame:
    """Samples with the history that their user had in their period (period, user_id, history); none is an empty one.

    With `strict`, a user without a snapshot of the period is refused with ValueError.
    """
    x = samples.withColumn("period", period).join(snapshots, ["period", "user_id"], "left")
    if strict and not x.where("history is null").isEmpty():
        raise ValueError("users without a history in their period")
    return x.withColumn("history", F.coalesce("history", F.array().cast(snapshots.schema["history"].dataType)))


def cutoff(interval: int, delay: int, frozen_at: int | None = None) -> Column:
    """The instant before which events are visible: the last update less the delay, capped if frozen."""
    c = F.col("timestamp") - F.pmod(F.col("timestamp"), F.lit(interval)) - delay
    return F.least(c, F.lit(frozen_at - delay)) if frozen_at is not None else c


def user_folds(users: DataFrame, key: str = "user_id", folds: int = 5, seed: int = 0) -> DataFrame:
    """Adds `fold` and `part` (two halves of a fold) by hash of the user: disjoint and reproducible."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key))), 1, 8), 16, 10).cast("long")
    return users.withColumn("fold", (h % folds).cast("int")).withColumn("part", F.when(F.floor(h / folds) % 2 == 0, "cg_val").otherwise("reranker_val"))


def even_sample(frame: DataFrame, order: list[str], m: int) -> DataFrame:
    """m rows spread evenly over an order (all if fewer): places floor(i * (n - 1) / (m - 1)).

    Ranges are numbered by their sizes, so no task holds all rows.
    """
    spark = frame.sparkSession
    n = frame.count()
    if n <= m:
        return frame.withColumn("place", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long")) if n else frame.withColumn("place", F.lit(0).cast("long"))
    want = {(i * (n - 1)) // (m - 1) for i in range(m)} if m > 1 else {0}
    sorted_rows = frame.orderBy(*order)
    numbered = sorted_rows.rdd.zipWithIndex().map(lambda x: (*x[0], x[1]))
    rows = spark.createDataFrame(numbered, frame.schema.add("place", "long"))
    return rows.join(F.broadcast(spark.createDataFrame([(w,) for w in sorted(want)], "place long")), "place", "left_semi")


def leakage_free_views(turns: DataFrame, last: int, session: str = "conv_id", turn: str = "turn", role: str = "role", asks: str = "user") -> DataFrame:
    """A view of each session for each target turn: what came before it, and at it only what the user said."""
    targets = turns.select(session, F.col(turn).alias("target")).where(f"target between 0 and {last}").distinct()
    x = targets.join(turns, session).where((F.col(turn) < F.col("target")) | ((F.col(turn) == F.col("target")) & (F.col(role) == asks)))
    return x


def first_wins(frame: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row of each key: the first by an explicit order."""
    return frame.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def day_of(ms: str | Column) -> Column:
    return F.floor((F.col(ms) if isinstance(ms, str) else ms) / MS_DAY)
