"""Commerce profiles: counts, ratios, windows, price moments and hashed category histograms by client."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import log1p0, safe_ratio

#: Weights of actions in the category histogram (our choice: a purchase counts most).
ACTION_WEIGHTS = {"buy": 3.0, "collect": 2.0, "click": 1.0}


def profile(events: DataFrame, clients: DataFrame, as_of: int, days: tuple[int, ...] = (1, 7, 30)) -> DataFrame:
    """Log-scaled scalars of each client from events (client_id, action, seconds, price, category).

    Windows reach back from `as_of` and have no upper bound. Clients without events get zeros.
    """
    hit = lambda a, d=None: (F.col("action") == a) & (F.lit(True) if d is None else F.col("seconds") >= as_of - d * 86400)
    aggs = {f"{a}_count": F.count_if(hit(a)) for a in ACTION_WEIGHTS}
    for d in days:
        aggs |= {f"{a}_count_{d}d": F.count_if(hit(a, d)) for a in ACTION_WEIGHTS}
        aggs |= {f"_{a}_{d}": F.avg(F.when(hit(a, d), F.col("price"))) for a in ACTION_WEIGHTS}
    aggs |= {f"_{a}_mean": F.avg(F.when(hit(a), F.col("price"))) for a in ACTION_WEIGHTS} | {f"_{a}_std": F.stddev_pop(F.when(hit(a), F.col("price"))) for a in ACTION_WEIGHTS}
    x = clients.select("client_id").join(events.groupBy("client_id").agg(*[v.alias(k) for k, v in aggs.items()]), "client_id", "left")
    out: dict[str, Column] = {k: F.col(k) for k in (f"{a}_count" for a in ACTION_WEIGHTS)}
    out |= {"buy_per_collect": safe_ratio("buy_count", "collect_count"), "collect_per_click": safe_ratio("collect_count", "click_count")}
    for d in days:
        out |= {f"{a}_count_{d}d": F.col(f"{a}_count_{d}d") for a in ACTION_WEIGHTS}
        out |= {f"buy_per_collect_{d}d": safe_ratio(f"buy_count_{d}d", f"collect_count_{d}d")} | {f"{a}_price_mean_{d}d": F.col(f"_{a}_{d}") for a in ACTION_WEIGHTS}
    out |= {f"{a}_price_mean": F.col(f"_{a}_mean") for a in ACTION_WEIGHTS} | {f"{a}_price_std": F.col(f"_{a}_std") for a in ACTION_WEIGHTS}
    out["buy_over_collect_price"] = safe_ratio("_buy_mean", "_collect_mean")
    return x.select("client_id", *[F.round(log1p0(v), 4).alias(k) for k, v in out.items()])


def category_histogram(events: DataFrame, bins: int = 32) -> DataFrame:
    """Rows (client_id, bin, share): action-weighted categories by remainder, each client's shares summing to 1."""
    w = F.lit(0.0)
    for a, v in ACTION_WEIGHTS.items():
        w = F.when(F.col("action") == a, v).otherwise(w)
    x = events.where("category is not null").groupBy("client_id", F.pmod("category", F.lit(bins)).cast("int").alias("bin")).agg(F.sum(w).alias("w"))
    total = x.groupBy("client_id").agg(F.sum("w").alias("t")).where("t > 0")
    return x.join(total, "client_id").select("client_id", "bin", F.round(F.col("w") / F.col("t"), 6).alias("share"))


def aligned(ids: DataFrame, vectors: DataFrame, key: str, column: str, size: int) -> DataFrame:
    """A vector for each listed id, zeros where there is none, and whether it was missing."""
    zeros = F.array_repeat(F.lit(0.0).cast("float"), size)
    return ids.join(vectors, key, "left").select(*ids.columns, F.col(column).isNull().alias("missing"), F.coalesce(column, zeros).alias(column))


def label_flags(clients: DataFrame, target: DataFrame) -> DataFrame:
    """churn is 1 for clients without target events; propensities are the distinct categories they bought."""
    seen = target.groupBy("client_id").agg(F.sort_array(F.collect_set("category")).alias("categories"))
    x = clients.select("client_id").join(seen, "client_id", "left")
    return x.select("client_id", F.col("categories").isNull().cast("int").alias("churn"), F.coalesce(F.array_join(F.transform("categories", lambda c: c.cast("string")), ","), F.lit("")).alias("categories"))


def usable_vectors(vectors: DataFrame, key: str, column: str, dim: int) -> DataFrame:
    """(key, n_rows, usable): one row a key; usable if its first row's vector has `dim` finite values and a norm of 1e-12 or more.

    The first row is the one with the least vector; repeated keys are counted.
    """
    one = vectors.groupBy(key).agg(F.count("*").alias("n_rows"), F.min(column).alias("_v"))
    v = F.transform("_v", lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return one.select(key, "n_rows", F.coalesce((F.size("_v") == dim) & finite & (norm >= 1e-12), F.lit(False)).alias("usable"))
