"""Sources and sinks: Parquet, CSV with a fixed schema, JSON, NPY vectors, adapters by name."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXPOSURE_SCHEMA = "user_id string, video_id string, time_ms long, is_click int, is_rand int, tab int"
VIDEO_SCHEMA = "video_id string, video_type string, upload_dt string, upload_type string, tag string"


def parquet(spark, paths, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    return df.select(*columns) if columns else df


def csv(spark, paths, schema: str, columns: list[str] | None = None) -> DataFrame:
    """CSV by header names with given types: an id or tag that looks like a number stays text."""
    df = spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(paths)
    return df.select(*columns) if columns else df


def json_records(spark, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def npy_vectors(spark, path: str, row_bytes: int | None = None) -> DataFrame:
    """Rows (path, row, vector) of 2-D .npy files; a file is read by one task."""

    def rows(batches):
        import io

        for pdf in batches:
            for p, data in zip(pdf["path"], pdf["content"], strict=True):
                m = np.load(io.BytesIO(data), allow_pickle=False)
                for a in range(0, len(m), 4096):
                    part = m[a : a + 4096].astype(np.float32)
                    yield pd.DataFrame({"path": p, "row": np.arange(a, a + len(part)), "vector": list(part)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "path string, row long, vector array<float>")


def first_rows_by_shard(shards: list[DataFrame], limit: int, order: list[str]) -> DataFrame:
    """The shards in turn, each in its order, up to a limit over all of them."""
    out, left = None, limit
    for i, shard in enumerate(shards):
        part = shard.withColumn("shard", F.lit(i)).orderBy(*order).limit(left)
        out = part if out is None else out.unionByName(part)
        left -= part.count()
        if left <= 0:
            break
    return out


def check_embeddings(df: DataFrame, rows: int, dimension: int, key: str = "article_id", column: str = "embedding") -> DataFrame:
    """The vectors with `present`, or ValueError if number, size or ids are not as recorded."""
    got = df.agg(F.count("*").alias("n"), F.count_distinct(key).alias("ids"), F.min(F.size(column)).alias("a"), F.max(F.size(column)).alias("b")).first()
    if (got.n, got.ids) != (rows, rows) or rows and (got.a, got.b) != (dimension, dimension):
        raise ValueError(f"embeddings differ from their manifest: {got}")
    length = F.aggregate(column, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    stated = F.col("text_present") if "text_present" in df.columns else F.lit(None).cast("boolean")
    return df.withColumn("present", F.coalesce(stated, length > 0))


def exposure_log(logs: DataFrame, videos: DataFrame | None = None) -> DataFrame:
    """Short-video exposure logs as samples; ids come from an explicit order within each user, repeats are kept."""
    from pyspark.sql import Window

    bad = logs.where(~F.col("is_rand").isin(0, 1) | F.col("is_rand").isNull())
    if not bad.isEmpty():
        raise ValueError("is_rand must be 0 or 1")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("time_ms", "video_id", "tab", "is_click"))
    x = logs.withColumn("sample_id", F.concat_ws(":", F.lit("event"), "user_id", n))
    x = x.select("sample_id", F.col("sample_id").alias("group_id"), F.col("user_id").cast("string"), F.col("video_id").cast("string").alias("item_id"), F.col("time_ms").alias("timestamp"),
                 F.col("is_click").alias("label"), F.when(F.col("is_rand") == 1, "random").otherwise("standard").alias("policy"), F.col("tab").cast("string").alias("scene"))
    if videos is None:
        return x
    v = videos.select(F.col("video_id").cast("string").alias("item_id"), F.coalesce("video_type", F.lit("")).alias("category"), F.coalesce("upload_type", F.lit("")).alias("subcategory"), F.coalesce("tag", F.lit("")).alias("tags"), F.coalesce(F.unix_timestamp(F.to_timestamp("upload_dt", "yyyy-MM-dd")), F.lit(0)).alias("pub_time"))
    if not v.groupBy("item_id").count().where("count > 1").isEmpty():
        raise ValueError("repeated video metadata")
    out = x.join(v, "item_id", "left")
    if not out.where("category is null").isEmpty():
        raise ValueError("videos without metadata")
    return out


def session_events(sessions: DataFrame, catalog: DataFrame | None = None, role: str = "music") -> DataFrame:
    """Nested sessions as retrieval events: the turns of one role, in order; unknown items are an error."""
    x = sessions.select("session_id", "user_id", F.unix_millis(F.to_timestamp("session_date")).alias("timestamp"), F.explode("conversations").alias("c")).where(F.col("c.role") == role)
    x = x.select(F.concat_ws(":", "session_id", F.col("c.turn_number")).alias("event_id"), "session_id", "user_id", F.col("c.content").alias("item_id"), "timestamp", F.col("c.turn_number").alias("step"))
    if catalog is not None and not x.join(catalog.select(F.col("track_id").alias("item_id")), "item_id", "left_anti").isEmpty():
        raise ValueError("items outside the catalog")
    return x


def purchase_events(purchases: DataFrame) -> DataFrame:
    """Purchases as retrieval events; a client is a session, steps follow time and event id."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("client_id").orderBy("timestamp", "sku")) - 1
    x = purchases.withColumn("event_id", F.concat_ws(":", F.lit("buy"), "client_id", n))
    step = F.row_number().over(Window.partitionBy("client_id").orderBy("timestamp", "event_id"))
    user = F.col("client_id").cast("string")
    return x.select("event_id", user.alias("session_id"), user.alias("user_id"), F.col("sku").cast("string").alias("item_id"), F.unix_millis(F.to_timestamp("timestamp")).alias("timestamp"), step.alias("step"))


ADAPTERS: dict[str, Callable] = {"exposures": exposure_log, "sessions": session_events, "purchases": purchase_events}


def adapter(name: str) -> Callable:
    if name not in ADAPTERS:
        raise ValueError(f"unknown dataset {name!r}; known: {sorted(ADAPTERS)}")
    return ADAPTERS[name]
