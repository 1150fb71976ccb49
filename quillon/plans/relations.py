"""The tables at hand as the relations the operators work on, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Split boundaries, update interval, feedback delay (ms) of the impression relation; widths of its windows.
TRAIN_START, VALIDATION_START, TEST_START, TEST_END = 694224000000, 820454400000, 852076800000, 915148800000
INTERVAL, DELAY = 86_400_000, 3_600_000
ORDER_WIDTHS = {"7d": 604_800_000, "30d": 2_592_000_000, "90d": 7_776_000_000}
EVENT_WIDTHS = {"5m": 300_000, "1h": 3_600_000, "24h": 86_400_000}


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark, sf_dir: str) -> DataFrame:
    """Impression samples: an order is a request, its distinct parts are the candidates, a return is a click."""
    o, li, p = (read(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    lines = li.groupBy("l_orderkey", "l_partkey").agg(F.min(F.struct("l_linenumber", "l_returnflag", "l_linestatus", "l_quantity", "l_discount")).alias("f"))
    x = lines.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    return x.select(
        F.concat_ws("-", "l_orderkey", "l_partkey").alias("sample_id"),
        F.col("o_orderkey").cast("string").alias("group_id"),
        F.col("o_custkey").cast("string").alias("user_id"),
        F.col("l_partkey").cast("string").alias("item_id"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("timestamp"),
        (F.col("f.l_returnflag") == "R").cast("int").alias("label"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "random").otherwise("standard").alias("policy"),
        F.col("o_orderpriority").alias("scene"),
        (F.col("f.l_linenumber") - 1).alias("position"),
        F.count("*").over(Window.partitionBy("o_orderkey")).cast("int").alias("candidate_count"),
        F.col("f.l_linestatus").alias("device_type"),
        F.col("f.l_quantity").alias("read_time"),
        F.nullif(F.col("f.l_discount"), F.lit(0.0)).alias("scroll_percentage"),
        F.col("p_brand").alias("category"),
        F.split("p_type", " ").alias("tags"),
        F.when(F.col("p_size") % 10 == 0, F.lit(0)).otherwise(694224000 + F.col("p_partkey") * 3600).cast("long").alias("pub_time"),
    )


SAMPLES = """
ties AS (SELECT l_orderkey, l_partkey, min({'ln': l_linenumber, 'rf': l_returnflag, 'ls': l_linestatus, 'qt': l_quantity, 'dc': l_discount}) AS f FROM lineitem GROUP BY l_orderkey, l_partkey),
lines AS (SELECT l_orderkey, l_partkey, f.ln AS ln, f.rf AS rf, f.ls AS ls, f.qt AS qt, f.dc AS dc FROM ties),
samples AS (SELECT l_orderkey || '-' || l_partkey AS sample_id, CAST(o_orderkey AS VARCHAR) AS group_id, CAST(o_custkey AS VARCHAR) AS user_id,
                   CAST(l_partkey AS VARCHAR) AS item_id, epoch_us(o_orderdate) // 1000 AS "timestamp", CAST(rf = 'R' AS INTEGER) AS label,
                   CASE WHEN o_orderpriority = '1-URGENT' THEN 'random' ELSE 'standard' END AS policy, o_orderpriority AS scene,
                   ln - 1 AS position, CAST(count(*) OVER (PARTITION BY o_orderkey) AS INTEGER) AS candidate_count, ls AS device_type, qt AS read_time,
                   nullif(dc, 0.0) AS scroll_percentage, p_brand AS category, string_split(p_type, ' ') AS tags,
                   CASE WHEN p_size % 10 = 0 THEN 0 ELSE 694224000 + p_partkey * 3600 END AS pub_time
            FROM lines JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)
"""


def with_split(frame: DataFrame) -> DataFrame:
    from ..operators.splits import temporal_split

    return temporal_split(frame, TRAIN_START, VALIDATION_START, TEST_START, TEST_END)


SPLIT = f"""
split AS (SELECT *, CASE WHEN "timestamp" >= {TRAIN_START} AND "timestamp" < {VALIDATION_START} AND policy <> 'random' THEN 'train'
                         WHEN "timestamp" >= {VALIDATION_START} AND "timestamp" < {TEST_START} AND policy <> 'random' THEN 'validation'
                         WHEN "timestamp" >= {TEST_START} AND "timestamp" < {TEST_END} THEN 'test' END AS split FROM samples)
"""


def exposures(spark, sf_dir: str) -> DataFrame:
    """Short-video style exposure log: each event shows one item to one user."""
    e = read(spark, sf_dir, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return e.select(
        F.concat(F.lit("event:"), F.col("event_id").cast("string")).alias("sample_id"),
        F.concat(F.lit("event:"), F.col("event_id").cast("string")).alias("group_id"),
        F.col("user_id").cast("string").alias("user_id"), F.get_json_object("props", "$.k").alias("item_id"), ms.alias("timestamp"),
        (F.col("event_type") == "click").cast("int").alias("label"), F.when(F.col("event_id") % 5 == 0, "random").otherwise("standard").alias("policy"),
        F.concat(F.lit("tab"), (F.hour("ts") % 4).cast("string")).alias("scene"), F.col("event_type").alias("type"), "value",
        F.when(F.col("event_type") == "error", None).otherwise(F.col("value")).alias("scroll_percentage"),
    )


EXPOSURES = """
exposures AS (SELECT 'event:' || event_id AS sample_id, 'event:' || event_id AS group_id, CAST(user_id AS VARCHAR) AS user_id, json_extract_string(props, '$.k') AS item_id,
                     epoch_us(ts) // 1000 AS "timestamp", CAST(event_type = 'click' AS INTEGER) AS label, CASE WHEN event_id % 5 = 0 THEN 'random' ELSE 'standard' END AS policy,
                     'tab' || (hour(ts) % 4) AS scene, event_type AS type, value, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS scroll_percentage FROM events)
"""


def sequence(spark, sf_dir: str) -> DataFrame:
    """Retrieval events: a user's events are a session, in order of time and id."""
    e = exposures(spark, sf_dir)
    order = Window.partitionBy("user_id").orderBy("timestamp", "sample_id")
    return e.select(F.col("sample_id").alias("event_id"), F.col("user_id").alias("session_id"), "user_id", "item_id", "timestamp", F.row_number().over(order).alias("step"))


SEQUENCE = """
seq AS (SELECT sample_id AS event_id, user_id AS session_id, user_id, item_id, "timestamp", CAST(row_number() OVER (PARTITION BY user_id ORDER BY "timestamp", sample_id) AS INTEGER) AS step FROM exposures)
"""
