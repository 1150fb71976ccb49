"""Tables of a running job on the storage that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

#: Whether a query's shuffle files go when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, label: str, **conf: str) -> DataFrame:
    """The rows, written once to spark.checkpoint.dir (beside the warehouse if unset) with these settings and read back."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"
    path = f"{base.rstrip('/')}/quillon/{label}-{uuid.uuid4().hex}"
    conf = {SHUFFLE_CLEANUP: "true"} | conf
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)
