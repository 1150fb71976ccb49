"""Helpers shared by the operators: shared storage, bounded Arrow batches, word hashes, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch: whole texts of any length pass, a few at a time.
ARROW_ROWS = 512
#: Whether a query's shuffle files go when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of text hashed at once; a longer document is one block of its own.
BLOCK_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one beside the warehouse if unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"
    return f"{base.rstrip('/')}/quillon"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write df once to shared storage and read it back; what it shuffled is deleted at once, not when the driver next collects."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that materialise() wrote; only for tables no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(f)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of df has them, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch can hold."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its len+1 offsets; a null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def blocks(offs: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together hold about `limit` bytes."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_pow: dict[int, np.ndarray] = {}
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(base: int, n: int) -> np.ndarray:
    have = _pow.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, BLOCK_BYTES + 1), base, _U)
        have[0] = 1
        _pow[base] = have = np.multiply.accumulate(have)
    return have


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values (xor-shift multiply rounds)."""
    x = x + _U((salt * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0xA3B195354A39B70D)
    return x ^ (x >> _U(32))


def word_hashes(raw: np.ndarray, offs: np.ndarray, spaces: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each text, A-Z folded, and the len+1 offsets of each text's words.

    Words are runs of bytes outside `spaces`. A word's hash is a polynomial of its bytes modulo 2**64, read
    off one running sum, then mixed with its length.
    """
    n = len(raw)
    if not n:
        return np.zeros(0, _U), np.zeros(len(offs), np.int64)
    inside = ~spaces[raw]
    cut = np.zeros(n + 1, bool)
    cut[offs[:-1]] = True
    cut[n] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    sums = np.zeros(n + 1, _U)
    np.cumsum((_LOWER[raw].astype(_U) + _U(1)) * _powers(_BASE, n)[:n], out=sums[1:])
    h = (sums[ends] - sums[starts]) * _powers(_INV, n)[starts]
    return mix(h ^ mix((ends - starts).astype(_U))), np.searchsorted(starts, offs)


def connected_components(edges: DataFrame, label: str = "cc", max_rounds: int = 40) -> DataFrame:
    """(node, component) of the graph of (u, v) rows; component is its least node. Isolated nodes don't appear.

    Alternates large-star and small-star steps: every step is one minimum per node (combined before the
    shuffle) and one join, so no node's neighbours are gathered anywhere. Each round is written to shared
    storage; it ends when a round leaves the edges as they were.
    """
    edges = materialise(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label
    )
    for _ in range(max_rounds):
        ends = edges.select("u", "v").union(edges.select("v", "u"))
        low = ends.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
        large = edges.join(low, "v").select("u", F.col("m").alias("v"), (F.col("m") < F.col("v")).alias("moved"))
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.max("moved").alias("moved"))
        small = large.join(least.select("u", "m"), "u").where("v <> m").select("v", "m", F.lit(True)).union(least)
        small = materialise(small.toDF("u", "v", "moved").groupBy("u", "v").agg(F.max("moved").alias("moved")), label)
        discard(edges)
        edges = small
        if edges.where("moved").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(edges.select("v", "v").distinct())
