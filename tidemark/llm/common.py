"""Shared pieces of the operators: shared-folder tables, distributed positions, text blocks."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LIBC = ctypes.CDLL(None)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where it is unset, a fresh one in local mode, an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/tidemark/{tag}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def materialize(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that :func:`materialize` gave and nothing reads any more."""
    for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
        remove(df.sparkSession, folder)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the Arrow batches that Python workers receive, so that long texts fit; let workers find this package."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH", "")]))
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


#: What operators remember in a Python worker from task to task, by operator: how to drop it.
REMEMBERED: dict[str, Callable[[], None]] = {}


def take_turn(operator: str) -> None:
    """At the start of a task in a worker: drop what other operators remember there, and return freed memory."""
    for name, drop in REMEMBERED.items():
        if name != operator:
            drop()
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):  # glibc keeps freed memory otherwise
        _LIBC.malloc_trim(0)


def running_totals(df: DataFrame, order: list, total: str, groups: list[str] = (), tag: str = "order") -> DataFrame:
    """Exclusive running totals in a global (or per-group) order, without a one-task window.

    ``df`` is range-partitioned by ``groups + order``, sorted within partitions and written
    once.  Each partition then sums its rows by group; those sums (one row for a partition and
    group that meet) are accumulated, and every row adds its partition's offset to its own
    partial total.  Adds ``before_rows`` and ``before_total`` (long).  The order must be total
    up to identical rows.
    """
    keys = [F.col(g).asc_nulls_first() for g in groups] + list(order)
    n = partitions(df.sparkSession)
    placed = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    placed = materialize(placed.withColumn("_at", F.monotonically_increasing_id()), tag)
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    from pyspark.sql import Window

    cells = placed.groupBy("_part", *groups).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(total).alias("_s"), F.min("_at").alias("_first")
    )
    over = Window.partitionBy(*[F.col(g) for g in groups]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(
        F.col("_part").alias("_p"),
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)],
        F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_s").over(over), F.lit(0)).alias("_s0"),
        "_first",
    )
    on = F.col("_part") == F.col("_p")
    for i, g in enumerate(groups):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    here = Window.partitionBy("_part", *groups).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.withColumn("_s1", F.coalesce(F.sum(total).over(here), F.lit(0)))
        .join(cells, on)
        .withColumn("before_rows", F.col("_n0") + F.col("_at") - F.col("_first"))
        .withColumn("before_total", F.col("_s0") + F.col("_s1"))
        .drop("_at", "_part", "_p", "_n0", "_s0", "_s1", "_first", *[f"_g{i}" for i in range(len(groups))])
    )


#: Rows of one key that a salted part takes.
PART = 4096


def salted(rows: DataFrame, one: DataFrame, key: str | list[str], by: str, count: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``one`` row for each ``key``, whose ``count`` (in both) says over how many parts it is dealt by ``by``."""
    parts = lambda c: F.floor(F.col(c) / PART).cast("int") + 1
    one = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts(count) - 1))).drop(count)
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(by), parts(count)).cast("int"))
    return rows.join(one, [*([key] if isinstance(key, str) else key), "_salt"], how).drop("_salt")


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; nulls count as empty texts."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    bufs = column.buffers()
    n = len(column)
    if not n or bufs[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, off


def row_blocks(off: np.ndarray, limit: int):
    """Row ranges of at most ``limit`` bytes each (or of one row)."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def arrow_schema(schema: str | T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(schema) if isinstance(schema, str) else schema)
