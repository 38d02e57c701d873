"""Partitioned Parquet tables with a manifest that is written last and refuses stale loads."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class StaleStore(Exception):
    """The stored table is missing, unfinished or was made from something else."""


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def block_hash(block) -> str:
    return hashlib.sha256(json.dumps(block, sort_keys=True, default=str).encode()).hexdigest()[:16]


def write(df: DataFrame, path: str, manifest: dict) -> None:
    """One folder for each year; the manifest goes first and comes back last, so a torn write cannot be read."""
    spark = df.sparkSession
    fs, p = _file(spark, f"{path}/manifest.json")
    fs.delete(p, False)
    df.withColumn("year", F.year("trade_date")).repartition("year").sortWithinPartitions("symbol", "trade_date").write.mode("overwrite").partitionBy("year").parquet(f"{path}/values")
    check = _check(spark.read.parquet(f"{path}/values"))
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(manifest | check, sort_keys=True).encode()))
    out.close()


def _check(stored: DataFrame) -> dict:
    """Number of rows and an order-free sum over all values of all columns."""
    names = sorted(stored.columns)
    r = stored.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*names).cast("decimal(38,0)")).cast("string").alias("values")).first()
    return {"columns": names, "rows": r["rows"], "values": r["values"]}


def read_manifest(spark: SparkSession, path: str) -> dict:
    fs, p = _file(spark, f"{path}/manifest.json")
    if not fs.exists(p):
        raise StaleStore(f"{path} has no manifest")
    return json.loads("\n".join(r["value"] for r in spark.read.text(p.toString()).collect()))


def load(spark: SparkSession, path: str, expect: dict, columns: list[str] | None = None, flags: dict[str, str] | None = None, start=None, end=None) -> DataFrame:
    """Refuses another build or configuration; prunes years and columns, and reads a value's flag with it."""
    manifest = read_manifest(spark, path)
    for k, v in expect.items():
        if manifest.get(k) != v:
            raise StaleStore(f"{path}: {k} is {manifest.get(k)!r}, not {v!r}")
    df = spark.read.parquet(f"{path}/values")
    if _check(df) != {k: manifest.get(k) for k in ("columns", "rows", "values")}:
        raise StaleStore(f"{path}: what is stored differs from the manifest")
    if start is not None:
        df = df.where((F.col("year") >= start.year) & (F.col("trade_date") >= F.lit(start)))
    if end is not None:
        df = df.where((F.col("year") <= end.year) & (F.col("trade_date") < F.lit(end)))
    if columns is not None:
        need = [*columns, *[f for c, f in (flags or {}).items() if c in columns and f not in columns]]
        df = df.select("symbol", "trade_date", *need)
    return df.drop("year")
