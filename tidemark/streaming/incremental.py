"""Nightly increment: new publications are appended once, late duplicates never overwrite."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

KEYS = ("symbol", "trade_date")


def first_rows(rows: DataFrame, order: list) -> DataFrame:
    """One row for each key: the first in a total order."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy(*KEYS).orderBy(*order))
    return rows.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def append_absent(batch: DataFrame, batch_id: int, target: str) -> None:
    """Insert rows whose key no earlier batch holds; a batch that is retried replaces what it wrote itself.

    Each batch has a folder, which counts once it is finished; only the years of the batch are read of the others.
    """
    spark = batch.sparkSession
    fresh = first_rows(batch, [F.col(c) for c in sorted(batch.columns)]).withColumn("year", F.year("trade_date"))
    marks = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/batch=*/_SUCCESS")
    done = [s.getPath().getParent() for s in marks.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(marks) or []]
    earlier = [p.toString() for p in done if p.getName() != f"batch={batch_id}"]
    if earlier:
        years = [r["year"] for r in fresh.select("year").distinct().collect()]
        known = spark.read.option("basePath", target).schema(fresh.schema).parquet(*earlier).where(F.col("year").isin(years)).select(*KEYS)
        fresh = fresh.join(known, list(KEYS), "left_anti")
    fresh.write.mode("overwrite").partitionBy("year").parquet(f"{target}/batch={batch_id}")


def nightly(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str) -> StreamingQuery:
    """Take everything that is new under ``source`` and stop; restarts continue where the checkpoint stands."""
    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(lambda batch, n: append_absent(batch, n, target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def status(last_known, newest, today, tolerance_days: int = 2) -> str:
    """``ok``, ``no_new_data`` or ``stale_source``."""
    if newest is not None and (last_known is None or newest > last_known):
        return "ok"
    return "stale_source" if last_known is not None and (today - last_known).days > tolerance_days else "no_new_data"


def restated(stored: DataFrame, new: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Keys whose adjustment factor differs from the stored one."""
    n = new.select(*KEYS, F.col("factor").alias("_new"))
    return stored.join(n, list(KEYS)).where(F.abs(F.col("factor") - F.col("_new")) > tolerance).select(*KEYS, "factor", F.col("_new").alias("new_factor"))
