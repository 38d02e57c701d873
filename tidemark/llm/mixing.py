"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only).

Each source's documents are shuffled by a seeded hash; a document's virtual finish time is the
source's running size, over all its passes, divided by the source's target.  All
documents are then range-sorted by finish time and cut where the running total reaches the
budget (the total size).  Targets share the budget by weight; a target stops at ``max_passes``
times its source's size and its excess is shared again by weight.  A pass over a document
competes only if it would begin before virtual time 1.

Null texts have size 0; a null source is a source of its own, last in order.  Repeated rows
count as separate documents.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, running_totals


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...], max_passes: int) -> DataFrame:
    """``source, source_size`` -> with ``target``; one row for each source, so a plain window is small.

    Sources are capped in order of ``max_passes * size / weight``; the level is right at the first
    source that stays below its cap.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    nth = F.row_number().over(by_name) - 1
    s = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), nth % len(weights) + 1))
    s = s.withColumn("cap", F.col("source_size") * float(max_passes))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    s = s.withColumn("budget", F.sum("source_size").over(everything))
    s = s.withColumn("_level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    s = s.withColumn("_fits", F.when(F.col("_level") * F.col("weight") <= F.col("cap"), F.col("_level")))
    first = F.first("_fits", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    s = s.withColumn("target", F.least("cap", F.coalesce(first * F.col("weight"), F.col("cap"))))
    return s.select("source", "source_size", "target", "budget")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_passes: int = 3, seed: int = 17) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, passes, taken."""
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        docs["source"].cast("string").alias("source"),
        word_count(docs["text"]).alias("size"),
        F.crc32(F.coalesce(docs["text"], F.lit(""))).alias("_crc"),
    )
    rows = rows.withColumn("_mixed", F.xxhash64(F.lit(seed), "doc_id"))
    queued = running_totals(rows, [F.col("_mixed"), F.col("doc_id"), F.col("_crc"), F.col("size")], "size", ["source"], "mix-queue")
    queued = queued.withColumnsRenamed({"before_rows": "_nth", "before_total": "_before"})
    quota = materialize(targets(queued.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_passes), "mix-targets")
    q = quota.withColumnRenamed("source", "_source")
    queued = queued.join(q, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    queued = queued.withColumn("_pass", F.explode(F.array(*[F.lit(i) for i in range(max_passes)])))
    begin = F.col("_pass") * F.col("source_size") + F.col("_before")
    queued = queued.withColumn("_runs", (F.col("size") > 0) & (begin < F.col("target")))
    queued = queued.where("_runs or _pass = 0")
    queued = queued.withColumn("_cost", F.when(F.col("_runs"), F.col("size")).otherwise(0))
    queued = queued.withColumn("_finish", F.when(F.col("_runs"), (begin + F.col("size")) / F.col("target")).otherwise(0.0))
    placed = running_totals(queued, [F.col("_finish"), F.col("source").asc_nulls_last(), F.col("_nth"), F.col("_pass")], "_cost", tag="mix-order")
    kept = F.col("_runs") & (F.col("before_total") + F.col("_cost") <= F.col("budget"))
    return (
        placed.groupBy("source", "_nth")
        .agg(
            *[F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")],
            F.sum(F.when(kept, 1).otherwise(0)).alias("passes"),
        )
        .withColumn("taken", F.col("passes") * F.col("size"))
        .select("doc_id", "source", "size", "source_size", "target", "passes", "taken")
    )
