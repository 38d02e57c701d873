"""All queries of the engine's own operators, by name, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .functions import statistics
from .operators import market, measures, outcomes, quality, research  # noqa: F401  (they register relations)
from .plans.relations import REGISTRY, oracle, spark_frame

FLAGSHIP = "measures_volume"
#: Relations that only feed others.
INNER = {"sessions", "excluded_days", "dated_bars", "factor_kinds", "membership", "excluded_windows", "bars", "referenced", "banded", "limited", "limits_all", "labels_dim", "label_spans", "labelled_bars", "guarded", "stage1", "stage2", "stage3", "panel_wide", "walk", "walked", "decided_k3", "decided_k5", "gate_k3", "gate_k5", "masks", "trigger_bits", "bits_k3", "bits_k5", "bits", "vocabulary", "base_cells", "base_split", "fired", "kept_days", "occurrences", "yearly_days", "evidence_rows", "trades", "daily_net", "ledger_days", "encoded", "daily", "second_source"}
NAMES = [n for n in REGISTRY if n not in INNER]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: (lambda spark, sf_dir, n=n: spark_frame(spark, sf_dir, n)) for n in NAMES}
ORACLE_SQL: dict[str, str] = {n: oracle(n) for n in NAMES}


def bootstrap_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-sided p of every testable hypothesis by resampling blocks of sessions; no twin, since SQL has no such draw."""
    counts = spark_frame(spark, sf_dir, "block_counts")
    last = counts.agg({"block": "max"}).first()[0]
    return statistics.bootstrap(counts, (last or 0) + 1, ("trigger_name", "conds", "k"))


QUERIES["bootstrap_p"] = bootstrap_p
