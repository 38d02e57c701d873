"""Named relations: SQL fragments with declared dependencies, composed to one statement.

A relation is written once with ``{placeholders}`` for the few spellings in which engines
differ.  ``spark_frame`` plans the composed statement with Catalyst; ``oracle`` gives the
DuckDB text.  Unused columns and relations never reach the scan: Catalyst prunes them.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import new_path

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: The spellings that differ.
SPARK = {"plus_months": "add_months({0}, {1})", "median": "percentile({0}, 0.5)", "plus_days": "date_add({0}, {1})", "monday": "to_date(date_trunc('week', {0}))", "day": "to_date({0})", "weekday": "(weekday({0}) + 1)", "month": "to_date(date_trunc('month', {0}))", "pct": "percentile({0}, {1})", "mode": "min(mode({0}))", "json_k": "cast(get_json_object({0}, '$.k') as bigint)", "list": "array_join(array_sort(collect_list({0})), ',')", "hash": "cast(crc32(cast({0} as binary)) as bigint)", "ratio": "try_divide({0}, {1})", "first_by": "min_by({0}, struct({1}))", "last_by": "max_by({0}, struct({1}))", "near": "size(filter(collect_list({0}) {2}, x -> abs(x - {1}) <= 0.02 * {1}))", "spaced": "slice(aggregate(array_sort(collect_list({0})), array(cast(-1000000 as bigint)), (a, s) -> case when s - element_at(a, -1) > {1} then concat(a, array(s)) else a end), 2, 1000000)", "rows_of": "explode({0})"}
DUCK = {"plus_months": "CAST({0} + INTERVAL ({1}) MONTH AS DATE)", "median": "median({0})", "plus_days": "({0} + CAST({1} AS INTEGER))", "monday": "CAST(date_trunc('week', {0}) AS DATE)", "day": "CAST({0} AS DATE)", "weekday": "isodow({0})", "month": "CAST(date_trunc('month', {0}) AS DATE)", "pct": "quantile_cont({0}, {1})", "mode": "mode({0})", "json_k": "CAST(json_extract({0}, '$.k') AS BIGINT)", "list": "array_to_string(list_sort(list({0})), ',')", "hash": "0", "ratio": "({0} / nullif({1}, 0))", "first_by": "arg_min({0}, ROW({1}))", "last_by": "arg_max({0}, ROW({1}))", "near": "len(list_filter(list({0}) {2}, lambda x: abs(x - {1}) <= 0.02 * {1}))", "spaced": "list_reduce(list_transform(list_sort(list({0})), lambda x: [x]), lambda a, x: CASE WHEN x[1] - a[-1] > {1} THEN list_concat(a, x) ELSE a END)", "rows_of": "unnest({0})"}

_CALL = re.compile(r"@(\w+)\(")


@dataclass(frozen=True)
class Relation:
    needs: tuple[str, ...]
    sql: str


REGISTRY: dict[str, Relation] = {}


def relation(name: str, needs: str, sql: str) -> None:
    REGISTRY[name] = Relation(tuple(needs.split()), sql)


def _spell(sql: str, words: dict[str, str]) -> str:
    """Replace ``@name(arg; arg)`` by the engine's form; arguments may nest."""
    while m := _CALL.search(sql):
        depth, i = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            i += 1
        args = [x.strip() for x in sql[m.end() : i - 1].split(";")]
        sql = sql[: m.start()] + words[m[1]].format(*args) + sql[i:]
    return sql


def _chain(name: str, leaves=frozenset()) -> list[str]:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order or n in TABLES:
            return
        for x in () if n in leaves else REGISTRY[n].needs:
            visit(x)
        order.append(n)

    visit(name)
    return order


def _tables(names: list[str]) -> list[str]:
    return sorted({t for n in names for t in REGISTRY[n].needs if t in TABLES})


def oracle(name: str) -> str:
    names = _chain(name)
    parts = ",\n".join(f"{n} AS ({_spell(REGISTRY[n].sql, DUCK)})" for n in names)
    return f"WITH {parts}\nSELECT * FROM {name}"


#: Relations that Spark writes once to the shared folder and reads back: the stored panel and
#: outcomes, on which everything downstream is planned afresh.
STORED = {"bars_ohlcv", "bars", "limits_all", "stage3", "fingerprint_wide", "walk", "outcomes_k3", "outcomes_k5", "gate_k3", "gate_k5", "bits", "base_split", "fired", "kept_days", "occurrences", "hypothesis_stats", "scan_candidates"}
_STORED: dict[tuple[str, str, str], str] = {}


def _stored_path(spark: SparkSession, sf_dir: str, name: str) -> str:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        path = new_path(spark, name)
        spark.sql(spark_sql(name, sf_dir, spark)).write.parquet(path)
        _STORED[key] = path
    return _STORED[key]


def spark_sql(name: str, sf_dir: str, spark: SparkSession | None = None) -> str:
    """``spark``: store what is to be stored on the way; without it the text is one whole statement."""
    stored = STORED - {name} if spark is not None else set()
    names = _chain(name, stored)
    parts = [f"{n} AS (SELECT * FROM parquet.`{_stored_path(spark, sf_dir, n)}`)" for n in names if n in stored]
    names = [n for n in names if n not in stored]
    parts += [f"{t} AS (SELECT * FROM parquet.`{sf_dir}/{t}.parquet`)" for t in _tables(names)]
    parts += [f"{n} AS ({_spell(REGISTRY[n].sql, SPARK)})" for n in names]
    return "WITH " + ",\n".join(parts) + f"\nSELECT * FROM {name}"


def spark_frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(spark_sql(name, sf_dir, spark))


def frame_on(spark: SparkSession, name: str, given: dict[str, DataFrame]) -> DataFrame:
    """Any relation on rows of one's own: ``given`` holds DataFrames that take the place of relations or tables."""
    names = [n for n in _chain(name, set(given))]
    missing = set(_tables([n for n in names if n not in given])) - set(given)
    if missing:
        raise ValueError(f"{name} reads {', '.join(sorted(missing))} beyond what is given")
    views = {n: f"given_{uuid.uuid4().hex}" for n in given}
    for n, df in given.items():
        df.createOrReplaceTempView(views[n])
    parts = [f"{n} AS (SELECT * FROM {v})" for n, v in views.items()]
    parts += [f"{n} AS ({_spell(REGISTRY[n].sql, SPARK)})" for n in names if n not in given]
    out = spark.sql("WITH " + ",\n".join(parts) + f"\nSELECT * FROM {name}")
    for v in views.values():
        spark.catalog.dropTempView(v)
    return out
