"""Each query against its SQL twin in DuckDB, at the smallest scale."""

import decimal

import duckdb
import pytest

from tidemark import catalog
from tidemark.functions import rules
from tidemark.operators.measures import MEASURES

SF = "/root/testdata/sf0.001"
SOME = ["bars_ohlcv", "exchange_in_force", "limit_prices", "measures_volume", "measures_candles", "measures_levels", "breadth_counts", "stock_vs_sector", "outcomes_k3", "gate_reasons", "hypothesis_stats", "bh_verdict", "holdout_verdict", "walk_forward", "drawdown", "max_open", "look_alikes", "evidence_chosen", "scan_rank", "ledger_summary", "promotion", "reconcile_close"]


def plain(rows):
    return sorted(([float(v) if isinstance(v, decimal.Decimal) else v for v in r] for r in rows), key=repr)


@pytest.mark.parametrize("name", SOME)
def test_twin(spark, name):
    con = duckdb.connect()
    for t in ("part", "lineitem", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    twin = con.sql(catalog.ORACLE_SQL[name])
    names = sorted(df.columns)
    assert names == sorted(twin.columns)
    assert plain(df.select(*names).collect()) == plain(twin.select(*names).fetchall())


def test_every_query_has_a_twin():
    assert set(catalog.QUERIES) - set(catalog.ORACLE_SQL) == {"bootstrap_p"}  # SQL cannot draw
    assert len(MEASURES) == 43


def test_one_exchange_by_symbol_for_a_measure_family(spark):
    plan = spark.sql("EXPLAIN FORMATTED " + __import__("tidemark.plans.relations", fromlist=["spark_sql"]).spark_sql("adjusted_bars", SF)).first()[0]
    assert "ReadSchema: struct<p_partkey:bigint,p_brand:string,p_retailprice:double>" in plan.replace("\n", "")


def test_costs():
    g = duckdb.sql(f"SELECT {rules.net_return('0.02')}").fetchall()[0][0]
    assert abs(g - (1.02 * (1 - 0.0025) / 1.0015 - 1)) < 1e-12


def test_no_look_ahead(spark):
    """Measures of early sessions do not change when later sessions are cut off."""
    from tidemark.plans.relations import spark_sql

    cut = "DATE '2015-06-01'"
    text = spark_sql("measures_trend", SF)
    early = text.replace("WHERE NOT (b = 7 AND", f"WHERE trade_date < {cut} AND NOT (b = 7 AND")
    assert early != text
    want = spark.sql(text).where(f"trade_date < {cut}")
    got = spark.sql(early)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
