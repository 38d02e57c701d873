"""Readers on written files, and the store's refusals."""

import datetime as dt
import json

import pytest

from tidemark.sources import bars, store
from tidemark.streaming import incremental

HEAD = "\ufeff<Ticker>,<DTYYYYMMDD>,<Open>,<High>,<Low>,<Close>,<Volume>\n"
D = dt.date


@pytest.fixture(scope="module")
def day(tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    for name in ("20240102", "20240105", "20231231"):
        (root / name).mkdir()
    d = root / "20240105"
    (d / "x.raw.HSX.csv").write_text(HEAD + " aaa ,20240104,10,11,9,10.5,100\nBBB,20240104,5,5,5,5,10\nAAA1,20240104,1,1,1,1,1\n")
    (d / "x.adj.HSX.csv").write_text(HEAD + "AAA,20240104,9,9,9,9.5,100\nCCC,20240104,1,1,1,1,1\n")
    (d / "x.raw.HNX.csv").write_text(HEAD + "DDD,20240103,2,2,2,2,7\n")
    (d / "x.adj.HNX.csv").write_text(HEAD + "DDD,20240103,2,2,2,1.5,7\n")
    (d / "x.deals.csv").write_text(HEAD + "AAA,20240104,0,100,40,0,0\nINDEX,20240104,0,1,1,0,0\n")
    (d / "x.index.csv").write_text(HEAD + "IDX,20240105,1,1,1,1,1\nIDX,20240106,1,1,1,1,1\nIDX,20240107,1,1,1,1,1\n")
    return str(root)


FILES = {"HOSE": ("*.adj.HSX.csv", "*.raw.HSX.csv"), "HNX": ("*.adj.HNX.csv", "*.raw.HNX.csv")}


def test_publications(spark, day):
    last = bars.latest_publication(spark, day)
    assert last.endswith("/20240105")
    with pytest.raises(FileNotFoundError):
        bars.first_match(spark, last, "*.none")
    with pytest.raises(FileNotFoundError):
        bars.latest_publication(spark, day + "/none")


def test_stocks(spark, day):
    last = bars.latest_publication(spark, day)
    got = sorted((r["symbol"], r["trade_date"], r["exchange"], r["close"], r["adj_close"], r["source_file"]) for r in bars.stocks(spark, last, FILES).collect())
    assert got == [("AAA", D(2024, 1, 4), "HOSE", 10.5, 9.5, "x.raw.HSX.csv"), ("BBB", D(2024, 1, 4), "HOSE", 5.0, None, "x.raw.HSX.csv"), ("DDD", D(2024, 1, 3), "HNX", 2.0, 1.5, "x.raw.HNX.csv")]
    assert [r["symbol"] for r in bars.daily_stocks(spark, last, FILES, D(2024, 1, 3)).collect()] == ["DDD"]


def test_deals_and_index(spark, day):
    last = bars.latest_publication(spark, day)
    assert [(r["symbol"], r["deal_volume"], r["matched_check"]) for r in bars.negotiated(spark, last, {"HOSE": "*.deals.csv"}).collect()] == [("AAA", 40.0, 100.0)]
    assert [r["trade_date"] for r in bars.index_bars(spark, last, "*.index.csv").collect()] == [D(2024, 1, 5)]


def test_listings_and_membership(spark, tmp_path):
    for s, e, d in (("AAA", "HOSE", "03/01/2020"), ("BBB", "UPCoM", "04/01/2020"), ("CCC", "OTC", "04/01/2020"), ("DDD", "HNX", "soon"), ("EEE", "HNX", "01/02/2020")):
        (tmp_path / f"{s}.json").write_text(json.dumps({"symbol": s, "exchange": e, "listing_date": d}))
    listed = bars.listings(spark, str(tmp_path), {"HOSE": "HOSE", "HNX": "HNX", "UPCOM": "UPCOM", "UPCoM": "UPCOM"})
    assert sorted((r["symbol"], r["exchange"], r["valid_from"], r["valid_to"]) for r in listed.collect()) == [("AAA", "HOSE", D(2020, 1, 3), None), ("BBB", "UPCOM", D(2020, 1, 4), None), ("EEE", "HNX", D(2020, 2, 1), None)]
    filed = spark.createDataFrame([("AAA", "HNX", D(2020, 2, 1), D(2020, 3, 1)), ("AAA", "HOSE", D(2020, 3, 2), None), ("BBB", "UPCOM", D(2020, 1, 4), None)], "symbol string, exchange string, valid_from date, valid_to date")
    rows = spark.createDataFrame([("AAA", D(2020, 2, 5), "HNX"), ("BBB", D(2020, 5, 1), "UPCOM"), ("EEE", D(2020, 5, 1), "HOSE")], "symbol string, trade_date date, exchange string")
    got = sorted((r["symbol"], r["exchange"], r["source"]) for r in bars.membership(filed, listed, rows).collect())
    # AAA's bar on HNX lies in a transfer span; EEE's listing is contradicted
    assert got == [("AAA", "HNX", "filed_transfer"), ("AAA", "HOSE", "filed_transfer"), ("AAA", "HOSE", "listing"), ("BBB", "UPCOM", "listing")]


def test_labels(spark):
    from pyspark.sql import functions as F

    labels = spark.createDataFrame([("AAA", "1", D(2020, 1, 10)), ("AAA", "2", D(2020, 2, 10))], "symbol string, sector string, snapshot_date date")
    days = spark.createDataFrame([("AAA", D(2020, 1, 9)), ("AAA", D(2020, 1, 10)), ("AAA", D(2020, 2, 10)), ("BBB", D(2020, 2, 10))], "symbol string, trade_date date")
    got = sorted((r["symbol"], r["trade_date"], r["sector"], r["labels_current"]) for r in bars.labels_asof(days, labels).collect())
    assert got == [("AAA", D(2020, 1, 9), "1", True), ("AAA", D(2020, 1, 10), "1", False), ("AAA", D(2020, 2, 10), "2", False), ("BBB", D(2020, 2, 10), None, True)]
    codes = spark.createDataFrame([("1700", "1757"), ("1700", "1753"), ("8300", "1757")], "a string, b string")
    assert [r[0] for r in codes.select(bars.sector_of(F.col("a"), F.col("b"), ("1700", "1757"))).collect()] == ["1757", "1700", "8300"]


def test_settings():
    assert bars.settings(' {"k": [3, 5]}') == {"k": [3, 5]}


def test_store_refuses_changed_values(spark, tmp_path):
    rows = "SELECT 'AAA' AS symbol, DATE '2020-01-02' AS trade_date, {}D AS x"
    store.write(spark.sql(rows.format("1.0")), str(tmp_path), {"build": 1})
    assert store.load(spark, str(tmp_path), {"build": 1}).count() == 1
    spark.sql(rows.format("2.0") + ", 2020 AS year").write.mode("overwrite").partitionBy("year").parquet(f"{tmp_path}/values")
    with pytest.raises(store.StaleStore):
        store.load(spark, str(tmp_path), {"build": 1})


def test_increment_is_idempotent(spark, tmp_path):
    out = str(tmp_path / "out")
    one = spark.sql("SELECT 'AAA' AS symbol, DATE '2020-01-02' AS trade_date, 1.0D AS close")
    two = spark.sql("SELECT 'AAA' AS symbol, DATE '2020-01-02' AS trade_date, 9.0D AS close UNION ALL SELECT 'AAA', DATE '2020-01-03', 2.0D")
    for batch, n in ((one, 0), (two, 1), (two, 1)):
        incremental.append_absent(batch, n, out)
    got = spark.read.parquet(out)
    assert sorted(r["close"] for r in got.collect()) == [1.0, 2.0]
