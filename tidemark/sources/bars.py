"""Files of bars, indices, negotiated volume, listings and labels as DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A stock's symbol.
SYMBOL = "^[A-Z]{3}$"
BARS = ("symbol", "trade_date", "exchange", "open", "high", "low", "close", "volume", "adj_close", "source_file")
SPANS = ("symbol", "exchange", "valid_from", "valid_to", "source")


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def latest_publication(spark: SparkSession, root: str) -> str:
    """The folder under ``root`` whose name comes last; publications are named by their date."""
    fs, p = _folder(spark, root)
    found = sorted(s.getPath().toString() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []
    if not found:
        raise FileNotFoundError(f"no publication under {root}")
    return found[-1]


def first_match(spark: SparkSession, folder: str, pattern: str) -> str:
    """The first file in ``folder`` that fits the glob ``pattern``."""
    fs, p = _folder(spark, f"{folder}/{pattern}")
    found = sorted(s.getPath().toString() for s in fs.globStatus(p) or [])
    if not found:
        raise FileNotFoundError(f"{pattern} not found in {folder}")
    return found[0]


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Text with ``<Header>`` names and a byte-order mark: symbol (upper case, trimmed), trade_date, numbers as double."""
    df = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    df = df.toDF(*[c.lstrip("\ufeff").strip().strip("<>").lower() for c in df.columns])
    keys = {"symbol": F.upper(F.trim("ticker")), "trade_date": F.to_date("dtyyyymmdd", "yyyyMMdd")}
    rest = [c for c in df.columns if c not in ("ticker", "dtyyyymmdd")]
    return df.select(*[x.alias(n) for n, x in keys.items()], *[F.col(c).cast("double").alias(c) for c in rest])


def _name(path: str) -> str:
    return path.rpartition("/")[2]


def stocks(spark: SparkSession, folder: str, files: dict[str, tuple[str, str]]) -> DataFrame:
    """Unadjusted bars with the adjusted close beside them.

    ``files``: exchange -> glob of the adjusted file, of the unadjusted one.  The unadjusted file says what
    traded: a row of it without an adjusted partner keeps its bar, and its ``adj_close`` is null.
    """
    parts = []
    for exchange, (adjusted, raw) in files.items():
        path = first_match(spark, folder, raw)
        base = read_csv(spark, path).where(F.col("symbol").rlike(SYMBOL))
        close = read_csv(spark, first_match(spark, folder, adjusted)).select("symbol", "trade_date", F.col("close").alias("adj_close"))
        parts.append(base.join(close, ["symbol", "trade_date"], "left").withColumns({"exchange": F.lit(exchange), "source_file": F.lit(_name(path))}).select(*BARS))
    return _together(parts)


def daily_stocks(spark: SparkSession, folder: str, files: dict[str, tuple[str, str]], day) -> DataFrame:
    """One session of :func:`stocks`."""
    return stocks(spark, folder, files).where(F.col("trade_date") == F.lit(day))


def negotiated(spark: SparkSession, folder: str, files: dict[str, str]) -> DataFrame:
    """Published block trades: ``low`` holds the deal volume, ``high`` the matched volume for a check.

    A day without a row is unknown, not zero.
    """
    parts = []
    for pattern in files.values():
        path = first_match(spark, folder, pattern)
        rows = read_csv(spark, path).where(F.col("symbol").rlike(SYMBOL))
        parts.append(rows.select("symbol", "trade_date", F.col("low").alias("deal_volume"), F.col("high").alias("matched_check"), F.lit(_name(path)).alias("source_file")))
    return _together(parts)


def index_bars(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Index history without rows dated on a weekend."""
    rows = read_csv(spark, first_match(spark, folder, pattern)).where(F.weekday("trade_date") < 5)
    return rows.select("symbol", "trade_date", "open", "high", "low", "close", "volume")


def listings(spark: SparkSession, folder: str, exchanges: dict[str, str]) -> DataFrame:
    """One JSON file a symbol -> open-ended membership spans; unknown exchanges and dates that do not parse are left out."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("symbol", "exchange", "listing_date")])
    rows = spark.read.option("multiLine", True).schema(schema).json(folder)
    names = F.create_map(*[F.lit(x) for pair in exchanges.items() for x in pair])
    out = rows.select("symbol", names[F.col("exchange")].alias("exchange"), F.try_to_date("listing_date", "dd/MM/yyyy").alias("valid_from"))
    out = out.where("exchange is not null and valid_from is not null")
    return out.select("symbol", "exchange", "valid_from", F.lit(None).cast("date").alias("valid_to"), F.lit("listing").alias("source"))


def transfers(filed: DataFrame) -> DataFrame:
    """``filed``: symbol, exchange, valid_from, valid_to -> all spans of symbols filed under several exchanges."""
    several = filed.groupBy("symbol").agg(F.count_distinct("exchange").alias("n")).where("n > 1").select("symbol")
    return filed.join(several, "symbol", "left_semi").select("symbol", "exchange", "valid_from", "valid_to", F.lit("filed_transfer").alias("source"))


def membership(filed: DataFrame, listed: DataFrame, bars: DataFrame) -> DataFrame:
    """Transfers and listings together, less listings that a bar contradicts.

    A bar contradicts if it is filed under another exchange on or after the listing, on a day that no
    transfer span of the symbol covers.
    """
    moved = transfers(filed).where(F.col("symbol").rlike(SYMBOL))
    listed = listed.where(F.col("symbol").rlike(SYMBOL))
    m, r = moved.alias("m"), bars.select("symbol", "trade_date", "exchange").alias("r")
    covered = (F.col("m.symbol") == F.col("r.symbol")) & (F.col("r.trade_date") >= F.col("m.valid_from")) & (F.col("m.valid_to").isNull() | (F.col("r.trade_date") <= F.col("m.valid_to")))
    free = r.join(m, covered, "left_anti").alias("f")
    wrong = (F.col("f.symbol") == F.col("k.symbol")) & (F.col("f.trade_date") >= F.col("k.valid_from")) & (F.col("f.exchange") != F.col("k.exchange"))
    return moved.unionByName(listed.alias("k").join(free, wrong, "left_anti").select(*SPANS))


def sector_of(level2, level4, split: tuple[str, str]):
    """The level-2 code, except that one level-4 group is a sector of its own: ``split`` is (level 2, level 4)."""
    return F.when((level2 == split[0]) & (level4 == split[1]), F.lit(split[1])).otherwise(level2)


def labels_asof(days: DataFrame, labels: DataFrame) -> DataFrame:
    """``symbol, trade_date`` -> with ``sector`` of the latest snapshot by then and ``labels_current``.

    Before a symbol's first snapshot the earliest one is borrowed and flagged; a symbol without any
    has no sector and is flagged.
    """
    from pyspark.sql import Window

    by = Window.partitionBy("symbol")
    spans = labels.select("symbol", "sector", "snapshot_date").withColumns({"_first": F.min("snapshot_date").over(by), "_next": F.lead("snapshot_date").over(by.orderBy("snapshot_date"))})
    d, s = days.alias("d"), spans.alias("s")
    holds = (F.col("d.symbol") == F.col("s.symbol")) & ((F.col("d.trade_date") >= F.col("s.snapshot_date")) | (F.col("s.snapshot_date") == F.col("s._first"))) & (F.col("s._next").isNull() | (F.col("d.trade_date") < F.col("s._next")))
    return d.join(s, holds, "left").select("d.*", "s.sector", F.coalesce(F.col("d.trade_date") < F.col("s._first"), F.lit(True)).alias("labels_current"))


def _together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def settings(text: str) -> dict:
    """A configuration in JSON; YAML too where a parser is installed."""
    import json

    if re.match(r"\s*[{\[]", text):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise ValueError("no YAML parser is installed; give JSON") from e
    return yaml.safe_load(text)
