"""Registry of trailing-window measures and candle patterns per symbol.

A measure is a SQL expression over the guarded bar stages, with its lookback and what it needs.
The guard counts, once for each row, how far back the run without a trading gap, an
excluded row or a non-adjustable volume reaches; a factor that is wrong breaks the run as a gap does.  A window that reaches further is NULL, which is
neither false nor zero.  All windows share one partitioning and order: one exchange in all.
"""

from __future__ import annotations

from dataclasses import dataclass

from ..functions import rules
from ..plans.relations import relation

P = "PARTITION BY symbol ORDER BY trade_date"
W = f"OVER ({P})"
TOL = 1e-4


@dataclass(frozen=True)
class Measure:
    name: str
    family: str
    lookback: int
    sql: str
    volume: bool = False
    boolean: bool = False
    direction: str = ""


MEASURES: dict[str, Measure] = {}


def measure(name, family, lookback, sql, volume=False, known=None, direction=""):
    """``known``: inputs that must be known for a boolean measure; None for a numeric one."""
    if known is not None:
        sure = " AND ".join(f"{x} IS NOT NULL" for x in known)
        sql = f"CASE WHEN {sure} THEN CASE WHEN {sql} THEN 1.0E0 ELSE 0.0E0 END END"
    MEASURES[name] = Measure(name, family, lookback, sql, volume, known is not None, direction)


def frame(n, off=0):
    return f"OVER ({P} ROWS BETWEEN {n - 1 + off} PRECEDING AND {f'{off} PRECEDING' if off else 'CURRENT ROW'})"


def full(fn, x, n, off=0):
    return f"CASE WHEN count({x}) {frame(n, off)} = {n} THEN {fn}({x}) {frame(n, off)} END"


def lag(x, n=1):
    return f"lag({x}, {n}) {W}"


le = lambda a, b: f"{a} <= ({b}) * {1 + TOL}"
ge = lambda a, b: f"{a} >= ({b}) * {1 - TOL}"
lt = lambda a, b: f"{a} < ({b}) * {1 - TOL}"
gt = lambda a, b: f"{a} > ({b}) * {1 + TOL}"

relation(
    "guarded",
    "bars",
    f"""SELECT *, row_number() OVER (PARTITION BY symbol, run ORDER BY trade_date) - 1 AS pos,
    coalesce(rn - max(CASE WHEN excluded THEN rn END) {W}, 1000000) AS since_bad, coalesce(rn - max(CASE WHEN NOT volume_is_adjustable THEN rn END) {W}, 1000000) AS since_unadj
    FROM (SELECT *, row_number() {W} AS rn, sum(CASE WHEN gap_before > 0 OR factor_break THEN 1 ELSE 0 END) {W} AS run FROM bars) t""",
)
_tick = rules.floor_tick("exchange", "exchange_unknown", "trade_date", "raw_close")
_lags = ", ".join(f"{lag(c, k)} AS {c[0]}{k}" for c in ("open", "high", "low", "close") for k in (1, 2, 3))
relation(
    "stage1",
    "guarded",
    f"""SELECT *, abs(close - open) AS body, high - low AS rng, high - greatest(open, close) AS up, least(open, close) - low AS lo, abs(raw_close - raw_open) >= 3 * ftick AS body_ok, raw_high - raw_low >= 3 * ftick AS range_ok, {_lags}
    FROM (SELECT *, {_tick} AS ftick FROM guarded) t""",
)
_pivot = lambda x, fn, cmp: f"{fn}({x}) OVER ({P} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) = {x} AND {x} {cmp} {fn}({x}) OVER ({P} ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)"
relation(
    "stage2",
    "stage1",
    f"""SELECT *, matched_volume / nullif({full('avg', 'matched_volume', 20, 1)}, 0) AS rvol, {full('avg', 'close', 20)} AS ma20, {full('avg', 'close', 50)} AS ma50, {full('avg', 'matched_volume', 10)} AS v10,
    {full('avg', 'rng', 20, 1)} AS rng20, {full('avg', 'body', 20, 1)} AS body20, {full('avg', 'rng', 5)} AS rng5, {full('avg', 'rng', 20, 5)} AS rng20_5, {full('avg', 'raw_high - raw_low', 20, 5)} AS raw20_5, {full('max', 'high', 20, 1)} AS high20,
    {lag('body')} AS body1, {lag('body', 2)} AS body2, {lag('rng')} AS rng1, {lag('rng', 2)} AS rng2, {lag('up')} AS up1, {lag('up', 2)} AS up2, {lag('lo')} AS lo1, {lag('lo', 2)} AS lo2,
    coalesce({lag('body_ok')}, false) AS body_ok1, coalesce({lag('body_ok', 2)}, false) AS body_ok2, coalesce({lag('range_ok', 2)}, false) AS range_ok2,
    CASE WHEN {_pivot('low', 'min', '<')} THEN low END AS pivot_low, CASE WHEN {_pivot('high', 'max', '>')} THEN high END AS pivot_high FROM stage1""",
)
relation("stage3", "stage2", f"SELECT *, {lag('ma20', 5)} AS ma20_5, {lag('ma50', 10)} AS ma50_10, {lag('v10', 10)} AS v10_10, {lag('close', 10)} AS c10, {lag('close', 20)} AS c20, {lag('body20')} AS body20_1, {lag('body20', 2)} AS body20_2 FROM stage2")

# volume
measure("rvol", "volume", 20, "rvol", volume=True)
measure("sustained_volume", "volume", 26, f"CASE WHEN rvol IS NOT NULL OR pos >= 26 THEN CAST(sum(CASE WHEN rvol > 1.5 THEN 1 ELSE 0 END) {frame(7)} AS DOUBLE) END", volume=True)
_on = lambda s: f"sum(CASE WHEN close {s} c1 THEN matched_volume ELSE 0 END) {frame(20)}"
measure("up_down_volume_ratio", "volume", 20, f"{_on('>')} / nullif({_on('<')}, 0)", volume=True)
measure("price_volume_agreement", "volume", 19, "close / c10 - 1 >= 0.03 AND v10 / v10_10 - 1 >= 0.10", volume=True, known=("c10", "v10_10"))
measure("price_volume_divergence", "volume", 19, "close / c10 - 1 >= 0.03 AND v10 / v10_10 - 1 <= -0.10", volume=True, known=("c10", "v10_10"))
measure("traded_value", "volume", 0, "close * matched_volume", volume=True)
measure("volume_dry_up", "volume", 22, f"sum(CASE WHEN rvol < 0.7 THEN 1 ELSE 0 END) {frame(3)} = 3", volume=True, known=("rvol", lag("rvol"), lag("rvol", 2)))
# trend
measure("ma_20", "trend", 19, "ma20")
measure("ma_50", "trend", 49, "ma50")
measure("ma_20_slope", "trend", 24, "ma20 / ma20_5 - 1")
measure("ma_50_slope", "trend", 59, "ma50 / ma50_10 - 1")
measure("price_vs_ma_20", "trend", 19, "close / ma20 - 1")
measure("price_vs_ma_50", "trend", 49, "close / ma50 - 1")
measure("price_change_10d", "trend", 10, "close / c10 - 1")
measure("price_change_20d", "trend", 20, "close / c20 - 1")
# levels: the confirmed pivots of one frame, each compared with today's price
_near = lambda pivot, price: f"@near({pivot}; {price}; OVER ({P} ROWS BETWEEN 59 PRECEDING AND 2 PRECEDING)) >= 2"
measure("near_support", "levels", 61, _near("pivot_low", "low"), known=("low",))
measure("near_resistance", "levels", 61, _near("pivot_high", "high"), known=("high",))
# candles
measure("body_to_range", "candles", 0, "body / nullif(rng, 0)")
measure("upper_wick_to_range", "candles", 0, "up / nullif(rng, 0)")
measure("lower_wick_to_range", "candles", 0, "lo / nullif(rng, 0)")
measure("range_rel_20d", "candles", 20, "rng / nullif(rng20, 0)")
measure("open_gap", "candles", 1, "open / c1 - 1")
C = ("close",)
measure("hammer_shape", "candles", 0, "lo >= 2 * body AND up <= 0.5 * body AND least(open, close) >= low + 0.6667 * rng AND range_ok", known=C)
measure("inverted_hammer_shape", "candles", 0, "up >= 2 * body AND lo <= 0.5 * body AND greatest(open, close) <= low + 0.3333 * rng AND range_ok", known=C)
measure("doji", "candles", 0, "body <= 0.10 * rng AND range_ok", known=C)
measure("marubozu_green", "candles", 0, "close > open AND body >= 0.9 * rng AND range_ok", known=C, direction="bull")
measure("marubozu_red", "candles", 0, "close < open AND body >= 0.9 * rng AND range_ok", known=C, direction="bear")
# two candles
C1 = ("close", "c1")
measure("bullish_engulfing", "two_candle", 1, f"c1 < o1 AND {le('open', 'c1')} AND {ge('close', 'o1')} AND body >= body1 AND close > open AND body_ok1", known=C1, direction="bull")
measure("bearish_engulfing", "two_candle", 1, f"c1 > o1 AND {ge('open', 'c1')} AND {le('close', 'o1')} AND body >= body1 AND close < open AND body_ok1", known=C1, direction="bear")
CL = ("close", "c1", "body20_1")
measure("bullish_harami", "two_candle", 21, f"c1 < o1 AND body1 >= body20_1 AND {le('greatest(open, close)', 'o1')} AND {ge('least(open, close)', 'c1')} AND body <= 0.5 * body1 AND body_ok1", known=CL, direction="bull")
measure("bearish_harami", "two_candle", 21, f"c1 > o1 AND body1 >= body20_1 AND {le('greatest(open, close)', 'c1')} AND {ge('least(open, close)', 'o1')} AND body <= 0.5 * body1 AND body_ok1", known=CL, direction="bear")
measure("piercing_line", "two_candle", 1, f"c1 < o1 AND {lt('open', 'c1')} AND {gt('close', 'c1 + 0.5 * body1')} AND {lt('close', 'o1')} AND body_ok1", known=C1, direction="bull")
measure("dark_cloud_cover", "two_candle", 1, f"c1 > o1 AND {gt('open', 'c1')} AND {lt('close', 'c1 - 0.5 * body1')} AND {gt('close', 'o1')} AND body_ok1", known=C1, direction="bear")
# three candles
C2 = ("close", "c1", "c2")
CB = (*C2, "body20_2")
measure("morning_star", "three_candle", 22, f"c2 < o2 AND body2 >= body20_2 AND body1 <= 0.3 * body2 AND {lt('o1', 'c2')} AND close > open AND body >= body20_2 AND {gt('close', 'c2 + 0.5 * body2')} AND body_ok AND body_ok2", known=CB, direction="bull")
measure("evening_star", "three_candle", 22, f"c2 > o2 AND body2 >= body20_2 AND body1 <= 0.3 * body2 AND {gt('o1', 'c2')} AND close < open AND body >= body20_2 AND {lt('close', 'c2 - 0.5 * body2')} AND body_ok AND body_ok2", known=CB, direction="bear")
_in = lambda x, a, b: f"{ge(x, a)} AND {le(x, b)}"
_wick = lambda s: f"{s} <= 0.25 * rng AND {s}1 <= 0.25 * rng1 AND {s}2 <= 0.25 * rng2 AND body_ok AND body_ok1 AND body_ok2"
measure("three_white_soldiers", "three_candle", 2, f"c2 > o2 AND c1 > o1 AND close > open AND {_in('o1', 'o2', 'c2')} AND {_in('open', 'o1', 'c1')} AND c1 > c2 AND close > c1 AND {_wick('up')}", known=C2, direction="bull")
measure("three_black_crows", "three_candle", 2, f"c2 < o2 AND c1 < o1 AND close < open AND {_in('o1', 'c2', 'o2')} AND {_in('open', 'c1', 'o1')} AND c1 < c2 AND close < c1 AND {_wick('lo')}", known=C2, direction="bear")
_har = lambda red: f"c2 {'<' if red else '>'} o2 AND body2 >= body20_2 AND {le('greatest(o1, c1)', 'o2' if red else 'c2')} AND {ge('least(o1, c1)', 'c2' if red else 'o2')} AND body1 <= 0.5 * body2 AND body_ok2"
measure("three_inside_up", "three_candle", 22, f"{_har(True)} AND close > o2", known=CB, direction="bull")
measure("three_inside_down", "three_candle", 22, f"{_har(False)} AND close < o2", known=CB, direction="bear")
# consolidation
measure("tight_range", "consolidation", 24, "rng5 < 0.6 * rng20_5 AND raw20_5 >= 3 * ftick", known=("rng5", "rng20_5"))
measure("inside_day_run", "consolidation", 2, "high <= h1 AND low >= l1 AND rng < rng1 AND h1 <= h2 AND l1 >= l2 AND rng1 < rng2 AND range_ok2", known=C2)
measure("higher_lows", "consolidation", 3, "low > l1 AND l1 > l2 AND l2 > l3 AND greatest(high, h1, h2, h3) - least(high, h1, h2, h3) <= 0.02 * close", known=("l3",), direction="bull")
measure("breakout", "consolidation", 20, "close > high20", known=("high20",), direction="bull")

TRIGGERS = tuple(m.name for m in MEASURES.values() if m.boolean and m.family in ("candles", "two_candle", "three_candle", "consolidation"))


def masked(m: Measure) -> str:
    guard = f"pos >= {m.lookback} AND since_bad > {m.lookback}" + (f" AND since_unadj > {m.lookback}" if m.volume else "")
    return f"round(CASE WHEN {guard} THEN {m.sql} END, 6) AS {m.name}"


FAMILIES = {}
for _m in MEASURES.values():
    FAMILIES.setdefault(_m.family, []).append(_m)
for _f, _ms in FAMILIES.items():
    relation(f"measures_{_f}", "stage3", f"SELECT symbol, trade_date, {', '.join(masked(m) for m in _ms)} FROM stage3")
relation("panel_wide", "stage3", f"SELECT symbol, trade_date, session_no, {', '.join(masked(m) for m in MEASURES.values())} FROM stage3")
# the sector's value by the symbol's label of the day; flagged if either label is borrowed, or there is none
relation(
    "stock_vs_sector",
    "stage3 labelled_bars sector_measures",
    """SELECT b.symbol, b.trade_date, m.sector_change_20d, round(CASE WHEN b.pos >= 20 AND b.since_bad > 20 THEN b.close / b.c20 - 1 END - m.sector_change_20d, 6) AS stock_vs_sector_20d, coalesce(m.flagged, 1) = 1 OR l.labels_current AS flag_sector
    FROM stage3 b JOIN labelled_bars l ON l.symbol = b.symbol AND l.trade_date = b.trade_date LEFT JOIN sector_measures m ON m.trade_date = b.trade_date AND m.sector = l.sector""",
)
_market = ("i.index_above_ma_50", "i.index_ma_50_slope", "i.index_change_20d", "i.index_drawdown_from_high", "b.breadth_advance_share", "b.breadth_advance_share_10d", "s.sector_change_20d", "s.stock_vs_sector_20d", "s.flag_sector")
relation(
    "fingerprint_wide",
    "panel_wide index_measures breadth_measures stock_vs_sector",
    f"SELECT p.*, {', '.join(_market)} FROM panel_wide p LEFT JOIN index_measures i ON i.trade_date = p.trade_date LEFT JOIN breadth_measures b ON b.trade_date = p.trade_date LEFT JOIN stock_vs_sector s ON s.symbol = p.symbol AND s.trade_date = p.trade_date",
)
# what validated results may read: flagged values blank, flags gone
relation("fingerprint_quarantined", "fingerprint_wide", "SELECT symbol, trade_date, CASE WHEN NOT flag_sector THEN sector_change_20d END AS sector_change_20d, CASE WHEN NOT flag_sector THEN stock_vs_sector_20d END AS stock_vs_sector_20d FROM fingerprint_wide")
