"""The bar panel derived from the test tables: bars, sessions, adjustment, exchanges, limits, frames."""

from __future__ import annotations

from ..functions import rules
from ..plans.relations import relation

W = "OVER (PARTITION BY symbol ORDER BY trade_date)"

# First and last price of a day by one total order: partial aggregates, no sort.
_order = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
relation(
    "bars_ohlcv",
    "lineitem part",
    f"""SELECT symbol, b, trade_date, @first_by(px; {_order}) AS open, max(px) AS high, min(px) AS low, @last_by(px; {_order}) AS close, CAST(sum(qty) AS BIGINT) AS volume
    FROM (SELECT p_brand AS symbol, CAST(substr(p_brand, 7) AS INT) AS b, @plus_days(@monday(l_shipdate); 6209) AS trade_date,
      CAST(round(p_retailprice * (1 - l_discount) * 2) AS BIGINT) AS px, CAST(l_quantity AS BIGINT) AS qty, {_order} FROM lineitem JOIN part ON l_partkey = p_partkey) t
    WHERE NOT (b = 7 AND trade_date BETWEEN DATE '2014-06-01' AND DATE '2014-12-31') GROUP BY symbol, b, trade_date""",
)
relation("sessions", "bars_ohlcv", "SELECT trade_date, CAST(row_number() OVER (ORDER BY trade_date) AS BIGINT) AS session_no FROM (SELECT DISTINCT trade_date FROM bars_ohlcv)")
relation(
    "membership",
    "part",
    """SELECT symbol, CASE WHEN b % 3 = 0 THEN 'HOSE' WHEN b % 3 = 1 THEN 'HNX' ELSE 'UPCOM' END AS exchange,
    CASE WHEN b % 3 = 1 THEN DATE '2013-07-01' ELSE DATE '2010-01-01' END AS valid_from, CAST(NULL AS DATE) AS valid_to, 'listing' AS source
    FROM (SELECT DISTINCT p_brand AS symbol, CAST(substr(p_brand, 7) AS INT) AS b FROM part)
    UNION ALL SELECT DISTINCT p_brand, 'HNX', DATE '2012-01-01', DATE '2014-06-30', 'filed_transfer' FROM part WHERE CAST(substr(p_brand, 7) AS INT) % 6 = 3""",
)
relation(
    "exchange_in_force",
    "bars_ohlcv membership",
    """SELECT r.symbol, r.trade_date, coalesce(m.exchange, CASE WHEN r.b % 3 = 0 THEN 'HOSE' WHEN r.b % 3 = 1 THEN 'HNX' ELSE 'UPCOM' END) AS exchange, m.exchange IS NULL AS exchange_unknown
    FROM bars_ohlcv r LEFT JOIN (
      SELECT x.symbol, x.trade_date, s.exchange, row_number() OVER (PARTITION BY x.symbol, x.trade_date ORDER BY CASE WHEN s.source = 'filed_transfer' THEN 0 ELSE 1 END, s.valid_from) AS pick
      FROM bars_ohlcv x JOIN membership s ON x.symbol = s.symbol AND x.trade_date >= s.valid_from AND (s.valid_to IS NULL OR x.trade_date <= s.valid_to)) m
    ON m.symbol = r.symbol AND m.trade_date = r.trade_date AND m.pick = 1""",
)
relation("excluded_windows", "part", "SELECT DISTINCT p_brand AS symbol, DATE '2015-03-02' AS valid_from, DATE '2015-04-13' AS valid_to FROM part WHERE CAST(substr(p_brand, 7) AS INT) % 10 = 3")
relation(
    "adjusted_bars",
    "bars_ohlcv",
    """SELECT symbol, b, trade_date, f AS factor, open * f AS open, high * f AS high, low * f AS low, close * f AS close, volume / f AS matched_volume,
    open AS raw_open, high AS raw_high, low AS raw_low, close AS raw_close, NOT (b % 5 = 4 AND trade_date < DATE '2013-01-07') AS volume_is_adjustable
    FROM (SELECT *, CASE WHEN b % 4 = 0 AND trade_date < DATE '2015-01-05' THEN CAST(0.8 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS f FROM bars_ohlcv) t""",
)
# a row in two overlapping windows is still one row
relation("excluded_days", "adjusted_bars excluded_windows", "SELECT DISTINCT a.symbol, a.trade_date FROM adjusted_bars a JOIN excluded_windows x ON x.symbol = a.symbol AND a.trade_date BETWEEN x.valid_from AND x.valid_to")
relation(
    "dated_bars",
    "adjusted_bars sessions exchange_in_force excluded_days",
    f"""SELECT *, CASE WHEN abs(factor - lag(factor) {W}) >= 1e-6 AND lag(factor) {W} IS NOT NULL THEN true ELSE false END AS factor_step,
    coalesce(session_no - lag(session_no) {W} - 1, 0) AS gap_before
    FROM (SELECT a.*, s.session_no, e.exchange, e.exchange_unknown, x.symbol IS NOT NULL AS excluded
      FROM adjusted_bars a JOIN sessions s ON a.trade_date = s.trade_date JOIN exchange_in_force e ON e.symbol = a.symbol AND e.trade_date = a.trade_date
      LEFT JOIN excluded_days x ON x.symbol = a.symbol AND x.trade_date = a.trade_date) t""",
)
# A step of the factor is usual on an ex-date; only one that moves the adjusted price beyond the limit is a defect.
relation(
    "factor_kinds",
    "dated_bars",
    f"""SELECT *, CASE WHEN factor_step AND volume_is_adjustable AND abs(move) > 2 * rate / 100.0 THEN
      CASE WHEN gap_before >= {rules.RESUMPTION_SESSIONS} THEN 'resumption' WHEN exchange <> was THEN 'new_exchange' ELSE 'defect' END END AS kind
    FROM (SELECT *, close / lag(close) {W} - 1 AS move, lag(exchange) {W} AS was, {rules.limit_rate('exchange', 'trade_date')} AS rate FROM dated_bars) t""",
)
relation(
    "bars",
    "factor_kinds",
    "SELECT symbol, b, trade_date, factor, open, high, low, close, matched_volume, raw_open, raw_high, raw_low, raw_close, volume_is_adjustable, session_no, exchange, exchange_unknown, excluded, factor_step, gap_before, coalesce(kind = 'defect', false) AS factor_break FROM factor_kinds",
)
relation("sessions_gap", "bars", "SELECT symbol, trade_date, session_no, CAST(gap_before AS BIGINT) AS gap_before, excluded FROM bars")
_ref = f"(lag(close) {W} * raw_close / close)"
relation("referenced", "bars", f"SELECT *, CAST(round({_ref}) AS BIGINT) AS ref, gap_before >= {rules.RESUMPTION_SESSIONS} OR lag(close) {W} IS NULL AS first_day FROM bars")
relation(
    "banded",
    "referenced",
    f"SELECT *, CASE WHEN first_day THEN {rules.first_day_rate('exchange')} ELSE {rules.limit_rate('exchange', 'trade_date')} END AS rate FROM referenced WHERE ref IS NOT NULL",
)
relation("limited", "banded", f"SELECT *, {rules.tick('exchange', 'trade_date', 'ref * (100 + rate) / 100.0')} AS up_tick, {rules.tick('exchange', 'trade_date', 'ref * (100 - rate) / 100.0')} AS down_tick FROM banded")
relation(
    "limits_all",
    "limited",
    """SELECT *, CASE WHEN c0 <= ref THEN ref + up_tick ELSE c0 END AS ceiling, CASE WHEN f0 >= ref THEN ref - down_tick ELSE f0 END AS floor
    FROM (SELECT *, CAST(floor(ref * (100 + rate) / (100.0 * up_tick) + 1e-9) AS BIGINT) * up_tick AS c0, CAST(ceil(ref * (100 - rate) / (100.0 * down_tick) - 1e-9) AS BIGINT) * down_tick AS f0 FROM limited) t""",
)
relation("limit_prices", "limits_all", "SELECT symbol, trade_date, ref, CAST(rate AS INT) AS rate, CAST(ceiling AS BIGINT) AS ceiling, CAST(floor AS BIGINT) AS floor, CAST(up_tick AS INT) AS up_tick FROM limits_all")
relation(
    "fillability",
    "limits_all",
    "SELECT symbol, trade_date, CAST(ceiling AS BIGINT) AS ceiling, CAST(floor AS BIGINT) AS floor, 2 * raw_open >= 2 * ceiling - up_tick AS entry_at_ceiling, 2 * raw_close <= 2 * floor + down_tick AS exit_at_floor, exchange_unknown OR exchange = 'UPCOM' AS flagged FROM limits_all",
)
relation("factor_triage", "factor_kinds", "SELECT symbol, trade_date, round(move, 6) AS move, kind FROM factor_kinds WHERE kind IS NOT NULL")
# market-wide frames: one row for each session
relation(
    "breadth_counts",
    "bars",
    f"""SELECT trade_date, CAST(sum(CASE WHEN m > 1e-9 THEN 1 ELSE 0 END) AS BIGINT) AS advancers, CAST(sum(CASE WHEN m < -1e-9 THEN 1 ELSE 0 END) AS BIGINT) AS decliners,
    CAST(sum(CASE WHEN abs(m) <= 1e-9 THEN 1 ELSE 0 END) AS BIGINT) AS unchanged, CAST(count(m) AS BIGINT) AS counted
    FROM (SELECT trade_date, CASE WHEN gap_before = 0 AND NOT excluded AND NOT coalesce(lag(excluded) {W}, false) THEN close / lag(close) {W} - 1 END AS m FROM bars) t GROUP BY trade_date""",
)
_D = "OVER (ORDER BY trade_date ROWS BETWEEN {} PRECEDING AND {})"


def _roll(fn: str, x: str, n: int, off: int = 0, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    frame = f"OVER ({part}ORDER BY trade_date ROWS BETWEEN {n - 1 + off} PRECEDING AND {f'{off} PRECEDING' if off else 'CURRENT ROW'})"
    call = f"@median({x})" if fn == "median" else f"{fn}({x})"
    return f"CASE WHEN count({x}) {frame} = {n} THEN {call} {frame} END"


relation(
    "breadth_measures",
    "breadth_counts",
    f"""SELECT trade_date, round(share, 6) AS breadth_advance_share, round({_roll('avg', 'share', 10)}, 6) AS breadth_advance_share_10d
    FROM (SELECT trade_date, CASE WHEN counted >= 0.8 * usual THEN CAST(advancers AS DOUBLE) / nullif(advancers + decliners, 0) END AS share
      FROM (SELECT *, {_roll('median', 'counted', 20, 1)} AS usual FROM breadth_counts) t) u""",
)
# the index misses two sessions of the fixture: a defect that no window may contain
relation(
    "index_bar",
    "bars_ohlcv",
    "SELECT trade_date, CAST(sum(open) AS BIGINT) AS open, CAST(sum(high) AS BIGINT) AS high, CAST(sum(low) AS BIGINT) AS low, CAST(sum(close) AS BIGINT) AS close, CAST(sum(volume) AS BIGINT) AS volume FROM bars_ohlcv WHERE trade_date NOT IN (DATE '2014-03-10', DATE '2016-05-02') GROUP BY trade_date",
)
_I = "OVER (ORDER BY trade_date)"
_whole = lambda n: f"row_number() {_I} > {n} AND sum(gap) OVER (ORDER BY trade_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = 0"
relation(
    "index_measures",
    "index_bar sessions",
    f"""SELECT trade_date, CASE WHEN {_whole(49)} THEN CASE WHEN close > ma THEN 1.0E0 ELSE 0.0E0 END END AS index_above_ma_50,
    round(CASE WHEN {_whole(59)} THEN ma / lag(ma, 10) {_I} - 1 END, 6) AS index_ma_50_slope,
    round(CASE WHEN {_whole(20)} THEN CAST(close AS DOUBLE) / lag(close, 20) {_I} - 1 END, 6) AS index_change_20d, round(CASE WHEN {_whole(59)} THEN close / high60 - 1 END, 6) AS index_drawdown_from_high
    FROM (SELECT *, CASE WHEN session_no - lag(session_no) {_I} > 1 THEN 1 ELSE 0 END AS gap, {_roll('avg', 'close', 50)} AS ma, CAST({_roll('max', 'close', 60)} AS DOUBLE) AS high60
      FROM (SELECT i.*, s.session_no FROM index_bar i JOIN sessions s ON s.trade_date = i.trade_date) t) u""",
)
# Two snapshots of labels; brand 25 has none.  A label holds from its snapshot to the next; before the first it is borrowed.
_b = "CAST(substr(p_brand, 7) AS INT)"
relation(
    "labels_dim",
    "part",
    f"""SELECT DISTINCT p_brand AS symbol, CONCAT('S', CAST({_b} % 5 AS VARCHAR(4))) AS sector, DATE '2014-01-06' AS snapshot_date FROM part WHERE {_b} <> 25
    UNION ALL SELECT DISTINCT p_brand, CONCAT('S', CAST(({_b} + CASE WHEN {_b} % 11 = 0 THEN 1 ELSE 0 END) % 5 AS VARCHAR(4))), DATE '2016-01-04' FROM part WHERE {_b} <> 25""",
)
relation("label_spans", "labels_dim", "SELECT symbol, sector, snapshot_date, min(snapshot_date) OVER (PARTITION BY symbol) AS first_known, lead(snapshot_date) OVER (PARTITION BY symbol ORDER BY snapshot_date) AS next_one FROM labels_dim")
relation(
    "labelled_bars",
    "bars label_spans",
    "SELECT b.*, l.sector, coalesce(b.trade_date < l.first_known, true) AS labels_current FROM bars b LEFT JOIN label_spans l ON l.symbol = b.symbol AND (b.trade_date >= l.snapshot_date OR l.snapshot_date = l.first_known) AND (l.next_one IS NULL OR b.trade_date < l.next_one)",
)
relation("sector_labels", "labelled_bars", "SELECT symbol, trade_date, sector, labels_current FROM labelled_bars")
relation(
    "sector_frame",
    "labelled_bars",
    f"SELECT trade_date, sector, CAST(count(m) AS BIGINT) AS counted, round(@median(m), 6) AS median_return, bool_or(labels_current) AS labels_current FROM (SELECT trade_date, sector, labels_current, CASE WHEN gap_before = 0 AND NOT excluded THEN close / lag(close) {W} - 1 END AS m FROM labelled_bars) t WHERE sector IS NOT NULL GROUP BY trade_date, sector",
)
relation(
    "sector_measures",
    "sector_frame",
    f"""SELECT trade_date, sector, round(exp({_roll('sum', 'lg', 20, 0, 'sector')}) - 1, 6) AS sector_change_20d,
    max(CASE WHEN labels_current THEN 1 ELSE 0 END) OVER (PARTITION BY sector ORDER BY trade_date ROWS BETWEEN 40 PRECEDING AND CURRENT ROW) AS flagged
    FROM (SELECT *, CASE WHEN counted >= 3 AND counted >= 0.8 * usual THEN ln(1 + median_return) END AS lg FROM (SELECT *, {_roll('median', 'counted', 20, 1, 'sector')} AS usual FROM sector_frame) t) u""",
)
relation("quarantine", "sector_measures", "SELECT trade_date, sector, CASE WHEN flagged = 0 THEN sector_change_20d END AS sector_change_20d FROM sector_measures")
