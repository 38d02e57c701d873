"""Loading transforms, the data-quality checks, reconciliation and diagnostics."""

from __future__ import annotations

from ..plans.relations import relation

W = "OVER (PARTITION BY symbol ORDER BY trade_date)"
relation("daily", "lineitem part", "SELECT p_brand AS symbol, @day(l_shipdate) AS trade_date, min(CAST(round(p_retailprice * 100) AS BIGINT)) AS close, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS volume FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand, @day(l_shipdate)")
relation("weekend_shift", "daily", "SELECT symbol, trade_date, to_date, nth = 1 AND NOT taken AS moved FROM (SELECT w.symbol, w.trade_date, w.to_date, d.symbol IS NOT NULL AS taken, row_number() OVER (PARTITION BY w.symbol, w.to_date ORDER BY w.trade_date) AS nth FROM (SELECT symbol, trade_date, @plus_days(trade_date; 5 - @weekday(trade_date)) AS to_date FROM daily WHERE @weekday(trade_date) > 5) w LEFT JOIN daily d ON d.symbol = w.symbol AND d.trade_date = w.to_date) t")
relation("dedupe_first", "lineitem", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS nth FROM lineitem) t WHERE nth = 1")
relation("ohlc_reject", "bars_ohlcv", "SELECT symbol, CAST(sum(CASE WHEN open > 0 AND high > 0 AND low > 0 AND close > 0 AND low <= least(open, close) AND high >= greatest(open, close) AND volume >= 0 THEN 0 ELSE 1 END) AS BIGINT) AS rejected FROM bars_ohlcv GROUP BY symbol")
relation("symbol_master", "bars", "SELECT symbol, min(trade_date) AS first_date, max(trade_date) AS last_date, max_by(exchange, trade_date) AS exchange, max(trade_date) >= @plus_days((SELECT max(trade_date) FROM bars); -30) AS active FROM bars GROUP BY symbol")
relation("exchange_spans", "bars", "SELECT symbol, exchange, min(trade_date) AS valid_from, max(trade_date) AS valid_to, CAST(count(*) AS BIGINT) AS n FROM bars GROUP BY symbol, exchange")
relation("trading_day", "bars", "SELECT trade_date, exchange, CAST(count(*) AS BIGINT) AS symbols_traded FROM bars GROUP BY trade_date, exchange")
relation("transfer_gaps", "exchange_spans", "SELECT symbol, exchange, valid_to, nxt FROM (SELECT *, lead(valid_from) OVER (PARTITION BY symbol ORDER BY valid_from, exchange) AS nxt FROM exchange_spans) t WHERE nxt > valid_to")
relation("factor_repair", "adjusted_bars", "SELECT a.symbol, a.trade_date, round(a.factor * coalesce(exp(sum(ln(e.f))), 1), 6) AS factor FROM adjusted_bars a LEFT JOIN (SELECT DISTINCT symbol, DATE '2016-06-06' AS at, CAST(0.9 AS DOUBLE) AS f FROM adjusted_bars WHERE b % 6 = 1) e ON e.symbol = a.symbol AND a.trade_date < e.at GROUP BY a.symbol, a.trade_date, a.factor")
relation("excluded_rows", "bars", f"SELECT symbol, trade_date FROM (SELECT symbol, trade_date, max(CASE WHEN factor_step THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near_step FROM bars) t WHERE near_step = 1")
relation("seam_rescale", "adjusted_bars", "SELECT symbol, round(a / c, 6) AS ratio, abs(a / c - 1) > 0.02 AS rescale FROM (SELECT symbol, @median(CASE WHEN trade_date < DATE '2015-01-05' THEN close END) AS c, @median(CASE WHEN trade_date >= DATE '2015-01-05' THEN close END) AS a FROM (SELECT *, row_number() OVER (PARTITION BY symbol, trade_date < DATE '2015-01-05' ORDER BY CASE WHEN trade_date < DATE '2015-01-05' THEN session_back ELSE -session_back END) AS near_row FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS session_back FROM adjusted_bars) s) t WHERE near_row <= 5 GROUP BY symbol) u")
relation("missed_actions", "bars", f"SELECT symbol, trade_date, round(implied, 6) AS implied, rate FROM (SELECT symbol, trade_date, raw_close / CAST(lag(raw_close) {W} AS DOUBLE) AS implied FROM bars) t JOIN (SELECT * FROM (VALUES (0.05), (0.10), (0.15), (0.20), (0.25), (0.30), (0.50), (1.00)) AS v(rate)) r ON abs(implied * (1 + rate) - 1) <= 0.01")
relation("floor_runs", "limits_all", f"SELECT run_length, CAST(count(*) AS BIGINT) AS runs FROM (SELECT symbol, g, count(*) AS run_length FROM (SELECT symbol, low_close, row_number() {W} - row_number() OVER (PARTITION BY symbol, low_close ORDER BY trade_date) AS g FROM (SELECT symbol, trade_date, 2 * raw_close <= 2 * floor + down_tick AS low_close FROM limits_all) t) u WHERE low_close GROUP BY symbol, g) v GROUP BY run_length")
relation("index_repeats", "index_bar", "SELECT trade_date FROM (SELECT trade_date, open = lag(open) OVER (ORDER BY trade_date) AND high = lag(high) OVER (ORDER BY trade_date) AND low = lag(low) OVER (ORDER BY trade_date) AND close = lag(close) OVER (ORDER BY trade_date) AS same FROM index_bar) t WHERE same")
relation("missing_days", "bars sessions", "SELECT s.symbol, CAST(count(*) AS BIGINT) AS missing FROM (SELECT r.symbol, c.trade_date FROM (SELECT symbol, min(trade_date) AS lo, max(trade_date) AS hi FROM bars GROUP BY symbol) r JOIN sessions c ON c.trade_date BETWEEN r.lo AND r.hi) s LEFT JOIN bars b ON b.symbol = s.symbol AND b.trade_date = s.trade_date WHERE b.symbol IS NULL GROUP BY s.symbol")
# a second source, perturbed where the volume says so
relation("second_source", "bars_ohlcv", "SELECT symbol, trade_date, CASE WHEN volume % 7 = 0 THEN close * 1.01 ELSE close END AS close, CASE WHEN volume % 11 = 0 THEN volume + 5 ELSE volume END AS volume FROM bars_ohlcv WHERE volume % 13 <> 0")
for _c, _t in (("close", 0.005), ("volume", 0.01)):
    relation(
        f"reconcile_{_c}",
        "bars_ohlcv second_source",
        f"SELECT side, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN side = 'both' AND b > 0 AND abs(a - b) / b <= {_t} THEN 1 ELSE 0 END) AS BIGINT) AS matched, round(@median(CASE WHEN b > 0 THEN a / b END), 6) AS median_ratio FROM (SELECT CASE WHEN x.symbol IS NULL THEN 'right_only' WHEN y.symbol IS NULL THEN 'left_only' ELSE 'both' END AS side, CAST(x.{_c} AS DOUBLE) AS a, CAST(y.{_c} AS DOUBLE) AS b FROM bars_ohlcv x FULL JOIN second_source y ON x.symbol = y.symbol AND x.trade_date = y.trade_date) t GROUP BY side",
    )
relation("sample_by_year", "bars_ohlcv", "SELECT y, symbol, trade_date FROM (SELECT year(trade_date) AS y, symbol, trade_date, row_number() OVER (PARTITION BY year(trade_date) ORDER BY (volume * 7919 + close) % 10007, symbol, trade_date) AS nth FROM bars_ohlcv) t WHERE nth <= 10")

_CHECKS = {
    "bar_raw_not_empty": ("fail", "bars_ohlcv", "SELECT CASE WHEN count(*) > 0 THEN 0 ELSE 1 END FROM bars_ohlcv"),
    "adjusted_bars_match_factors": ("fail", "adjusted_bars bars_ohlcv", "SELECT abs((SELECT count(*) FROM adjusted_bars) - (SELECT count(*) FROM bars_ohlcv))"),
    "traded_value_invariant_under_adjustment": ("fail", "adjusted_bars bars_ohlcv", "SELECT count(*) FROM adjusted_bars a JOIN bars_ohlcv r ON r.symbol = a.symbol AND r.trade_date = a.trade_date WHERE abs(a.close * a.matched_volume - r.close * r.volume) > 1e-6 * r.close * r.volume"),
    "factor_never_above_one_in_research_window": ("fail", "adjusted_bars", "SELECT count(*) FROM adjusted_bars WHERE factor > 1 AND trade_date >= DATE '2012-01-01'"),
    "factor_never_above_one_whole_history": ("warn", "adjusted_bars", "SELECT count(*) FROM adjusted_bars WHERE factor > 1"),
    "seam_rescale_factors_exempted": ("warn", "seam_rescale", "SELECT count(*) FROM seam_rescale WHERE rescale"),
    "factor_is_one_on_latest_day": ("warn", "adjusted_bars", "SELECT count(*) FROM (SELECT max_by(factor, trade_date) AS f FROM adjusted_bars GROUP BY symbol) t WHERE abs(f - 1) > 1e-6"),
    "calendar_has_no_weekend_sessions": ("fail", "sessions", "SELECT count(*) FROM sessions WHERE @weekday(trade_date) > 5"),
    "calendar_matches_bar_raw": ("fail", "trading_day bars", "SELECT count(*) FROM trading_day c FULL JOIN (SELECT trade_date, exchange, count(*) AS n FROM bars GROUP BY trade_date, exchange) b ON b.trade_date = c.trade_date AND b.exchange = c.exchange WHERE b.n IS DISTINCT FROM c.symbols_traded"),
    "calendar_has_no_holiday_sessions": ("fail", "sessions", "SELECT count(*) FROM sessions WHERE trade_date IN (DATE '2012-01-02', DATE '2014-09-01')"),
    "bar_raw_has_no_holiday_rows": ("fail", "bars_ohlcv", "SELECT count(*) FROM bars_ohlcv WHERE trade_date IN (DATE '2012-01-02', DATE '2014-09-01')"),
    "index_has_no_weekend_rows": ("fail", "index_bar", "SELECT count(*) FROM index_bar WHERE @weekday(trade_date) > 5"),
    "sessions_have_a_plausible_number_of_symbols": ("warn", "bars", "SELECT count(*) FROM (SELECT trade_date FROM bars GROUP BY trade_date HAVING count(*) < 20) t"),
    "moves_beyond_price_limit_without_a_factor_change": ("warn", "limits_all", "SELECT count(*) FROM limits_all WHERE NOT factor_step AND (2 * raw_close > 2 * ceiling + up_tick OR 2 * raw_close < 2 * floor - down_tick)"),
    "bars_moved_off_a_weekend_date": ("warn", "weekend_shift", "SELECT count(*) FROM weekend_shift WHERE moved"),
    "symbols_with_many_missing_sessions": ("warn", "missing_days", "SELECT count(*) FROM missing_days WHERE missing > 10"),
    "index_has_no_repeated_sessions": ("warn", "index_repeats", "SELECT count(*) FROM index_repeats"),
    "index_covers_every_trading_session": ("warn", "sessions index_bar", "SELECT count(*) FROM sessions s WHERE NOT EXISTS (SELECT 1 FROM index_bar i WHERE i.trade_date = s.trade_date)"),
    "research_window_populated": ("fail", "bars_ohlcv", "SELECT CASE WHEN count(*) > 1000 THEN 0 ELSE 1 END FROM bars_ohlcv WHERE trade_date >= DATE '2012-01-01'"),
    "negotiated_volume_is_sparse_not_backfilled": ("warn", "events bars_ohlcv", "SELECT CASE WHEN (SELECT count(*) FROM events WHERE event_type = 'purchase') < (SELECT count(*) FROM bars_ohlcv) THEN 0 ELSE 1 END"),
}
for _n, (_sev, _needs, _sql) in _CHECKS.items():
    relation(f"check_{_n}", _needs, f"SELECT '{_n}' AS name, '{_sev}' AS severity, CAST(bad AS BIGINT) AS bad FROM (SELECT ({_sql}) AS bad) t")
relation("promotion", " ".join(f"check_{n}" for n in _CHECKS), "SELECT CASE WHEN sum(CASE WHEN severity = 'fail' AND bad > 0 THEN 1 ELSE 0 END) = 0 THEN 'good' ELSE 'failed' END AS status, CAST(sum(CASE WHEN bad > 0 THEN 1 ELSE 0 END) AS BIGINT) AS failing FROM (" + " UNION ALL ".join(f"SELECT * FROM check_{n}" for n in _CHECKS) + ") t")
relation("measure_report", "fingerprint_wide", " UNION ALL ".join(f"SELECT '{m}' AS measure, CAST(count({m}) AS BIGINT) AS scored, CAST(sum(CASE WHEN {m} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fires, round(@median({m}), 6) AS median, round(@pct({m}; 0.95), 6) AS p95 FROM fingerprint_wide" for m in ("rvol", "doji", "breakout", "price_vs_ma_20")))
relation("event_json", "events", "SELECT event_type, CAST(sum(@json_k(props)) AS BIGINT) AS k_total, CAST(count(DISTINCT user_id) AS BIGINT) AS users FROM events GROUP BY event_type")
