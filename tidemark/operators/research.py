"""Universe, gate, evidence, hypotheses, risk, look-alikes, scan and ledger."""

from __future__ import annotations

from itertools import combinations

from ..functions import rules
from ..plans.relations import relation
from .measures import TRIGGERS

W = "OVER (PARTITION BY symbol ORDER BY trade_date)"
LOOKBACK, MIN_DAYS, MIN_VALUE, TIERS = 60, 40, 300_000, 3

# A session window over sparse rows: a range frame on the session number, no dense panel.
_S = f"OVER (PARTITION BY symbol ORDER BY session_no RANGE BETWEEN {LOOKBACK - 1} PRECEDING AND CURRENT ROW)"
relation(
    "liquid_universe",
    "bars",
    f"""SELECT symbol, trade_date, session_no, days, round(total / days, 4) AS avg_value FROM (
    SELECT symbol, trade_date, session_no, CAST(count(*) {_S} AS BIGINT) AS days, CAST(sum(raw_close * CAST(matched_volume * factor AS BIGINT)) {_S} AS DOUBLE) AS total FROM bars WHERE NOT excluded AND matched_volume > 0) t
    WHERE session_no >= {LOOKBACK} AND days >= {MIN_DAYS} AND total / days >= {MIN_VALUE}""",
)
relation(
    "tiers",
    "liquid_universe",
    f"""SELECT symbol, trade_date, CAST(ceil((2.0 * r + peers - 1) * {TIERS} / (2.0 * n)) AS INT) AS tier FROM (
    SELECT symbol, trade_date, rank() OVER (PARTITION BY trade_date ORDER BY avg_value) AS r, count(*) OVER (PARTITION BY trade_date, avg_value) AS peers, count(*) OVER (PARTITION BY trade_date) AS n FROM liquid_universe) t""",
)
relation("liquid_on_latest", "liquid_universe", "SELECT symbol, avg_value FROM liquid_universe WHERE session_no = (SELECT max(session_no) FROM liquid_universe)")

# Fixed values of the registered protocol.
CONDITIONS = {
    "rvol_high": "rvol >= 1.5",
    "above_ma_50": "price_vs_ma_50 > 0",
    "ma_50_rising": "ma_50_slope > 0",
    "at_support": "near_support = 1",
    "at_resistance": "near_resistance = 1",
    "market_up": "index_above_ma_50 = 1",
    "breadth_positive": "breadth_advance_share_10d >= 0.5",
    "volume_dry": "volume_dry_up = 1",
}
HORIZONS, MIN_OCCURRENCES, FDR, SUSPICIOUS, BLOCK_SESSIONS, MIN_EDGE = (3, 5), 30, 0.10, 0.75, 10, 0.03
NUMERIC = ("rvol", "up_down_volume_ratio", "price_vs_ma_20", "price_vs_ma_50", "ma_20_slope", "ma_50_slope", "price_change_10d", "price_change_20d", "range_rel_20d", "body_to_range", "upper_wick_to_range", "lower_wick_to_range", "open_gap")
BOOLEAN = ("near_support", "near_resistance", "volume_dry_up", "index_above_ma_50")
MIN_KNOWN, LOOK_ALIKES = 0.8, 50
# The fixture's slices: its sessions lie in 2012 to 2018.
VALIDATE, HOLDOUT, BEFORE = "DATE '2016-01-01'", "DATE '2017-01-01'", "DATE '2018-01-01'"

_inputs = {n: c.split()[0] for n, c in CONDITIONS.items()}
for _k in HORIZONS:
    relation(
        f"gate_k{_k}",
        f"fingerprint_wide outcomes_k{_k} tiers",
        f"""SELECT f.*, t.tier, o.known_on, o.flagged, CASE WHEN o.reason IS NOT NULL THEN o.reason WHEN t.tier IS NULL THEN 'not_liquid' WHEN o.flagged THEN 'fill_flagged' WHEN o.known_on IS NULL OR o.known_on >= {BEFORE} THEN 'not_yet_known' END AS blank,
        o.ret, o.net, o.mfe, o.mae FROM fingerprint_wide f JOIN outcomes_k{_k} o ON o.symbol = f.symbol AND o.trade_date = f.trade_date LEFT JOIN tiers t ON t.symbol = f.symbol AND t.trade_date = f.trade_date WHERE f.trade_date < {BEFORE}""",
    )
relation("gate_rows", "gate_k3", "SELECT symbol, trade_date, tier, CASE WHEN blank IS NULL THEN net END AS net, blank FROM gate_k3")
relation("gate_reasons", "gate_rows", "SELECT coalesce(blank, 'kept') AS reason, CAST(count(*) AS BIGINT) AS n FROM gate_rows GROUP BY coalesce(blank, 'kept')")
relation("combo_query", "fingerprint_wide", "SELECT symbol, CAST(count(*) AS BIGINT) AS judged, CAST(sum(CASE WHEN doji = 1 AND rvol >= 1.2 THEN 1 ELSE 0 END) AS BIGINT) AS occurrences FROM fingerprint_wide WHERE doji IS NOT NULL AND rvol IS NOT NULL GROUP BY symbol")
relation("combo_hits", "fingerprint_wide", "SELECT symbol, trade_date, CASE WHEN doji IS NOT NULL AND rvol IS NOT NULL THEN CASE WHEN doji = 1 AND rvol >= 1.2 THEN 1 ELSE 0 END END AS hit FROM fingerprint_wide")

# Hypotheses as bits: a row fires a trigger under a set of conditions iff all inputs are known and hold.
PAIRS = [()] + [(c,) for c in CONDITIONS] + list(combinations(CONDITIONS, 2))
_mask = {p: sum(1 << list(CONDITIONS).index(c) for c in p) for p in PAIRS}
_name = {p: "+".join(p) or "none" for p in PAIRS}
_masks = ", ".join(f"('{_name[p]}', {_mask[p]})" for p in PAIRS)
_known = " + ".join(f"CASE WHEN {_inputs[c]} IS NOT NULL THEN {1 << i} ELSE 0 END" for i, c in enumerate(CONDITIONS))
_true = " + ".join(f"CASE WHEN {CONDITIONS[c]} THEN {1 << i} ELSE 0 END" for i, c in enumerate(CONDITIONS))
_tk = " + ".join(f"CASE WHEN {t} IS NOT NULL THEN {1 << i} ELSE 0 END" for i, t in enumerate(TRIGGERS))
_tt = " + ".join(f"CASE WHEN {t} = 1 THEN {1 << i} ELSE 0 END" for i, t in enumerate(TRIGGERS))
ALL_TRIGGERS = (1 << len(TRIGGERS)) - 1
relation("masks", "", f"SELECT * FROM (VALUES {_masks}) AS v(conds, mask)")
relation("trigger_bits", "", "SELECT * FROM (VALUES " + ", ".join(f"('{t}', {1 << i})" for i, t in enumerate(TRIGGERS)) + ") AS v(trigger_name, bit)")
relation("vocabulary", "", "SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{_name[p]}', {k})" for t in TRIGGERS for p in PAIRS for k in HORIZONS) + ") AS v(trigger_name, conds, k)")
N_HYPOTHESES = len(TRIGGERS) * len(PAIRS) * len(HORIZONS)
# A row belongs to a slice if its outcome is known before the next one starts (the purge).
_slice = f"CASE WHEN trade_date < {VALIDATE} AND known_on < {VALIDATE} THEN 'discover' WHEN trade_date >= {VALIDATE} AND trade_date < {HOLDOUT} AND known_on < {HOLDOUT} THEN 'validate' WHEN trade_date >= {HOLDOUT} THEN 'holdout' END"
_first = lambda day: f"(SELECT min(session_no) FROM sessions WHERE trade_date >= {day})"
for _k in HORIZONS:
    relation(
        f"bits_k{_k}",
        f"gate_k{_k} sessions",
        f"""SELECT *, CAST(floor((session_no - CASE slice WHEN 'discover' THEN 1 WHEN 'validate' THEN {_first(VALIDATE)} ELSE {_first(HOLDOUT)} END) / {BLOCK_SESSIONS}.0) AS INT) AS block
        FROM (SELECT symbol, trade_date, session_no, {_k} AS k, net, ret, known_on, year(trade_date) AS y, CASE WHEN year(known_on) > year(trade_date) THEN 1 ELSE 0 END AS late, {_slice} AS slice,
          CASE WHEN net > 0 THEN 1 ELSE 0 END AS win, {_known} AS ck, {_true} AS ct, {_tk} AS tk, {_tt} AS tt, coalesce(CAST(index_above_ma_50 AS INT), -1) AS regime FROM gate_k{_k} WHERE blank IS NULL) t""",
    )
relation("bits", " ".join(f"bits_k{k}" for k in HORIZONS), " UNION ALL ".join(f"SELECT * FROM bits_k{k}" for k in HORIZONS))
# The base is summed by bit pattern first; the vocabulary then meets a small table.
relation("base_cells", "bits", "SELECT k, slice, tk, ck, y, late, regime, block, CAST(count(*) AS BIGINT) AS n, CAST(sum(win) AS BIGINT) AS wins FROM bits GROUP BY k, slice, tk, ck, y, late, regime, block")
_fits = "JOIN trigger_bits t ON ({0}.tk & t.bit) = t.bit JOIN masks m ON ({0}.ck & m.mask) = m.mask"
relation("base_split", "base_cells masks trigger_bits", f"SELECT c.k, c.slice, t.trigger_name, m.conds, c.y, c.late, c.regime, c.block, sum(c.n) AS n, sum(c.wins) AS wins FROM base_cells c {_fits.format('c')} GROUP BY c.k, c.slice, t.trigger_name, m.conds, c.y, c.late, c.regime, c.block")
H = "k, slice, trigger_name, conds"
relation("base_rates", "base_split", f"SELECT {H}, CAST(sum(n) AS BIGINT) AS base_n, CAST(sum(wins) AS BIGINT) AS base_wins FROM base_split WHERE slice IS NOT NULL GROUP BY {H}")
relation("fired", "bits masks trigger_bits", "SELECT b.*, t.trigger_name, m.conds FROM bits b JOIN trigger_bits t ON (b.tt & t.bit) = t.bit JOIN masks m ON (b.ck & m.mask) = m.mask AND (b.ct & m.mask) = m.mask WHERE b.tt > 0")
# De-clustering: of one symbol's occurrences each counts that comes more than k sessions after the last that counted.
_on = lambda a, b, cols: " AND ".join(f"{a}.{c.strip()} = {b}.{c.strip()}" for c in cols.split(","))
relation("kept_days", "fired", f"SELECT {H}, symbol, @rows_of(kept) AS session_no FROM (SELECT {H}, symbol, @spaced(session_no; k) AS kept FROM fired WHERE slice IS NOT NULL GROUP BY {H}, symbol) t")
relation("occurrences", "fired kept_days", f"SELECT f.* FROM fired f JOIN kept_days d ON {_on('f', 'd', H + ', symbol, session_no')}")
_count = "CAST(count(*) AS BIGINT) AS n_declustered, CAST(sum(win) AS BIGINT) AS wins, round(avg(net) + 1e-9, 6) AS expectancy, round(avg(ret) + 1e-9, 6) AS gross"
_rate = lambda a, b: f"CAST({a} AS DOUBLE) / {b}"
relation(
    "hypothesis_stats",
    "fired occurrences base_rates",
    f"""SELECT b.k, b.slice, b.trigger_name, b.conds, coalesce(r.n_raw, 0) AS n_raw, coalesce(o.n_declustered, 0) AS n_declustered, b.base_n, b.base_wins, coalesce(o.wins, 0) AS wins, round({_rate('o.wins', 'o.n_declustered')}, 6) AS hit_rate, round({_rate('b.base_wins', 'b.base_n')}, 6) AS base_rate,
    round({_rate('o.wins', 'o.n_declustered')} - {_rate('b.base_wins', 'b.base_n')}, 6) AS edge, o.expectancy, o.gross, coalesce(o.n_declustered, 0) >= {MIN_OCCURRENCES} AS testable, coalesce({_rate('o.wins', 'o.n_declustered')} > {SUSPICIOUS}, false) AS suspicious
    FROM base_rates b LEFT JOIN (SELECT {H}, CAST(count(*) AS BIGINT) AS n_raw FROM fired WHERE slice IS NOT NULL GROUP BY {H}) r ON {_on('r', 'b', H)} LEFT JOIN (SELECT {H}, {_count} FROM occurrences GROUP BY {H}) o ON {_on('o', 'b', H)}""",
)
# What the block bootstrap needs of each testable hypothesis; operators.bootstrap draws from it.
relation(
    "block_counts",
    "hypothesis_stats base_split occurrences",
    f"""SELECT b.k, b.trigger_name, b.conds, b.block, b.n AS base_n, b.wins AS base_wins, coalesce(o.n, 0) AS hit_n, coalesce(o.wins, 0) AS hit_wins
    FROM (SELECT {H}, block, CAST(sum(n) AS BIGINT) AS n, CAST(sum(wins) AS BIGINT) AS wins FROM base_split WHERE slice = 'discover' GROUP BY {H}, block) b
    JOIN hypothesis_stats h ON {_on('h', 'b', H)} AND h.testable
    LEFT JOIN (SELECT {H}, block, CAST(count(*) AS BIGINT) AS n, CAST(sum(win) AS BIGINT) AS wins FROM occurrences GROUP BY {H}, block) o ON {_on('o', 'b', H + ', block')}""",
)
# A two-sided normal tail, so that the verdict has a twin in SQL (polynomial for the error function, |error| < 1.5e-7).
_erfc = "t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-x * x)"
relation(
    "p_values",
    "vocabulary hypothesis_stats",
    f"""SELECT trigger_name, conds, k, n_declustered, edge, expectancy, testable, coalesce(round(CASE WHEN testable THEN least(1.0E0, {_erfc}) END, 6), 1.0E0) AS p
    FROM (SELECT *, 1 / (1 + 0.3275911 * x) AS t FROM (SELECT v.trigger_name, v.conds, v.k, coalesce(h.n_declustered, 0) AS n_declustered, h.edge, h.expectancy, coalesce(h.testable, false) AS testable,
      abs({_rate('h.wins', 'nullif(h.n_declustered, 0)')} - {_rate('h.base_wins', 'h.base_n')}) / nullif(sqrt(2 * {_rate('h.base_wins', 'h.base_n')} * (1 - {_rate('h.base_wins', 'h.base_n')}) / nullif(h.n_declustered, 0)), 0) AS x
      FROM vocabulary v LEFT JOIN hypothesis_stats h ON h.slice = 'discover' AND h.trigger_name = v.trigger_name AND h.conds = v.conds AND h.k = v.k) a) b""",
)
# Every hypothesis of the vocabulary counts, tested or not.
relation(
    "bh_verdict",
    "p_values",
    f"""SELECT trigger_name, conds, k, p, testable AND rnk <= coalesce((SELECT max(rnk) FROM (SELECT p, row_number() OVER (ORDER BY p, trigger_name, conds, k) AS rnk FROM p_values) c WHERE p <= {FDR} * rnk / {N_HYPOTHESES}), 0) AS survived
    FROM (SELECT *, row_number() OVER (ORDER BY p, trigger_name, conds, k) AS rnk FROM p_values) t""",
)
for _by in ("y", "regime"):
    relation(
        f"splits_by_{ {'y': 'year'}.get(_by, _by) }",
        "occurrences base_split",
        f"""SELECT b.k, b.trigger_name, b.conds, b.{_by}, b.base_n, coalesce(o.n_declustered, 0) AS n_declustered, o.expectancy, round({_rate('o.wins', 'o.n_declustered')} - {_rate('b.base_wins', 'b.base_n')}, 6) AS edge
        FROM (SELECT {H}, {_by}, CAST(sum(n) AS BIGINT) AS base_n, sum(wins) AS base_wins FROM base_split WHERE slice = 'discover' GROUP BY {H}, {_by}) b LEFT JOIN (SELECT {H}, {_by}, {_count} FROM occurrences GROUP BY {H}, {_by}) o ON {_on('o', 'b', H + ', ' + _by)}""",
    )
# Year by year: an outcome known only in the next year is not that year's, and each year declusters anew.
Y = "k, y, trigger_name, conds"
relation("yearly_days", "fired", f"SELECT {Y}, symbol, @rows_of(kept) AS session_no FROM (SELECT {Y}, symbol, @spaced(session_no; k) AS kept FROM fired WHERE late = 0 GROUP BY {Y}, symbol) t")
relation(
    "walk_forward",
    "fired yearly_days base_split",
    f"""SELECT b.k, b.y, b.trigger_name, b.conds, coalesce(o.n, 0) AS n_declustered, round({_rate('o.wins', 'o.n')} - {_rate('b.wins', 'b.n')}, 6) AS edge
    FROM (SELECT {Y}, sum(n) AS n, sum(wins) AS wins FROM base_split WHERE late = 0 GROUP BY {Y}) b
    LEFT JOIN (SELECT f.k, f.y, f.trigger_name, f.conds, CAST(count(*) AS BIGINT) AS n, sum(f.win) AS wins FROM fired f JOIN yearly_days d ON {_on('f', 'd', Y + ', symbol, session_no')} GROUP BY f.k, f.y, f.trigger_name, f.conds) o ON {_on('o', 'b', Y)}""",
)
relation("years_positive", "walk_forward", "SELECT k, trigger_name, conds, CAST(count(*) AS BIGINT) AS years, CAST(sum(CASE WHEN edge > 0 THEN 1 ELSE 0 END) AS BIGINT) AS positive FROM walk_forward WHERE n_declustered > 0 GROUP BY k, trigger_name, conds")
_both = lambda s: f"FROM hypothesis_stats d JOIN hypothesis_stats v ON v.slice = '{s}' AND v.trigger_name = d.trigger_name AND v.conds = d.conds AND v.k = d.k WHERE d.slice = 'discover'"
relation("validate_verdict", "hypothesis_stats", f"SELECT d.trigger_name, d.conds, d.k, v.edge, v.expectancy, coalesce(sign(v.edge) = sign(d.edge) AND v.edge >= {MIN_EDGE} AND v.expectancy > 0, false) AS holds {_both('validate')}")
relation("holdout_verdict", "hypothesis_stats", f"SELECT d.trigger_name, d.conds, d.k, v.n_declustered, v.edge, v.expectancy, CASE WHEN NOT v.testable THEN 'NOT TESTABLE' WHEN sign(v.edge) = sign(d.edge) AND v.expectancy > 0 THEN 'ACCEPT' ELSE 'REJECT' END AS verdict {_both('holdout')}")
# The fixture's prices walk at random and nothing survives discovery there, so every ACCEPT of the holdout is a signal.
relation(
    "accepted_signals",
    "holdout_verdict validate_verdict trigger_bits masks",
    "SELECT h.trigger_name, h.conds, h.k, t.bit, m.mask, v.expectancy AS validate_expectancy FROM holdout_verdict h JOIN validate_verdict v ON v.trigger_name = h.trigger_name AND v.conds = h.conds AND v.k = h.k JOIN trigger_bits t ON t.trigger_name = h.trigger_name JOIN masks m ON m.conds = h.conds WHERE h.verdict = 'ACCEPT'",
)
relation("signal_families", "accepted_signals", "SELECT a.trigger_name, a.conds, a.k, CAST(count(*) AS BIGINT) AS related FROM accepted_signals a JOIN accepted_signals b ON a.trigger_name = b.trigger_name AND ((a.mask & b.mask) = a.mask OR (a.mask & b.mask) = b.mask) GROUP BY a.trigger_name, a.conds, a.k")
# evidence for one combination (doji, k = 3): stock, tier and market in one pass; the first level with enough declustered days counts
relation("evidence_rows", "gate_k3 kept_days", "SELECT g.symbol, g.tier, g.net, g.mfe, g.mae, d.session_no IS NOT NULL AS hit FROM gate_k3 g LEFT JOIN kept_days d ON d.k = 3 AND d.slice = 'discover' AND d.trigger_name = 'doji' AND d.conds = 'none' AND d.symbol = g.symbol AND d.session_no = g.session_no WHERE g.blank IS NULL AND g.doji IS NOT NULL AND g.trade_date < " + VALIDATE + " AND g.known_on < " + VALIDATE)
_won = "CASE WHEN net > 0 THEN 1.0E0 ELSE 0.0E0 END"
relation(
    "evidence_levels",
    "evidence_rows",
    f"""SELECT CASE WHEN symbol IS NOT NULL THEN 'stock' WHEN tier IS NOT NULL THEN 'tier' ELSE 'market' END AS level, coalesce(symbol, CAST(tier AS VARCHAR(9)), 'all') AS member, CAST(count(*) AS BIGINT) AS base_n, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) AS n_declustered,
    round(avg(CASE WHEN hit THEN {_won} END) + 1e-9, 6) AS hit_rate, round(avg({_won}) + 1e-9, 6) AS base_rate, round(avg(CASE WHEN hit THEN mfe END) + 1e-9, 6) AS mfe, round(min(CASE WHEN hit THEN mae END), 6) AS worst, sum(CASE WHEN hit THEN 1 ELSE 0 END) >= {MIN_OCCURRENCES} AS enough
    FROM evidence_rows GROUP BY GROUPING SETS ((symbol), (tier), ())""",
)
relation(
    "evidence_chosen",
    "evidence_levels evidence_rows",
    """SELECT symbol, level, member, n_declustered, hit_rate, base_rate FROM (SELECT s.symbol, e.level, e.member, e.n_declustered, e.hit_rate, e.base_rate, row_number() OVER (PARTITION BY s.symbol ORDER BY CASE e.level WHEN 'stock' THEN 0 WHEN 'tier' THEN 1 ELSE 2 END) AS nth
    FROM (SELECT symbol, symbol AS member FROM evidence_rows GROUP BY symbol UNION ALL SELECT symbol, CAST(max(tier) AS VARCHAR(9)) FROM evidence_rows GROUP BY symbol UNION ALL SELECT symbol, 'all' FROM evidence_rows GROUP BY symbol) s JOIN evidence_levels e ON e.member = s.member WHERE e.enough OR e.level = 'market') t WHERE nth = 1""",
)
relation("cost_sensitivity", "occurrences", "SELECT k, trigger_name, " + ", ".join(f"round(avg({rules.net_return('ret', fee=c)}) + 1e-9, 6) AS net_fee_{i}" for i, c in enumerate((0.001, 0.0015, 0.0025))) + f", round({rules.break_even('avg(ret)')}, 6) AS break_even FROM occurrences WHERE conds = 'none' AND slice = 'discover' GROUP BY k, trigger_name")
relation("freeze_date", "gate_k3 gate_k5 sessions", f"SELECT first_pending, last_session, (SELECT max(trade_date) FROM sessions WHERE trade_date < first_pending) AS frozen_on, @plus_days(last_session; 1) AS cutoff FROM (SELECT min(CASE WHEN blank = 'not_yet_known' THEN trade_date END) AS first_pending, max(trade_date) AS last_session FROM (SELECT trade_date, blank FROM gate_k3 UNION ALL SELECT trade_date, blank FROM gate_k5) g) t")
# risk on the declustered trade list of one hypothesis
relation("trades", "occurrences", "SELECT symbol, trade_date, session_no, known_on, net FROM occurrences WHERE conds = 'none' AND trigger_name = 'doji' AND k = 3 AND slice = 'discover'")
relation("per_trade", "trades", "SELECT CAST(count(*) AS BIGINT) AS n, round(avg(net) + 1e-9, 6) AS mean, round(avg(CASE WHEN net > 0 THEN net END) + 1e-9, 6) AS avg_win, round(avg(CASE WHEN net <= 0 THEN net END) + 1e-9, 6) AS avg_loss, round(avg(CASE WHEN net > 0 THEN net END) / nullif(-avg(CASE WHEN net <= 0 THEN net END), 0) + 1e-9, 6) AS payoff, round(max(net), 6) AS best, round(min(net), 6) AS worst FROM trades")
relation("basket", "trades", "SELECT trade_date, CAST(count(*) AS BIGINT) AS n, round(avg(net) + 1e-9, 6) AS mean_net FROM trades GROUP BY trade_date")
# sums of exact decimals: a running total of doubles depends on the order of its terms
relation("daily_net", "basket", "SELECT trade_date, CAST(mean_net AS DECIMAL(18,6)) AS net FROM basket")
relation("drawdown", "daily_net", "SELECT CAST(coalesce(min(total - CASE WHEN peak > 0 THEN peak ELSE 0 END), 0) AS DOUBLE) AS max_drawdown FROM (SELECT total, max(total) OVER (ORDER BY trade_date) AS peak FROM (SELECT trade_date, sum(net) OVER (ORDER BY trade_date) AS total FROM daily_net) t) u")
relation("losing_streak", "basket", "SELECT CAST(coalesce(max(n), 0) AS BIGINT) AS worst_streak FROM (SELECT g, count(*) AS n FROM (SELECT mean_net, row_number() OVER (ORDER BY trade_date) - row_number() OVER (PARTITION BY CASE WHEN mean_net <= 0 THEN 1 ELSE 0 END ORDER BY trade_date) AS g FROM basket) t WHERE mean_net <= 0 GROUP BY g) u")
relation("losing_windows", "daily_net", "SELECT round(avg(CASE WHEN s <= 0 THEN 1.0E0 ELSE 0.0E0 END) + 1e-9, 6) AS losing_share FROM (SELECT sum(net) OVER (ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS s, count(*) OVER (ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS c FROM daily_net) t WHERE c = 20")
# a day's stake is busy until the last of its exits; it counts on days before that
relation("max_open", "trades", "SELECT CAST(coalesce(max(open_now), 0) AS BIGINT) AS max_open FROM (SELECT sum(sum(d)) OVER (ORDER BY day) AS open_now FROM (SELECT trade_date AS day, 1 AS d FROM trades GROUP BY trade_date UNION ALL SELECT max(known_on), -1 FROM trades GROUP BY trade_date) e GROUP BY day) u")
relation("monthly", "daily_net", "SELECT @month(trade_date) AS month, CAST(sum(net) AS DOUBLE) AS total FROM daily_net GROUP BY @month(trade_date)")
# look-alikes of every liquid stock of the last session: the same fired set, all triggers known
relation("fired_sets", "bits_k3", "SELECT tt, CAST(count(*) AS BIGINT) AS n, round(avg(net) + 1e-9, 6) AS mean_net FROM bits_k3 GROUP BY tt")
_pct = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY trade_date ORDER BY {c} NULLS LAST) + (count(*) OVER (PARTITION BY trade_date, {c}) - 1) / 2.0E0) / count({c}) OVER (PARTITION BY trade_date) END AS {c}" for c in NUMERIC)
# ranks are among all liquid rows of the day; rows with an unknown trigger have no fired set
relation("encoded", "fingerprint_wide tiers", f"SELECT symbol, trade_date, CASE WHEN {_tk} = {ALL_TRIGGERS} THEN {_tt} END AS fired, {_pct}, {', '.join(BOOLEAN)} FROM (SELECT f.* FROM fingerprint_wide f JOIN tiers t ON t.symbol = f.symbol AND t.trade_date = f.trade_date) l")
_cols = NUMERIC + BOOLEAN
_n = " + ".join(f"CASE WHEN e.{c} IS NOT NULL AND q.{c} IS NOT NULL THEN 1 ELSE 0 END" for c in _cols)
_d = " + ".join(f"coalesce(abs(e.{c} - q.{c}), 0)" for c in _cols)
relation(
    "look_alikes",
    "encoded gate_k3 gate_k5",
    f"""SELECT query_symbol, symbol, trade_date, round(distance, 6) AS distance, round(share, 6) AS known_share, symbol = query_symbol AS same_stock, net_3, net_5 FROM (
      SELECT *, row_number() OVER (PARTITION BY query_symbol ORDER BY round(distance, 9), trade_date, symbol) AS nth FROM (
        SELECT q.symbol AS query_symbol, e.symbol, e.trade_date, a.net AS net_3, b.net AS net_5, ({_n}) / {len(_cols)}.0E0 AS share, ({_d}) / greatest({_n}, 1) AS distance
        FROM encoded q JOIN encoded e ON e.fired = q.fired JOIN gate_k3 a ON a.symbol = e.symbol AND a.trade_date = e.trade_date JOIN gate_k5 b ON b.symbol = e.symbol AND b.trade_date = e.trade_date
        WHERE q.trade_date = (SELECT max(trade_date) FROM encoded) AND a.blank IS NULL AND b.blank IS NULL AND a.known_on < q.trade_date AND b.known_on < q.trade_date) t WHERE share >= {MIN_KNOWN}) u WHERE nth <= {LOOK_ALIKES}""",
)
_w20 = f"{W[:-1]} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
relation("traded_value_20d", "bars", f"SELECT symbol, trade_date, round(CASE WHEN count(*) {_w20} = 20 THEN avg(close * matched_volume) {_w20} END, 4) AS traded_value FROM bars")
# the daily scan: accepted signals that fired, on every day after the holdout began
relation(
    "scan_candidates",
    "fingerprint_wide tiers bars traded_value_20d accepted_signals",
    f"""SELECT f.symbol, f.trade_date, a.trigger_name, a.conds, a.k, a.validate_expectancy, b.exchange, t.tier, v.traded_value, CASE WHEN t.tier IS NULL THEN 'not_liquid' WHEN b.exchange_unknown THEN 'undated' WHEN b.exchange = 'UPCOM' THEN 'upcom' END AS ineligible
    FROM (SELECT symbol, trade_date, {_tt} AS tt, {_known} AS ck, {_true} AS ct FROM fingerprint_wide WHERE trade_date >= {HOLDOUT}) f JOIN accepted_signals a ON (f.tt & a.bit) = a.bit AND (f.ck & a.mask) = a.mask AND (f.ct & a.mask) = a.mask
    JOIN bars b ON b.symbol = f.symbol AND b.trade_date = f.trade_date JOIN traded_value_20d v ON v.symbol = f.symbol AND v.trade_date = f.trade_date LEFT JOIN tiers t ON t.symbol = f.symbol AND t.trade_date = f.trade_date""",
)
# the tie-breaker's keys in order, and the first key on which a runner-up lost
_keys = {"exchange": "place", "validate_expectancy": "-validate_expectancy", "traded_value_20d": "-coalesce(traded_value, -1)", "tier": "-tier", "symbol": "symbol"}
_best = lambda c: f"first_value({c}) OVER (PARTITION BY trade_date ORDER BY {', '.join(_keys.values())}, trigger_name, conds, k)"
relation(
    "scan_rank",
    "scan_candidates",
    f"""SELECT trade_date, symbol, trigger_name, conds, k, pick, CASE WHEN pick > 1 THEN CASE {' '.join(f"WHEN {c} <> {_best(c)} THEN '{n}'" for n, c in _keys.items())} ELSE 'signal' END END AS lost_on
    FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY {', '.join(_keys.values())}, trigger_name, conds, k) AS pick FROM (SELECT *, CASE exchange WHEN 'HOSE' THEN 0 WHEN 'HNX' THEN 1 ELSE 2 END AS place FROM scan_candidates WHERE ineligible IS NULL) c) t""",
)
relation("scan_funnel", "scan_candidates", "SELECT trade_date, CAST(count(*) AS BIGINT) AS fired, CAST(sum(CASE WHEN ineligible IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS eligible, CAST(sum(CASE WHEN ineligible = 'not_liquid' THEN 1 ELSE 0 END) AS BIGINT) AS not_liquid, CAST(sum(CASE WHEN ineligible = 'undated' THEN 1 ELSE 0 END) AS BIGINT) AS undated, CAST(sum(CASE WHEN ineligible = 'upcom' THEN 1 ELSE 0 END) AS BIGINT) AS upcom FROM scan_candidates GROUP BY trade_date")
# the ledger: one proposal a day; void if its outcome was decided by the entry, stuck if no exit came
relation(
    "ledger_outcomes",
    "scan_rank outcomes_k3 outcomes_k5 sessions",
    """SELECT s.trade_date, s.symbol, s.trigger_name, s.conds, s.k, CASE WHEN o.reason = 'pending' OR o.symbol IS NULL THEN 'pending' WHEN o.net IS NOT NULL THEN 'scored' WHEN o.known_on IS NOT NULL AND o.known_on <= e.entry THEN 'void' ELSE 'stuck' END AS status, o.reason, o.net
    FROM scan_rank s LEFT JOIN (SELECT *, 3 AS k FROM outcomes_k3 UNION ALL SELECT *, 5 FROM outcomes_k5) o ON o.symbol = s.symbol AND o.trade_date = s.trade_date AND o.k = s.k
    LEFT JOIN (SELECT trade_date, lead(trade_date) OVER (ORDER BY trade_date) AS entry FROM sessions) e ON e.trade_date = s.trade_date WHERE s.pick = 1""",
)
relation("ledger_days", "ledger_outcomes", "SELECT trade_date, CAST(net AS DECIMAL(18,6)) AS net FROM ledger_outcomes WHERE status = 'scored'")
relation(
    "ledger_summary",
    "ledger_outcomes ledger_days",
    """SELECT signal_days, cumulative, drawdown, hit_rate, months, positive_months, first_day, last_day, n_pending, n_void, n_stuck,
    CASE WHEN signal_days < VERDICT_DAYS OR first_day IS NULL OR last_day < @plus_months(first_day; VERDICT_MONTHS) THEN 'NO VERDICT YET' WHEN n_stuck > 0 THEN 'WITHHELD' WHEN cumulative <= FAIL_AT OR drawdown < FAIL_DRAWDOWN THEN 'FAIL' WHEN cumulative > PASS_ABOVE AND drawdown >= PASS_DRAWDOWN AND positive_months * 2 > months THEN 'PASS' ELSE 'PROVISIONAL' END AS verdict
    FROM (SELECT CAST(count(*) AS BIGINT) AS signal_days, CAST(coalesce(sum(net), 0) AS DOUBLE) AS cumulative, round(avg(CASE WHEN net > 0 THEN 1.0E0 ELSE 0.0E0 END) + 1e-9, 6) AS hit_rate, min(trade_date) AS first_day, max(trade_date) AS last_day FROM ledger_days) a
    JOIN (SELECT CAST(coalesce(min(total - CASE WHEN peak > 0 THEN peak ELSE 0 END), 0) AS DOUBLE) AS drawdown FROM (SELECT total, max(total) OVER (ORDER BY trade_date) AS peak FROM (SELECT trade_date, sum(net) OVER (ORDER BY trade_date) AS total FROM ledger_days) t) u) b ON true
    JOIN (SELECT CAST(count(*) AS BIGINT) AS months, CAST(coalesce(sum(CASE WHEN total > 0 THEN 1 ELSE 0 END), 0) AS BIGINT) AS positive_months FROM (SELECT @month(trade_date) AS m, sum(net) AS total FROM ledger_days GROUP BY @month(trade_date)) t) c ON true
    JOIN (SELECT CAST(coalesce(sum(CASE WHEN status = 'pending' THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_pending, CAST(coalesce(sum(CASE WHEN status = 'void' THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_void, CAST(coalesce(sum(CASE WHEN status = 'stuck' THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_stuck FROM ledger_outcomes) d ON true""".replace("VERDICT_DAYS", "30").replace("VERDICT_MONTHS", "3").replace("FAIL_AT", "0").replace("FAIL_DRAWDOWN", "-1.5").replace("PASS_ABOVE", "0").replace("PASS_DRAWDOWN", "-1.0"),
)
