"""Forward outcomes: the first obstacle met between the signal and a bounded exit decides."""

from __future__ import annotations

from ..functions import rules
from ..plans.relations import relation

W = "OVER (PARTITION BY symbol ORDER BY trade_date)"
HORIZONS, MAX_DEFERRAL = (3, 5), 5
LAST = max(HORIZONS) + 1 + MAX_DEFERRAL

relation(
    "walk",
    "bars fillability sessions",
    f"""SELECT b.*, coalesce(f.entry_at_ceiling, false) AS at_ceiling, coalesce(f.exit_at_floor, false) AS at_floor, coalesce(f.flagged, true) AS unsure,
    b.matched_volume > 0 AS tradeable, {rules.sell_offset('b.trade_date')} AS sell_offset, (SELECT max(session_no) FROM sessions) AS last_session
    FROM bars b LEFT JOIN fillability f ON f.symbol = b.symbol AND f.trade_date = b.trade_date""",
)
_cols = ("gap_before", "factor_break", "excluded", "tradeable", "at_floor", "close", "high", "low", "trade_date", "unsure")
_lead = ", ".join(f"lead({c}, {m}) {W} AS {c}_{m}" for m in range(1, LAST + 1) for c in _cols)
relation("walked", "walk", f"SELECT *, {_lead}, lead(open, 1) {W} AS entry, lead(at_ceiling, 1) {W} AS ceil_1, lead(sell_offset, 1) {W} AS offset_1 FROM walk")


def _decide(k: int) -> tuple[str, str]:
    """CASE arms for the reason and for the step that decides."""
    arms = [("excluded", "'window_excluded'", "0")]

    def missing(m):
        return (f"close_{m} IS NULL", f"CASE WHEN session_no + {m} > last_session THEN 'pending' ELSE 'data_ends' END", "-1")

    arms += [missing(1), ("gap_before_1 > 0", "'no_next_session'", "1"), ("factor_break_1", "'factor_break'", "1"), ("excluded_1", "'window_excluded'", "1"), ("NOT tradeable_1", "'not_tradeable'", "1"), (f"{k} < offset_1", "'not_sellable'", "1"), ("ceil_1", "'entry_at_ceiling'", "1")]
    for m in range(2, k + 2 + MAX_DEFERRAL):
        arms += [missing(m), (f"gap_before_{m} > 0", "'window_gap'", f"{m}"), (f"factor_break_{m}", "'factor_break'", f"{m}"), (f"excluded_{m}", "'window_excluded'", f"{m}")]
        if m >= k + 1:
            arms += [(f"NOT tradeable_{m}", "'not_tradeable'", f"{m}"), (f"NOT at_floor_{m}", "'exit'", f"{m}")]
    reason = " ".join(f"WHEN {c} THEN {r}" for c, r, _ in arms)
    step = " ".join(f"WHEN {c} THEN {s}" for c, _, s in arms)
    return f"CASE {reason} ELSE 'exit_floor_unresolved' END", f"CASE {step} ELSE {k + 1 + MAX_DEFERRAL} END"


def _at(col: str, last: int) -> str:
    return "CASE step " + " ".join(f"WHEN {m} THEN {col}_{m}" for m in range(1, last + 1)) + " END"


def _best(fn: str, col: str, k: int, last: int) -> str:
    return "CASE step " + " ".join(f"WHEN {m} THEN {fn}({', '.join(f'{col}_{j}' for j in range(1, m + 1))})" for m in range(k + 1, last + 1)) + " END"


for _k in HORIZONS:
    _reason, _step = _decide(_k)
    _end = _k + 1 + MAX_DEFERRAL
    relation(f"decided_k{_k}", "walked", f"SELECT *, {_reason} AS why, {_step} AS step FROM walked")
    _flag = "(unsure_1 OR " + " OR ".join(f"(step >= {m} AND unsure_{m})" for m in range(_k + 1, _end + 1)) + ")"
    relation(
        f"outcomes_k{_k}",
        f"decided_k{_k}",
        f"""SELECT symbol, trade_date, round(ret, 6) AS ret, round({rules.net_return('ret')}, 6) AS net, round(mfe, 6) AS mfe, round(mae, 6) AS mae, exit_offset, deferred, known_on, reason, flagged
        FROM (SELECT symbol, trade_date, CASE WHEN why = 'exit' THEN {_at('close', _end)} / entry - 1 END AS ret, CASE WHEN why = 'exit' THEN {_best('greatest', 'high', _k, _end)} / entry - 1 END AS mfe,
        CASE WHEN why = 'exit' THEN {_best('least', 'low', _k, _end)} / entry - 1 END AS mae, CASE WHEN why = 'exit' THEN step END AS exit_offset, CASE WHEN why = 'exit' THEN step - {_k + 1} END AS deferred,
        CASE WHEN step = 0 THEN trade_date ELSE {_at('trade_date', _end)} END AS known_on, CASE WHEN why <> 'exit' THEN why END AS reason, CASE WHEN why = 'exit' THEN {_flag} END AS flagged FROM decided_k{_k}) t""",
    )
relation("outcome_reasons", "outcomes_k3 outcomes_k5", "SELECT 3 AS k, coalesce(reason, 'resolved') AS reason, CAST(count(*) AS BIGINT) AS n FROM outcomes_k3 GROUP BY coalesce(reason, 'resolved') UNION ALL SELECT 5, coalesce(reason, 'resolved'), CAST(count(*) AS BIGINT) FROM outcomes_k5 GROUP BY coalesce(reason, 'resolved')")
