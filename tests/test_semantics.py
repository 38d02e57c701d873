"""Expected values on small frames of one's own: guard, outcomes, declustering, risk."""

import datetime as dt

import pytest

from tidemark import catalog  # noqa: F401  (registers the relations)
from tidemark.plans.relations import frame_on

BARS = "symbol string, b int, trade_date date, factor double, open double, high double, low double, close double, matched_volume double, raw_open double, raw_high double, raw_low double, raw_close double, volume_is_adjustable boolean, session_no long, exchange string, exchange_unknown boolean, excluded boolean, factor_step boolean, gap_before long, factor_break boolean"
START = dt.date(2020, 1, 6)


def day(i):
    return START + dt.timedelta(days=i)


def bars(spark, n=60, price=2000.0, **rows):
    """Flat bars of one stock; ``rows`` maps a column to {row: value}."""
    base = {"symbol": "AAA", "b": 1, "factor": 1.0, "open": price, "high": price, "low": price, "close": price, "matched_volume": 1000.0, "volume_is_adjustable": True, "exchange": "HOSE", "exchange_unknown": False, "excluded": False, "factor_step": False, "gap_before": 0, "factor_break": False}
    out = []
    for i in range(n):
        r = base | {"trade_date": day(i), "session_no": i + 1} | {c: v[i] for c, v in rows.items() if i in v}
        out.append(r | {f"raw_{c}": r.get(f"raw_{c}", r[c]) for c in ("open", "high", "low", "close")})
    names = [f.split()[0] for f in BARS.split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in names) for r in out], BARS)


def known(spark, frame, measure="measures_volume", column="rvol"):
    rows = frame_on(spark, measure, {"bars": frame}).orderBy("trade_date").collect()
    return [i for i, r in enumerate(rows) if r[column] is not None]


def test_window_needs_its_whole_run(spark):
    assert known(spark, bars(spark)) == list(range(20, 60))


def test_gap_on_the_first_row_of_a_window_is_allowed(spark):
    assert known(spark, bars(spark, gap_before={30: 3})) == [*range(20, 30), *range(50, 60)]


def test_factor_defect_breaks_as_a_gap_and_an_ex_date_does_not(spark):
    assert known(spark, bars(spark, factor_break={30: True}, factor_step={30: True})) == [*range(20, 30), *range(50, 60)]
    assert known(spark, bars(spark, factor_step={30: True})) == list(range(20, 60))


def test_excluded_and_unadjustable_rows_are_in_no_window(spark):
    assert known(spark, bars(spark, excluded={10: True})) == list(range(31, 60))
    assert known(spark, bars(spark, volume_is_adjustable={10: False})) == list(range(31, 60))
    assert known(spark, bars(spark, volume_is_adjustable={10: False}), "measures_trend", "ma_20") == list(range(19, 60))


def outcomes(spark, **rows):
    frame = bars(spark, 14, **rows)
    sessions = frame.select("trade_date", "session_no")
    got = frame_on(spark, "outcomes_k3", {"bars": frame, "sessions": sessions}).orderBy("trade_date").collect()
    return [(r["reason"], r["exit_offset"], r["net"]) for r in got]


COST = round((1 - 0.0025) / 1.0015 - 1, 6)


def test_outcome_of_a_flat_stock_is_its_costs(spark):
    got = outcomes(spark)
    assert got[1] == (None, 4, COST) and got[-1][0] == "pending"


def test_ex_date_keeps_the_outcome_and_a_defect_does_not(spark):
    assert outcomes(spark, factor_step={4: True})[2] == (None, 4, COST)
    assert outcomes(spark, factor_step={4: True}, factor_break={4: True})[2][0] == "factor_break"


def test_reasons(spark):
    assert outcomes(spark, gap_before={3: 1})[2][0] == "no_next_session"
    assert outcomes(spark, gap_before={5: 1})[2][0] == "window_gap"
    assert outcomes(spark, excluded={2: True})[2][0] == "window_excluded"
    assert outcomes(spark, matched_volume={3: 0.0})[2][0] == "not_tradeable"
    # locked at the floor on the exit day: the exit is deferred by a session
    assert outcomes(spark, close={6: 1860.0}, low={6: 1860.0}, raw_close={6: 1860.0})[2][1] == 5


def trades(spark, rows):
    return spark.createDataFrame([("AAA", day(d), d, day(e), net) for d, e, net in rows], "symbol string, trade_date date, session_no long, known_on date, net double")


def test_risk(spark):
    t = trades(spark, [(0, 4, -0.02), (1, 2, 0.05), (2, 9, -0.03), (3, 5, -0.04), (9, 12, 0.01)])
    one = lambda name: frame_on(spark, name, {"trades": t}).first()[0]
    assert one("drawdown") == pytest.approx(-0.07) and one("losing_streak") == 2
    # the stake of day 1 is free on day 2, that of day 2 on day 9
    assert one("max_open") == 3
    assert frame_on(spark, "drawdown", {"trades": trades(spark, [(0, 4, 0.02)])}).first()[0] == 0.0


def test_declustering(spark):
    cols = "k int, slice string, trigger_name string, conds string, symbol string, session_no long"
    rows = [(k, "discover", "doji", "none", s, n) for k in (3, 5) for s, at in (("AAA", (1, 2, 5, 6, 9, 20)), ("BBB", (4,))) for n in at]
    got = {}
    for r in frame_on(spark, "kept_days", {"fired": spark.createDataFrame(rows, cols)}).collect():
        got.setdefault((r["k"], r["symbol"]), []).append(r["session_no"])
    assert {x: sorted(v) for x, v in got.items()} == {(3, "AAA"): [1, 5, 9, 20], (5, "AAA"): [1, 9, 20], (3, "BBB"): [4], (5, "BBB"): [4]}


def test_given_frames_must_suffice(spark):
    with pytest.raises(ValueError, match="lineitem"):
        frame_on(spark, "bars", {})
