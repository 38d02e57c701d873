"""Price limits, ticks, settlement and cost rules as SQL expressions (prices in hundredths)."""

from __future__ import annotations

# Rules with the date from which they hold (prices and ticks in hundredths, rates in whole percent).
LIMITS = {
    "HOSE": (("2000-07-28", 5), ("2013-01-15", 7)),
    "HNX": (("2005-07-14", 7), ("2013-01-15", 10)),
    "UPCOM": (("2009-06-24", 10), ("2013-01-15", 15)),
}
FIRST_DAY = {"HOSE": 20, "HNX": 30, "UPCOM": 40}
RESUMPTION_SESSIONS = 25
TICKS = {
    "HOSE": (("2000-07-28", ((5000, 10), (10000, 50), (None, 100))), ("2016-09-12", ((1000, 1), (5000, 5), (None, 10)))),
    "HNX": (("2005-07-14", ((None, 10),)),),
    "UPCOM": (("2009-06-24", ((None, 10),)),),
}
SELL_OFFSETS = (("2000-07-28", 3), ("2016-01-04", 3), ("2022-08-25", 2))
FEE, TAX = 0.0015, 0.001


def limit_rate(exchange: str, day: str) -> str:
    arms = [f"WHEN {exchange} = '{x}' AND {day} >= DATE '{since}' THEN {rate}" for x, eras in LIMITS.items() for since, rate in reversed(eras)]
    return f"CASE {' '.join(arms)} ELSE 7 END"


def first_day_rate(exchange: str) -> str:
    return f"CASE {' '.join(f'WHEN {exchange} = {x!r} THEN {r}' for x, r in FIRST_DAY.items())} ELSE 20 END"


def tick(exchange: str, day: str, price: str) -> str:
    """NULL before the exchange opened or for an unknown exchange."""
    arms = []
    for x, eras in TICKS.items():
        for since, bands in reversed(eras):
            for under, size in bands:
                more = f" AND {price} < {under}" if under else ""
                arms.append(f"WHEN {exchange} = '{x}' AND {day} >= DATE '{since}'{more} THEN {size}")
    return f"CASE {' '.join(arms)} END"


def max_tick(day: str, price: str) -> str:
    return "greatest(" + ", ".join(tick(f"'{x}'", day, price) for x in TICKS) + ")"


def floor_tick(exchange: str, unknown: str, day: str, price: str) -> str:
    return f"CASE WHEN {unknown} OR ({tick(exchange, day, price)}) IS NULL THEN {max_tick(day, price)} ELSE {tick(exchange, day, price)} END"


def sell_offset(day: str) -> str:
    arms = [f"WHEN {day} >= DATE '{since}' THEN {n}" for since, n in reversed(SELL_OFFSETS)]
    return f"CASE {' '.join(arms)} ELSE 3 END"


def net_return(gross: str, fee: float = FEE, tax: float = TAX) -> str:
    return f"((1 + {gross}) * (1 - {fee} - {tax}) / (1 + {fee}) - 1)"


def break_even(gross: str, tax: float = TAX) -> str:
    return f"(2 * ((1 + {gross}) * (1 - {tax}) - 1) / (2 + {gross}) + {tax})"
