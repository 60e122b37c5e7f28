"""Comparison periods.

Month shifts keep the day number and overflow into the next month (31 March - 1 month = 3 March), whereas
Spark's add_months clamps to the month end; `shift_months` reproduces the overflow in both worlds.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

Period = tuple[dt.date, dt.date]


def shift_months(col: Column | str, months: int) -> Column:
    day = F.col(col) if isinstance(col, str) else col
    first = F.add_months(F.trunc(day, "MM"), months)
    return F.date_add(first, F.dayofmonth(day) - 1)


def shift_date(day: dt.date, months: int) -> dt.date:
    year, month0 = divmod(day.year * 12 + day.month - 1 + months, 12)
    return dt.date(year, month0 + 1, 1) + dt.timedelta(days=day.day - 1)


COMPARISON_SHIFTS = {"previous_year": -12, "previous_six_month": -6, "previous_three_month": -3, "previous_month": -1}
ROLLING_MONTHS = {"1y": 12, "6m": 6, "3m": 3}


def comparison_periods(start: dt.date, end: dt.date) -> dict[str, Period]:
    out = {"current": (start, end)}
    for name, shift in COMPARISON_SHIFTS.items():
        out[name] = (shift_date(start, shift), shift_date(end, shift))
    return out


def rolling_period(end: dt.date, months: int) -> tuple[Period, Period]:
    """The last `months` months up to `end`, and the same window one year earlier."""
    start = shift_date(end, -months) + dt.timedelta(days=1)
    return (start, end), (shift_date(start, -12), shift_date(end, -12))


def rolling_periods(end: dt.date) -> dict[str, Period]:
    out: dict[str, Period] = {}
    for name, months in ROLLING_MONTHS.items():
        out[f"t{name}_current"], out[f"t{name}_previous"] = rolling_period(end, months)
    return out


def span(periods: Mapping[str, Period]) -> Period:
    return min(p[0] for p in periods.values()), max(p[1] for p in periods.values())


def in_period(col: Column | str, period: Period) -> Column:
    day = F.col(col) if isinstance(col, str) else col
    return day.between(F.lit(period[0]), F.lit(period[1]))


def in_any(col: Column | str, periods: Mapping[str, Period]) -> Column:
    """Disjunction of the periods with overlapping ones merged, so it stays short and reaches the scan."""
    merged: list[list[dt.date]] = []
    for start, end in sorted(p for p in periods.values() if p[0] <= p[1]):
        if merged and start <= merged[-1][1] + dt.timedelta(days=1):
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    out = F.lit(False)
    for i, (start, end) in enumerate(merged):
        out = in_period(col, (start, end)) if i == 0 else out | in_period(col, (start, end))
    return out
