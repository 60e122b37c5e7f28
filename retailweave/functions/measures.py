"""Ratios, deltas, shares and their display forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(col: Column | str) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("double")


def pct_sql(current: str, previous: str, guard: str = "gt0") -> str:
    """(c-p)/p*100 as SQL text. `gt0` needs a positive base, `ne0` (the KPI cards) any non-zero one."""
    cur, prev = f"CAST({current} AS DOUBLE)", f"CAST({previous} AS DOUBLE)"
    test = "<>" if guard == "ne0" else ">"
    return f"CASE WHEN {prev} {test} 0 THEN ({cur} - {prev}) / {prev} * 100.0D END"


def ratio_sql(value: str, base: str) -> str:
    return f"CASE WHEN {base} > 0 THEN CAST({value} AS DOUBLE) / CAST({base} AS DOUBLE) ELSE 0.0D END"


def pct_change(current: Column | str, previous: Column | str, guard: str = "gt0") -> Column:
    if isinstance(current, str) and isinstance(previous, str):
        return F.expr(pct_sql(current, previous, guard))
    cur, prev = _d(current), _d(previous)
    ok = prev != 0 if guard == "ne0" else prev > 0
    return F.when(ok, (cur - prev) / prev * F.lit(100.0))


def ratio(value: Column | str, base: Column | str) -> Column:
    """value/base, 0 when the base is not positive (average baskets)."""
    if isinstance(value, str) and isinstance(base, str):
        return F.expr(ratio_sql(value, base))
    return F.when(_d(base) > 0, _d(value) / _d(base)).otherwise(F.lit(0.0))


def share(value: Column | str, base: Column | str) -> Column:
    return F.when(_d(base) > 0, _d(value) / _d(base) * F.lit(100.0)).otherwise(F.lit(0.0))


def margin_rate(margin: Column | str, total: Column | str) -> Column:
    return F.when(_d(total) > 0, _d(margin) / _d(total) * F.lit(100.0))


def delta_class(delta: Column | str) -> Column:
    value = _d(delta)
    return (
        F.when(value > 0, F.lit("delta-up")).when(value < 0, F.lit("delta-down")).otherwise(F.lit("delta-neutral"))
    )


def price_ratio(candidate: Column | str, source: Column | str) -> Column:
    cand, src = _d(candidate), _d(source)
    return F.when((cand > 0) & (src > 0), F.abs(cand - src) / src)


def fmt_count(value: Column | str) -> Column:
    return F.translate(F.format_number(F.round(_d(value), 0).cast("bigint"), 0), ",", " ")


def fmt_money(value: Column | str) -> Column:
    """1234.5 -> '1 235 €' (half away from zero)."""
    return F.concat(fmt_count(value), F.lit(" €"))


def _one_decimal(value: Column) -> Column:
    # + 0.0 turns a rounded -0.0 into 0.0
    return F.translate(F.format_number(F.round(value, 1) + F.lit(0.0), 1), ",.", " ,")


def fmt_pct(delta: Column | str) -> Column:
    """12.34 -> '+12,3 %'; null -> '--'."""
    value = _d(delta)
    sign = F.when(value > 0, F.lit("+")).otherwise(F.lit(""))
    return F.coalesce(F.concat(sign, _one_decimal(value), F.lit(" %")), F.lit("--"))


def fmt_share(value: Column | str, base: Column | str) -> Column:
    return F.concat(_one_decimal(share(value, base)), F.lit(" %"))
