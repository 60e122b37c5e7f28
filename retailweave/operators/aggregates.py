"""Single-period aggregates of the fact and the multi-period aggregate everything else stands on.

Distinct invoices are not additive over days, channels or brands, so they are always counted at the output
grain: rows are first merged per (keys, invoice) - a map-side combine shrinks hot keys before the shuffle - and
the second level only adds flags.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import labels as L
from .filters import Filters, apply_filters

MEASURES = {"total": "total_ht", "margin": "margin_ht", "qty": "quantity"}


def multi_period(
    rows: DataFrame,
    periods: Mapping[str, cal.Period],
    keys: Mapping[str, Column] | None = None,
    measures: Sequence[str] = ("total", "margin", "lines", "invoices"),
    carry: Mapping[str, Column] | None = None,
    splits: Mapping[str, Column] | None = None,
) -> DataFrame:
    """All periods in one scan: columns `<period>[_<split>]_<measure>` per key.

    `splits` are extra row conditions measured side by side (new / second-hand); `carry` columns keep their
    smallest value per key.
    """
    keys, carry = dict(keys or {}), dict(carry or {})
    slices: dict[str, Column] = {}
    for name, period in periods.items():
        inside = cal.in_period("invoice_date", period)
        for split, condition in (splits or {"": F.lit(True)}).items():
            slices[f"{name}_{split}" if split else name] = inside & condition if split else inside

    base = rows.select(
        *[expr.alias(name) for name, expr in keys.items()],
        *[expr.alias(name) for name, expr in carry.items()],
        *[cond.alias(f"__in_{name}") for name, cond in slices.items()],
        *[MEASURES[m] for m in measures if m in MEASURES],
        *(["invoice_number"] if "invoices" in measures else []),
    )
    # Plain SQL text from here on: dozens of like expressions, each one call to the JVM.
    sums = [
        f"sum(CASE WHEN __in_{name} THEN {MEASURES[m]} END) AS {name}_{m}"
        for name in slices
        for m in measures
        if m in MEASURES
    ]
    if "lines" in measures:
        sums += [f"sum(CASE WHEN __in_{name} THEN 1 ELSE 0 END) AS {name}_lines" for name in slices]
    kept = [f"min({name}) AS {name}" for name in carry]

    if "invoices" in measures:
        flags = [
            f"max(CASE WHEN __in_{name} AND invoice_number IS NOT NULL THEN 1 ELSE 0 END) AS {name}_invoices"
            for name in slices
        ]
        base = base.groupBy(*keys, "invoice_number").agg(*map(F.expr, sums + flags + kept))
        additive = [c for c in base.columns if c not in keys and c not in carry and c != "invoice_number"]
        sums = [f"sum({c}) AS {c}" for c in additive]

    out = base.groupBy(*keys).agg(*map(F.expr, sums + kept))
    return out.selectExpr(
        *keys, *carry, *[f"coalesce({c}, 0) AS {c}" for c in out.columns if c not in keys and c not in carry]
    )


def as_report(df: DataFrame) -> DataFrame:
    """Money and quantities as double, counts as bigint."""
    out = []
    for field in df.schema:
        kind = field.dataType.simpleString()
        if kind.startswith("decimal"):
            out.append(F.col(field.name).cast("double").alias(field.name))
        else:
            out.append(F.col(field.name))
    return df.select(*out)


def _totals(fact: DataFrame, filters: Filters, keys: Mapping[str, Column], measures: Sequence[str], **kw) -> DataFrame:
    periods = {"p": filters.period}
    out = multi_period(apply_filters(fact, filters, periods), periods, keys, measures, **kw)
    return out.withColumnsRenamed({f"p_{m}": n for m, n in NAMES.items()})


NAMES = {
    "total": "total_ht",
    "margin": "margin_ht",
    "qty": "quantity",
    "lines": "line_count",
    "invoices": "invoice_count",
}


def period_summary(fact: DataFrame, filters: Filters) -> DataFrame:
    """One row; zeros when nothing matches."""
    return as_report(_totals(fact, filters, {}, ("total", "margin", "invoices", "lines", "qty")))


def channel_totals(fact: DataFrame, filters: Filters) -> DataFrame:
    return as_report(
        _totals(fact, filters, {"channel_name": L.channel()}, ("total", "margin", "invoices", "lines"))
    )


def brand_name_carry() -> dict[str, Column]:
    """Smallest non-blank name of a brand id: one pass and mergeable, unlike picking a sub-total per label."""
    return {"brand_name": L.blank_to_null("brand_name")}


def goods(occasion: bool) -> Column:
    return L.is_occasion() if occasion else ~L.is_occasion()


def brand_totals(fact: DataFrame, filters: Filters, occasion: bool, channel: str | None = None) -> DataFrame:
    """By brand id. A brand seen under several labels is one row under its smallest non-blank one."""
    rows = fact.where(goods(occasion))
    if channel is not None:
        rows = rows.where(L.channel() == channel)
    return as_report(
        _totals(rows, filters, {"brand_id": L.brand_key()}, ("total", "margin", "invoices"), carry=brand_name_carry())
        .withColumn("brand_name", L.brand_label())
    )


def brand_channel_totals(fact: DataFrame, filters: Filters, occasion: bool) -> DataFrame:
    keys = {"brand_id": L.brand_key(), "channel_name": L.channel()}
    return as_report(_totals(fact.where(goods(occasion)), filters, keys, ("total", "invoices", "lines")))


def category_totals(fact: DataFrame, filters: Filters, occasion: bool) -> DataFrame:
    keys = {"category_name": L.category_path()}
    return as_report(_totals(fact.where(goods(occasion)), filters, keys, ("total",)))


def category_channel_totals(fact: DataFrame, filters: Filters, occasion: bool) -> DataFrame:
    keys = {"category_name": L.category_path(), "channel_name": L.channel()}
    return as_report(_totals(fact.where(goods(occasion)), filters, keys, ("total",)))


def goods_totals(fact: DataFrame, filters: Filters, occasion: bool) -> DataFrame:
    return as_report(_totals(fact.where(goods(occasion)), filters, {}, ("total", "lines", "invoices")))


def goods_channel_totals(fact: DataFrame, filters: Filters, occasion: bool) -> DataFrame:
    keys = {"channel_name": L.channel()}
    return as_report(_totals(fact.where(goods(occasion)), filters, keys, ("total", "lines", "invoices")))


def daily_totals(fact: DataFrame, filters: Filters) -> DataFrame:
    return as_report(
        apply_filters(fact, filters).groupBy("invoice_date").agg(F.sum("total_ht").alias("total_ht"))
    )


def filter_options(fact: DataFrame) -> DataFrame:
    """Distinct channels, brands and category paths in one pass: each row offers its three options, duplicates
    are merged before the shuffle."""
    option = lambda kind, value, label: F.struct(
        F.lit(kind).alias("kind"), value.cast("string").alias("value"), label.alias("label")
    )
    options = F.array(
        option("channel", L.channel(), L.channel_label(L.channel())),
        option("brand", L.brand_key(), L.brand_label()),
        option("category", L.category_path(), L.category_path()),
    )
    return fact.select(F.explode(options).alias("o")).select("o.*").distinct()


def count_detail(fact: DataFrame, filters: Filters, page_size: int = 50) -> DataFrame:
    return (
        apply_filters(fact, filters)
        .agg(F.count("*").alias("total_rows"))
        .withColumn("total_pages", F.greatest(F.lit(1), F.ceil(F.col("total_rows") / page_size)).cast("bigint"))
    )


GROUPINGS = {
    "idart": lambda: F.col("product_id").cast("string"),
    "brand": L.brand_label,
    "channel": L.channel,
    "category": L.category_path,
}


def grouped_detail(fact: DataFrame, filters: Filters, by: str = "idart") -> DataFrame:
    key = GROUPINGS.get(by, GROUPINGS["idart"])()
    return as_report(
        _totals(fact, filters, {"group_key": key}, ("total", "margin", "qty", "lines", "invoices"))
    )
