"""Period comparisons, highlights, movers, shares and trends, each from one scan of the fact."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import labels as L
from ..functions import measures as M
from ..session import written
from ..sources.incremental import top_k_per
from .aggregates import brand_name_carry, multi_period
from .filters import Filters, apply_filters

# Fixed values of the report.
TOP_HIGHLIGHTS = 8
TOP_CHANNELS_PER_KEY = 3
MOVER_FLOOR = 500
BASKET_FLOOR = 0.01
HOUSE_BRAND = "HM"
ALERT_BRANDS, ALERT_CHANNELS, MOVER_CHANNELS = 3, 4, 5
COMPARISON_CARDS = 4

CURRENT_VS_YEAR = ("current", "previous_year")
TRENDS = tuple(cal.ROLLING_MONTHS)


def report_periods(filters: Filters, trends: bool = True) -> dict[str, cal.Period]:
    periods = {k: v for k, v in filters.comparison_periods().items() if k in CURRENT_VS_YEAR}
    return periods | filters.rolling_periods() if trends else periods


def home_periods(filters: Filters) -> dict[str, cal.Period]:
    """Every period the home report reads."""
    return filters.comparison_periods() | filters.rolling_periods()


def trend(prefix_measure: str, name: str) -> Column:
    return M.pct_change(f"t{name}_current_{prefix_measure}", f"t{name}_previous_{prefix_measure}")


def trend_columns(measure: str = "total") -> list[Column]:
    return [trend(measure, name).alias(f"trend_{name}") for name in TRENDS]


def resolved_periods(ends: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Comparison and rolling periods of every (start, end) row, as columns."""
    cols = [F.col(start), F.col(end)]
    for name, shift in cal.COMPARISON_SHIFTS.items():
        cols += [
            cal.shift_months(start, shift).alias(f"{name}_start"),
            cal.shift_months(end, shift).alias(f"{name}_end"),
        ]
    return ends.select(*cols)


def rolling_windows(ends: DataFrame, end: str = "end") -> DataFrame:
    cols = [F.col(end)]
    for name, months in cal.ROLLING_MONTHS.items():
        start = F.date_add(cal.shift_months(end, -months), 1)
        cols += [
            start.alias(f"t{name}_current_start"),
            cal.shift_months(start, -12).alias(f"t{name}_previous_start"),
        ]
    return ends.select(*cols, cal.shift_months(end, -12).alias("previous_end"))


def outer_compare(current: DataFrame, previous: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Key union of two keyed tables; absent values count as 0."""
    cur = current.select(*keys, *[F.col(v).alias(f"current_{v}") for v in values])
    prev = previous.select(*keys, *[F.col(v).alias(f"previous_{v}") for v in values])
    return cur.join(prev, list(keys), "full_outer").fillna(
        0, [f"{side}_{v}" for side in ("current", "previous") for v in values]
    )


# --- cards --------------------------------------------------------------------------------------------


def objective(total: Column | str, target: float) -> list[Column]:
    value = (F.col(total) if isinstance(total, str) else total).cast("double")
    if target <= 0:
        null = F.lit(None).cast("double")
        return [F.lit(0.0).alias("objective_ht"), null.alias("objective_ratio"), null.alias("objective_remaining")]
    return [
        F.lit(float(target)).alias("objective_ht"),
        (value / F.lit(float(target)) * F.lit(100.0)).alias("objective_ratio"),
        F.greatest(F.lit(0.0), F.lit(float(target)) - value).alias("objective_remaining"),
    ]


def objective_summary(fact: DataFrame, filters: Filters, target: float) -> DataFrame:
    periods = {"current": filters.period}
    totals = multi_period(apply_filters(fact, filters, periods), periods, measures=("total",))
    return totals.select(*objective("current_total", target))


# Fixed values: (card, current value, compared value, trend measure, type).
CARDS = (
    ("CA période", "total", "previous_year", "money"),
    ("Marge période", "margin", "previous_year", "money"),
    ("Factures", "invoices", "previous_year", "count"),
    ("Panier moyen", "basket", "previous_year", "money"),
    ("CA vs mois précédent", "total", "previous_month", "money"),
    ("Objectif période", "total", "objective", "money"),
)


def _value(period: str, measure: str) -> str:
    if measure == "basket":
        return "(" + M.ratio_sql(f"{period}_total", f"{period}_invoices") + ")"
    return f"CAST({period}_{measure} AS DOUBLE)"


def kpi_cards(fact: DataFrame, filters: Filters, target: float = 0.0) -> DataFrame:
    """Six cards with their delta and three trends, from one multi-period row."""
    periods = {k: v for k, v in home_periods(filters).items() if "six" not in k and "three" not in k}
    row = multi_period(
        apply_filters(fact, filters, periods), periods, measures=("total", "margin", "invoices")
    )
    cards = []
    for position, (label, measure, base, kind) in enumerate(CARDS, start=1):
        current = _value("current", measure)
        if base == "objective":
            previous = f"{float(target)}D" if target > 0 else current
        else:
            previous = _value(base, measure)
        fields = {
            "position": str(position),
            "label": f"'{label}'",
            "type": f"'{kind}'",
            "current": current,
            "previous": previous,
            "delta": M.pct_sql(current, previous, guard="ne0"),
            **{f"trend_{t}": M.pct_sql(_value(f"t{t}_current", measure), _value(f"t{t}_previous", measure)) for t in TRENDS},
        }
        cards.append("named_struct(" + ", ".join(f"'{name}', {value}" for name, value in fields.items()) + ")")
    return row.selectExpr(f"inline(array({', '.join(cards)}))")


# --- channels -----------------------------------------------------------------------------------------


def _channel_periods(fact: DataFrame, filters: Filters, periods, measures, splits=None) -> DataFrame:
    return multi_period(
        apply_filters(fact, filters, periods), periods, {"channel_name": L.channel()}, measures, splits=splits
    )


def channel_summaries(fact: DataFrame, filters: Filters) -> DataFrame:
    """Channels with a line in the current period, against the previous year, with three trends."""
    periods = report_periods(filters)
    rows = _channel_periods(fact, filters, periods, ("total", "margin", "invoices", "lines"))
    basket, before = M.ratio("current_total", "current_invoices"), M.ratio("previous_year_total", "previous_year_invoices")
    return rows.where(F.col("current_lines") > 0).select(
        "channel_name",
        L.channel_label("channel_name").alias("label"),
        F.col("current_total").cast("double").alias("current"),
        F.col("current_margin").cast("double").alias("margin"),
        F.col("current_invoices").alias("invoices"),
        F.col("current_lines").alias("lines"),
        basket.alias("average_basket"),
        F.col("previous_year_total").cast("double").alias("previous"),
        F.col("previous_year_margin").cast("double").alias("previous_margin"),
        F.col("previous_year_invoices").alias("previous_invoices"),
        F.col("previous_year_lines").alias("previous_lines"),
        before.alias("previous_average_basket"),
        M.pct_change("current_total", "previous_year_total").alias("delta"),
        F.when(
            F.col("previous_year_invoices") > 0,
            (basket - before) / F.greatest(F.lit(BASKET_FLOOR), before) * F.lit(100.0),
        ).alias("basket_delta"),
        *trend_columns(),
    )


def channel_shares(fact: DataFrame, filters: Filters) -> DataFrame:
    """Share of company total, share of the largest channel and margin rate. The two bases are global aggregates
    of the per-channel totals, used as scalar sub-queries."""
    periods = {"current": filters.period}
    rows = _channel_periods(fact, filters, periods, ("total", "margin", "lines")).where("current_lines > 0")
    bases = rows.agg(F.sum("current_total").alias("s"), F.max("current_total").alias("m"))
    base = bases.select(F.struct("s", "m")).scalar()  # one sub-query, named twice
    return rows.select(
        "channel_name",
        F.col("current_total").cast("double").alias("current"),
        M.share("current_total", base["s"]).alias("share_global"),
        M.share("current_total", F.greatest(base["m"], F.lit(0))).alias("share_of_max"),
        M.margin_rate("current_margin", "current_total").alias("margin_percent"),
    )


# --- second-hand and new goods ------------------------------------------------------------------------


def goods_filter(fact: DataFrame, occasion: bool) -> DataFrame:
    return fact.where(L.is_occasion() if occasion else ~L.is_occasion())


def goods_summary(fact: DataFrame, filters: Filters, occasion: bool) -> DataFrame:
    """One row: current, previous year, delta and trends of one kind of goods."""
    periods = report_periods(filters)
    row = multi_period(
        apply_filters(goods_filter(fact, occasion), filters, periods), periods, measures=("total", "lines", "invoices")
    )
    return row.select(*_goods_columns())


def goods_channel_summaries(fact: DataFrame, filters: Filters, occasion: bool) -> DataFrame:
    """The same by channel, over the channels seen now or a year ago."""
    periods = report_periods(filters)
    rows = _channel_periods(goods_filter(fact, occasion), filters, periods, ("total", "lines", "invoices"))
    return (
        rows.where((F.col("current_lines") > 0) | (F.col("previous_year_lines") > 0))
        .select("channel_name", L.channel_label("channel_name").alias("label"), *_goods_columns())
        .orderBy(F.col("current_total").desc(), "channel_name")
    )


def _goods_columns() -> list[Column]:
    return [
        F.col("current_total").cast("double").alias("current_total"),
        F.col("previous_year_total").cast("double").alias("previous_total"),
        M.pct_change("current_total", "previous_year_total").alias("delta"),
        F.col("current_lines"),
        F.col("previous_year_lines").alias("previous_lines"),
        F.col("current_invoices"),
        F.col("previous_year_invoices").alias("previous_invoices"),
        *trend_columns(),
    ]


GOODS_SPLIT_NAMES = ("new", "occ")


def goods_splits() -> dict[str, Column]:
    return {"new": ~L.is_occasion(), "occ": L.is_occasion()}


def goods_comparison(fact: DataFrame, filters: Filters, k: int = COMPARISON_CARDS) -> DataFrame:
    """New against second-hand: the company card first, then channels by total, k cards in all."""
    periods = report_periods(filters, trends=False)
    rows = _channel_periods(fact, filters, periods, ("total", "lines"), goods_splits())
    seen = rows.where(
        F.col("current_new_lines") + F.col("current_occ_lines") + F.col("previous_year_new_lines")
        + F.col("previous_year_occ_lines") > 0
    )
    totals = [f"{p}_{s}_total" for p in CURRENT_VS_YEAR for s in GOODS_SPLIT_NAMES]
    cards = (
        seen.withColumn("label", L.channel_label("channel_name"))
        .rollup("label")
        .agg(F.grouping("label").alias("company"), *[F.sum(c).alias(c) for c in totals])
        .withColumns({"place": 1 - F.col("company"), "label": F.when(F.col("company") == 1, "Global").otherwise(F.col("label"))})
    )
    current = F.col("current_new_total") + F.col("current_occ_total")
    previous = F.col("previous_year_new_total") + F.col("previous_year_occ_total")
    return (
        cards.withColumns({"cur": current, "prev": previous})
        .orderBy("place", F.col("cur").desc(), "label")
        .limit(k)
        .select(
            "label",
            F.col("cur").cast("double").alias("current_total"),
            F.col("prev").cast("double").alias("previous_total"),
            M.pct_change("cur", "prev").alias("delta"),
            F.col("current_new_total").cast("double").alias("current_new"),
            F.col("current_occ_total").cast("double").alias("current_occasion"),
            M.share("current_new_total", "cur").alias("share_new"),
            M.share("current_occ_total", "cur").alias("share_occasion"),
        )
    )


# --- highlights ---------------------------------------------------------------------------------------


def _highlights(fact: DataFrame, filters: Filters, keys, carry, universe: Column, k: int | None) -> DataFrame:
    periods = report_periods(filters)
    rows = multi_period(
        apply_filters(fact, filters, periods), periods, keys, ("total", "lines"), carry=carry, splits=goods_splits()
    ).where(universe)
    both = {p: F.col(f"{p}_new_total") + F.col(f"{p}_occ_total") for p in periods}
    rows = rows.withColumns({f"{p}_total": expr for p, expr in both.items()})
    out = rows.select(
        *keys,
        *(carry or {}),
        F.col("current_new_total").cast("double").alias("current_total"),
        F.col("current_occ_total").cast("double").alias("current_occasion_total"),
        F.col("previous_year_new_total").cast("double").alias("previous_total"),
        F.col("previous_year_occ_total").cast("double").alias("previous_occasion_total"),
        F.col("current_total").cast("double").alias("current_global_total"),
        F.col("previous_year_total").cast("double").alias("previous_global_total"),
        M.pct_change("current_new_total", "previous_year_new_total").alias("delta"),
        M.pct_change("current_total", "previous_year_total").alias("global_delta"),
        *trend_columns(),
    )
    if k is None:
        return out
    return out.orderBy(F.col("current_global_total").desc(), *keys).limit(k)


def brand_highlights(
    fact: DataFrame, filters: Filters, channel: str | None = None, k: int | None = TOP_HIGHLIGHTS
) -> DataFrame:
    """Top brands by new plus second-hand sales. Only brands with new-goods lines now or a year ago take part."""
    rows = fact if channel is None else fact.where(L.channel() == channel)
    universe = (F.col("current_new_lines") > 0) | (F.col("previous_year_new_lines") > 0)
    out = _highlights(rows, filters, {"brand_id": L.brand_key()}, brand_name_carry(), universe, k)
    return out.withColumn("brand_name", L.brand_label())


def category_highlights(fact: DataFrame, filters: Filters, k: int | None = TOP_HIGHLIGHTS) -> DataFrame:
    """Top category paths; every path with a line now or a year ago takes part."""
    universe = (
        F.col("current_new_lines") + F.col("current_occ_lines") + F.col("previous_year_new_lines")
        + F.col("previous_year_occ_lines")
    ) > 0
    return _highlights(fact, filters, {"category_name": L.category_path()}, {}, universe, k)


def channel_highlights(fact: DataFrame, filters: Filters, k: int = TOP_HIGHLIGHTS) -> DataFrame:
    """Top brands of every channel at once, instead of one query per channel."""
    universe = (F.col("current_new_lines") > 0) | (F.col("previous_year_new_lines") > 0)
    keys = {"channel_name": L.channel(), "brand_id": L.brand_key()}
    out = _highlights(fact, filters, keys, brand_name_carry(), universe, None)
    return top_k_per(
        out.withColumn("brand_name", L.brand_label()),
        ["channel_name"],
        [F.col("current_global_total").desc(), F.col("brand_id")],
        k,
    )


def channel_breakdown(
    fact: DataFrame, filters: Filters, keys: Mapping[str, Column], k: int = TOP_CHANNELS_PER_KEY
) -> DataFrame:
    """First k channels of every key in the preferred order, with new, second-hand and combined deltas."""
    periods = report_periods(filters, trends=False)
    rows = multi_period(
        apply_filters(fact, filters, periods),
        periods,
        {**keys, "channel_name": L.channel()},
        ("total",),
        splits=goods_splits(),
    )
    ranked = top_k_per(
        rows, list(keys), [L.preferred_rank("channel_name"), F.lower("channel_name"), F.col("channel_name")], k
    )
    current = F.col("current_new_total") + F.col("current_occ_total")
    previous = F.col("previous_year_new_total") + F.col("previous_year_occ_total")
    deltas = {
        "delta": M.pct_change("current_new_total", "previous_year_new_total"),
        "global_delta": M.pct_change(current, previous),
        "occasion_delta": M.pct_change("current_occ_total", "previous_year_occ_total"),
    }
    return ranked.select(
        *keys,
        "rank",
        "channel_name",
        L.channel_label("channel_name").alias("label"),
        F.col("current_new_total").cast("double").alias("current_total"),
        F.col("current_occ_total").cast("double").alias("current_occasion_total"),
        F.col("previous_year_new_total").cast("double").alias("previous_total"),
        F.col("previous_year_occ_total").cast("double").alias("previous_occasion_total"),
        *[expr.alias(name) for name, expr in deltas.items()],
        *[M.delta_class(expr).alias(f"{name}_class") for name, expr in deltas.items()],
    )


def exclude_brands(highlights: DataFrame, names: Sequence[str] = (HOUSE_BRAND,)) -> DataFrame:
    """Hides house brands; applied after the top-k, so the list may get shorter."""
    return highlights.where(~F.upper("brand_name").isin(*[n.upper() for n in names]))


def summary_series(items: DataFrame, label: str, value: str, base: DataFrame) -> DataFrame:
    """Chart series in descending order with the share of the company total (`base`: one row, one column)."""
    total = base.scalar()
    return items.orderBy(F.col(value).desc(), label).select(
        F.col(label).alias("label"),
        F.col(value).alias("current"),
        M.fmt_money(value).alias("value"),
        M.fmt_share(value, total).alias("share_global_value"),
        M.share(value, total).alias("share_global_ratio"),
    )


# --- movers -------------------------------------------------------------------------------------------


def brand_movers(fact: DataFrame, filters: Filters, k: int | None = ALERT_BRANDS) -> DataFrame:
    """Gainers and losers among brands that reach the floor. Both lists run in descending delta order, so the
    losers shown are the mildest falls."""
    periods = report_periods(filters, trends=False)
    rows = multi_period(
        apply_filters(fact.where(~L.is_occasion()), filters, periods),
        periods,
        {"brand_id": L.brand_key()},
        ("total", "lines"),
        carry=brand_name_carry(),
    )
    movers = (
        rows.where(F.greatest("current_total", "previous_year_total") >= MOVER_FLOOR)
        .withColumn("delta", M.pct_change("current_total", "previous_year_total"))
        .where("delta <> 0")
        .select(
            F.when(F.col("delta") > 0, "gainer").otherwise("loser").alias("kind"),
            "brand_id",
            L.brand_label().alias("brand_name"),
            F.col("current_total").cast("double").alias("current_total"),
            F.col("previous_year_total").cast("double").alias("previous_total"),
            "delta",
            (F.col("current_total") - F.col("previous_year_total")).cast("double").alias("absolute_delta"),
        )
    )
    if k is None:
        return movers
    return top_k_per(movers, ["kind"], [F.col("delta").desc(), F.col("brand_id")], k)


def _baskets(fact: DataFrame, filters: Filters, previous: str) -> DataFrame:
    chosen = filters.comparison_periods()
    periods = {"current": chosen["current"], "previous": chosen[previous]}
    rows = _channel_periods(fact, filters, periods, ("total", "invoices", "lines"))
    return rows.where((F.col("current_lines") > 0) | (F.col("previous_lines") > 0)).select(
        F.col("channel_name").alias("channel"),
        L.channel_label("channel_name").alias("label"),
        F.col("current_total").cast("double").alias("current_total"),
        F.col("previous_total").cast("double").alias("previous_total"),
        M.ratio("current_total", "current_invoices").alias("current_basket"),
        M.ratio("previous_total", "previous_invoices").alias("previous_basket"),
    )


def channel_movers(fact: DataFrame, filters: Filters, k: int = MOVER_CHANNELS) -> DataFrame:
    rows = _baskets(fact, filters, "previous_year").select(
        "channel",
        "label",
        "current_total",
        "previous_total",
        M.pct_change("current_total", "previous_total").alias("delta"),
        M.pct_change("current_basket", "previous_basket").alias("basket_delta"),
    )
    score = F.abs(F.coalesce("basket_delta", F.lit(0.0))) + F.abs(F.coalesce("delta", F.lit(0.0)))
    return rows.withColumn("score", score).orderBy(F.col("score").desc(), "channel").limit(k)


def basket_movers(fact: DataFrame, filters: Filters, k: int = MOVER_CHANNELS) -> DataFrame:
    """Against the previous month."""
    rows = _baskets(fact, filters, "previous_month").select(
        "channel",
        "label",
        "current_basket",
        "previous_basket",
        M.pct_change("current_basket", "previous_basket").alias("basket_delta"),
    )
    return rows.orderBy(F.abs(F.coalesce("basket_delta", F.lit(0.0))).desc(), "channel").limit(k)


def mover_class(delta: Column | str) -> Column:
    """Alert lists know no neutral class for a zero delta."""
    value = F.col(delta) if isinstance(delta, str) else delta
    return F.when(value.isNull(), "delta-neutral").when(value > 0, "delta-up").otherwise("delta-down")


#: What filters, brands, channels and baskets read.
ALERT_COLUMNS = (
    "invoice_date", "invoice_number", "product_id", "product_code", "product_name", "rayon_name", "family_name",
    "subfamily_name", "brand_id", "brand_name", "supplier_reference", "channel_name", "total_ht",
)


def alerts(fact: DataFrame, filters: Filters) -> DataFrame:
    """Three gainers, three losers, four channel and four basket anomalies, in display form. The rows of their periods
    are worked out once and written: the three lists would each build the fact again."""
    chosen = filters.comparison_periods()
    periods = {name: chosen[name] for name in (*CURRENT_VS_YEAR, "previous_month")}
    rows = apply_filters(fact, filters, periods).select(*[c for c in ALERT_COLUMNS if c in fact.columns])
    fact = written(fact.sparkSession, rows, "alert-base")
    brands = brand_movers(fact, filters).select(
        F.concat(F.lit("brand_"), F.col("kind")).alias("alert"),
        F.col("brand_name").alias("label"),
        M.fmt_money("current_total").alias("current_display"),
        M.fmt_money("previous_total").alias("previous_display"),
        M.fmt_pct("delta").alias("delta_display"),
        mover_class("delta").alias("delta_class"),
    )
    channels = channel_movers(fact, filters, ALERT_CHANNELS).select(
        F.lit("channel").alias("alert"),
        "label",
        M.fmt_money("current_total").alias("current_display"),
        M.fmt_money("previous_total").alias("previous_display"),
        M.fmt_pct("delta").alias("delta_display"),
        mover_class("delta").alias("delta_class"),
    )
    baskets = basket_movers(fact, filters, ALERT_CHANNELS).select(
        F.lit("basket").alias("alert"),
        "label",
        M.fmt_money("current_basket").alias("current_display"),
        M.fmt_money("previous_basket").alias("previous_display"),
        M.fmt_pct("basket_delta").alias("delta_display"),
        mover_class("basket_delta").alias("delta_class"),
    )
    return brands.unionByName(channels).unionByName(baskets)


# --- daily trend --------------------------------------------------------------------------------------


def aligned_trend(fact: DataFrame, filters: Filters, spark: SparkSession) -> DataFrame:
    """Day i of the current period beside day i of the previous year, zero-filled, up to the shorter span."""
    periods = report_periods(filters, trends=False)
    (start, end), (prev_start, prev_end) = periods["current"], periods["previous_year"]
    days = min((end - start).days, (prev_end - prev_start).days) + 1

    day = F.col("invoice_date")
    sides = F.array(
        F.struct(F.lit(True).alias("now"), F.date_diff(day, F.lit(start)).alias("i"), cal.in_period(day, (start, end)).alias("ok")),
        F.struct(
            F.lit(False).alias("now"),
            F.date_diff(day, F.lit(prev_start)).alias("i"),
            cal.in_period(day, (prev_start, prev_end)).alias("ok"),
        ),
    )
    totals = (
        apply_filters(fact, filters, periods)
        .select(F.explode(F.filter(sides, lambda s: s["ok"])).alias("s"), "total_ht")
        .groupBy(F.col("s.i").cast("bigint").alias("i"))
        .agg(
            F.sum(F.when(F.col("s.now"), F.col("total_ht"))).alias("current"),
            F.sum(F.when(~F.col("s.now"), F.col("total_ht"))).alias("previous"),
        )
    )
    spine = spark.range(max(days, 0)).select(
        F.col("id").alias("i"), F.date_add(F.lit(start), F.col("id").cast("int")).alias("date")
    )
    return spine.join(totals, "i", "left").select(
        "date",
        F.date_format("date", "dd/MM").alias("label"),
        F.coalesce(F.col("current").cast("double"), F.lit(0.0)).alias("current"),
        F.coalesce(F.col("previous").cast("double"), F.lit(0.0)).alias("previous"),
    )


def period_table(filters: Filters) -> list[tuple[str, dt.date, dt.date]]:
    return [(name, *bounds) for name, bounds in home_periods(filters).items()]



def goods_shares(fact: DataFrame, filters: Filters) -> DataFrame:
    """Channel shares of the company, of each kind of goods, and of the second-hand part of the channel."""
    periods = {"current": filters.period}
    rows = apply_filters(fact, filters, periods)
    both = {"all": F.lit(True), **goods_splits()}
    by_channel = multi_period(rows, periods, {"channel_name": L.channel()}, ("total",), splits=both)
    company = by_channel.agg(*[F.sum(f"current_{s}_total").cast("double").alias(s) for s in both])
    base = company.select(F.struct(*both)).scalar()
    return by_channel.select(
        "channel_name",
        F.col("current_all_total").cast("double").alias("current"),
        M.share("current_all_total", base["all"]).alias("share_global"),
        M.share("current_new_total", base["new"]).alias("share_section_new"),
        M.share("current_occ_total", base["occ"]).alias("share_section_occasion"),
        M.share("current_occ_total", "current_all_total").alias("share_channel_occasion"),
    )


def order_channels(channels: DataFrame, name: str = "channel_name") -> DataFrame:
    """Preferred display order: fixed list first, then case-insensitive name."""
    return channels.withColumn("preference", L.preferred_rank(name)).orderBy("preference", F.lower(name), name)
