"""Queries of the sales-reporting domain: aggregates, comparisons, movers, detail."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import calendar as cal
from ..functions import labels as L
from ..functions import measures as M
from ..operators import aggregates as A
from ..operators import comparisons as C
from ..operators import detail as D
from ..operators.filters import Filters, apply_filters
from .fact_sql import (
    YEAR,
    TREND,
    klass,
    money,
    mover_klass,
    one_decimal,
    pct,
    pct_text,
    period_measures,
    ratio,
    share,
    short,
    trends,
    with_fact,
    within,
)
from .registry import query

STD = Filters(fx.START, fx.END)
TARGET = 30_000_000.0
CUR = within("current")


def _fact(spark, sf, filters=STD, periods=None):
    """The whole fact: the periods are the operators' to apply."""
    return fx.fact(spark, sf)


_all = _fact


# --- filters ------------------------------------------------------------------------------------------


def _filtered(filters):
    def run(spark, sf):
        rows = apply_filters(_fact(spark, sf, filters), filters)
        return rows.select("source_line_id", "invoice_date", F.col("total_ht").cast("double").alias("total_ht"))

    return run


def _filter_sql(where):
    return with_fact(
        "SELECT source_line_id, invoice_date, CAST(total_ht AS DOUBLE) AS total_ht FROM f"
        f" WHERE {CUR}" + (f" AND {where}" if where else "")
    )


def _std(**kw):
    return Filters(fx.START, fx.END, **kw)


query("f1_period_filter", _filter_sql(""))(_filtered(_std()))
query("f3_channel_filter", _filter_sql("channel = 'Web'"))(_filtered(_std(channel="Web")))
query("f4_brand_filter_unbranded", _filter_sql("brand_key = 0"))(_filtered(_std(brand_id=0)))
query("f5_category_filter", _filter_sql("category = 'ECONOMY > widget'"))(_filtered(_std(category="ECONOMY > widget")))
query("f6_occasion_filter", _filter_sql("is_occ"))(_filtered(_std(occasion="occasion")))
query("f6_hors_occasion_filter", _filter_sql("NOT is_occ"))(_filtered(_std(occasion="hors_occasion")))

_SEARCH = " OR ".join(
    f"lower(coalesce({c},'')) LIKE '%a_5%'"
    for c in ("invoice_number", "product_code", "product_name", "brand_name", "channel_name", "supplier_reference")
)
query("f8_multi_column_search", _filter_sql(f"({_SEARCH})"))(_filtered(_std(q="A_5")))
query(
    "f9_combined_filters",
    _filter_sql("channel = 'Nantes' AND NOT is_occ AND (" + _SEARCH.replace("a_5", "brand#1") + ")"),
)(_filtered(Filters.from_raw(
    {"start": "2001-08-01", "end": "2001-07-01", "channel": "Nantes", "occasion": "hors_occasion", "q": " Brand#1 "},
    fx.AS_OF,
)))


@query(
    "f7_occasion_predicate",
    f"""SELECT p_partkey AS product_id,
      (lower(code) LIKE 'b-%' OR lower(code) LIKE '%occas%' OR upper(code) LIKE 'DEPV%' OR lower(p_name) LIKE '%occas%')
      AS is_occasion
    FROM (SELECT *, (CASE WHEN p_type='PROMO' THEN 'B-' WHEN p_size=2 THEN 'DEPV' WHEN p_size=3 THEN 'X-OCCAS-'
      ELSE 'A-' END || CAST(p_partkey AS VARCHAR)) AS code FROM part)""",
)
def _(spark, sf):
    a = fx.articles(spark, sf)
    return a.select(F.col("IDART").alias("product_id"), L.is_occasion("CODE", "DESIGNATION").alias("is_occasion"))


# --- aggregates ---------------------------------------------------------------------------------------


@query(
    "a1_period_summary",
    with_fact(f"""SELECT CAST(coalesce(sum(total_ht),0) AS DOUBLE) AS total_ht,
      CAST(coalesce(sum(margin_ht),0) AS DOUBLE) AS margin_ht, CAST(coalesce(sum(quantity),0) AS DOUBLE) AS quantity,
      count(DISTINCT invoice_number) AS invoice_count, count(*) AS line_count FROM f WHERE {CUR}"""),
)
def _(spark, sf):
    return A.period_summary(_fact(spark, sf), STD)


@query(
    "a2_channel_totals",
    with_fact(f"""SELECT channel AS channel_name, CAST(sum(total_ht) AS DOUBLE) AS total_ht,
      CAST(sum(margin_ht) AS DOUBLE) AS margin_ht, count(DISTINCT invoice_number) AS invoice_count,
      count(*) AS line_count FROM f WHERE {CUR} GROUP BY 1"""),
)
def _(spark, sf):
    return A.channel_totals(_fact(spark, sf), STD)


def _brand_sql(cond):
    return with_fact(f"""SELECT CAST(brand_key AS INTEGER) AS brand_id, min(brand_label) AS brand_name,
      CAST(sum(total_ht) AS DOUBLE) AS total_ht, CAST(sum(margin_ht) AS DOUBLE) AS margin_ht,
      count(DISTINCT invoice_number) AS invoice_count FROM f WHERE {CUR} AND {cond} GROUP BY 1""")


@query("a3_brand_totals_new", _brand_sql("NOT is_occ"))
def _(spark, sf):
    return A.brand_totals(_fact(spark, sf), STD, occasion=False)


@query("a3_brand_totals_occasion_web", _brand_sql("is_occ AND channel = 'Web'"))
def _(spark, sf):
    return A.brand_totals(_fact(spark, sf), STD, occasion=True, channel="Web")


@query(
    "a4_brand_channel_totals",
    with_fact(f"""SELECT CAST(brand_key AS INTEGER) AS brand_id, channel AS channel_name,
      CAST(sum(total_ht) AS DOUBLE) AS total_ht, count(DISTINCT invoice_number) AS invoice_count,
      count(*) AS line_count FROM f WHERE {CUR} AND NOT is_occ GROUP BY 1, 2"""),
)
def _(spark, sf):
    return A.brand_channel_totals(_fact(spark, sf), STD, occasion=False)


@query(
    "a5_category_totals",
    with_fact(f"""SELECT category AS category_name, CAST(sum(total_ht) AS DOUBLE) AS total_ht FROM f
      WHERE {CUR} AND NOT is_occ GROUP BY 1"""),
)
def _(spark, sf):
    return A.category_totals(_fact(spark, sf), STD, occasion=False)


@query(
    "a6_category_channel_totals",
    with_fact(f"""SELECT category AS category_name, channel AS channel_name, CAST(sum(total_ht) AS DOUBLE) AS total_ht
      FROM f WHERE {CUR} AND is_occ GROUP BY 1, 2"""),
)
def _(spark, sf):
    return A.category_channel_totals(_fact(spark, sf), STD, occasion=True)


for _name, _occ in (("a7_occasion", True), ("a8_new", False)):
    _cond = "is_occ" if _occ else "NOT is_occ"
    _body = (
        "CAST(coalesce(sum(total_ht),0) AS DOUBLE) AS total_ht, count(*) AS line_count,"
        f" count(DISTINCT invoice_number) AS invoice_count FROM f WHERE {CUR} AND {_cond}"
    )
    query(f"{_name}_totals", with_fact(f"SELECT {_body}"))(
        lambda spark, sf, occ=_occ: A.goods_totals(_fact(spark, sf), STD, occ)
    )
    query(f"{_name}_channel_totals", with_fact(f"SELECT channel AS channel_name, {_body} GROUP BY 1"))(
        lambda spark, sf, occ=_occ: A.goods_channel_totals(_fact(spark, sf), STD, occ)
    )


@query(
    "a9_daily_totals",
    with_fact(f"SELECT invoice_date, CAST(sum(total_ht) AS DOUBLE) AS total_ht FROM f WHERE {CUR} GROUP BY 1"),
)
def _(spark, sf):
    return A.daily_totals(_fact(spark, sf), STD)


@query(
    "a10_filter_options",
    with_fact(
        f"""SELECT DISTINCT 'channel' AS kind, channel AS value, {short('channel')} AS label FROM u
      UNION ALL SELECT DISTINCT 'brand', CAST(brand_key AS VARCHAR), brand_label FROM u
      UNION ALL SELECT DISTINCT 'category', category, category FROM u""",
        """u AS (SELECT channel_name AS channel, coalesce(brand_id,0) AS brand_key,
          coalesce(nullif(brand_name,''), CASE WHEN coalesce(brand_id,0)=0 THEN 'Sans marque'
            ELSE 'IDFAB ' || CAST(coalesce(brand_id,0) AS VARCHAR) END) AS brand_label,
          concat_ws(' > ', rayon_name, family_name, nullif(subfamily_name,'')) AS category FROM fact)""",
    ),
)
def _(spark, sf):
    return A.filter_options(fx.fact(spark, sf))


@query(
    "a11_count_detail",
    with_fact(f"""SELECT count(*) AS total_rows,
      CAST(greatest(1, ceil(count(*) / 50.0)) AS BIGINT) AS total_pages FROM f WHERE {CUR}"""),
)
def _(spark, sf):
    return A.count_detail(_fact(spark, sf), STD)


for _by, _expr in (
    ("idart", "CAST(product_id AS VARCHAR)"),
    ("brand", "brand_label"),
    ("channel", "channel"),
    ("category", "category"),
):
    query(
        f"a21_grouped_detail_{_by}",
        with_fact(f"""SELECT {_expr} AS group_key, CAST(sum(total_ht) AS DOUBLE) AS total_ht,
          CAST(sum(margin_ht) AS DOUBLE) AS margin_ht, CAST(sum(quantity) AS DOUBLE) AS quantity,
          count(*) AS line_count, count(DISTINCT invoice_number) AS invoice_count FROM f WHERE {CUR} GROUP BY 1"""),
    )(lambda spark, sf, by=_by: A.grouped_detail(_fact(spark, sf), STD, by))


# --- periods ------------------------------------------------------------------------------------------

_SHIFT = "CAST(date_trunc('month', {d}) + INTERVAL ({n}) MONTH + INTERVAL (day({d}) - 1) DAY AS DATE)"


def _shift(d, n):
    return _SHIFT.format(d=d, n=n)


@query(
    "c1_resolve_periods",
    'SELECT "start", "end", '
    + ", ".join(
        f'{_shift(chr(34) + e + chr(34), n)} AS {name}_{e}'
        for name, n in (
            ("previous_year", -12),
            ("previous_six_month", -6),
            ("previous_three_month", -3),
            ("previous_month", -1),
        )
        for e in ("start", "end")
    )
    + """ FROM (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS "start",
        CAST(max(o_orderdate) AS DATE) AS "end" FROM orders GROUP BY date_trunc('month', o_orderdate))""",
)
def _(spark, sf):
    """Periods of every month-to-date range seen in the orders."""
    day = F.to_date("o_orderdate")
    ranges = fx.table(spark, sf, "orders").groupBy(F.trunc(day, "MM").alias("start")).agg(F.max(day).alias("end"))
    return C.resolved_periods(ranges)


@query(
    "c2_rolling_windows",
    'SELECT "end", '
    + ", ".join(
        f"CAST({_shift(chr(34) + 'end' + chr(34), -n)} + 1 AS DATE) AS t{t}_current_start, "
        f"{_shift('CAST(' + _shift(chr(34) + 'end' + chr(34), -n) + ' + 1 AS DATE)', -12)} AS t{t}_previous_start"
        for t, n in (("1y", 12), ("6m", 6), ("3m", 3))
    )
    + f", {_shift(chr(34) + 'end' + chr(34), -12)} AS previous_end"
    + ' FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS "end" FROM orders)',
)
def _(spark, sf):
    ends = fx.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("end")).distinct()
    return C.rolling_windows(ends)


@query(
    "c3_shift_months",
    "SELECT d, " + ", ".join(f"{_shift('d', -n)} AS minus_{n}" for n in (1, 3, 6, 12))
    + " FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)",
)
def _(spark, sf):
    days = fx.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    return days.select("d", *[cal.shift_months("d", -n).alias(f"minus_{n}") for n in (1, 3, 6, 12)])


_PAIR = "SELECT channel AS channel_name, " + period_measures(YEAR, ("total",)) + " FROM f GROUP BY 1"


@query(
    "c4_pct_change_guards",
    with_fact(
        f"""SELECT category, total, prev, {pct('total', 'prev')} AS delta_gt0,
      {pct('total', 'prev', '<> 0')} AS delta_ne0 FROM s""",
        f"""s AS (SELECT category, CAST(coalesce(sum(total_ht) FILTER (WHERE {CUR}),0) AS DOUBLE) AS total,
      CAST(coalesce(sum(total_ht) FILTER (WHERE {within('previous_year')}),0) AS DOUBLE) AS prev
      FROM f GROUP BY 1)""",
    ),
)
def _(spark, sf):
    periods = C.report_periods(STD, trends=False)
    rows = A.multi_period(
        fx.fact(spark, sf).where(L.not_excluded()), periods, {"category": L.category_path()}, ("total",)
    )
    return rows.select(
        "category",
        F.col("current_total").cast("double").alias("total"),
        F.col("previous_year_total").cast("double").alias("prev"),
        M.pct_change("current_total", "previous_year_total").alias("delta_gt0"),
        M.pct_change("current_total", "previous_year_total", "ne0").alias("delta_ne0"),
    )


# --- cards --------------------------------------------------------------------------------------------

_CARD_PERIODS = ("current", "previous_year", "previous_month", *TREND)


def _card_sql():
    rows = []
    for pos, (label, m, base, kind) in enumerate(C.CARDS, start=1):

        def v(p, m=m):
            if m == "basket":
                return "(" + ratio(f"{p}_total", f"{p}_invoices") + ")"
            return f"CAST({p}_{m} AS DOUBLE)"

        prev = f"CAST({TARGET} AS DOUBLE)" if base == "objective" else v(base)
        tr = ", ".join(
            f"{pct(v(f't{t}_current'), v(f't{t}_previous'))} AS trend_{t}" for t in ("1y", "6m", "3m")
        )
        rows.append(
            f"SELECT {pos} AS position, '{label}' AS label, '{kind}' AS type, {v('current')} AS current,"
            f" {prev} AS previous, {pct(v('current'), prev, '<> 0')} AS delta, {tr} FROM s"
        )
    return with_fact(
        " UNION ALL ".join(rows),
        f"s AS (SELECT {period_measures(_CARD_PERIODS, ('total', 'margin', 'invoices'))} FROM f)",
    )


@query("c5_kpi_cards", _card_sql())
def _(spark, sf):
    return C.kpi_cards(_all(spark, sf), STD, TARGET)


@query(
    "c6_card_trends",
    with_fact(
        f"SELECT {trends('total')} FROM s", f"s AS (SELECT {period_measures(TREND, ('total',))} FROM f)"
    ),
)
def _(spark, sf):
    periods = STD.rolling_periods()
    row = A.multi_period(apply_filters(_all(spark, sf), STD, periods), periods, measures=("total",))
    return row.select(*C.trend_columns())


@query(
    "c7_objective",
    with_fact(f"""SELECT CAST({TARGET} AS DOUBLE) AS objective_ht, t / {TARGET} * 100.0 AS objective_ratio,
      greatest(0.0, {TARGET} - t) AS objective_remaining
      FROM (SELECT CAST(coalesce(sum(total_ht),0) AS DOUBLE) AS t FROM f WHERE {CUR})"""),
)
def _(spark, sf):
    return C.objective_summary(_fact(spark, sf), STD, TARGET)


# --- channels and goods -------------------------------------------------------------------------------

_CB, _PB = ratio("current_total", "current_invoices"), ratio("previous_year_total", "previous_year_invoices")


@query(
    "c8_channel_summaries",
    with_fact(
        f"""SELECT channel_name, {short('channel_name')} AS label, current_total AS current, current_margin AS margin,
      current_invoices AS invoices, current_lines AS lines, {_CB} AS average_basket, previous_year_total AS previous,
      previous_year_margin AS previous_margin, previous_year_invoices AS previous_invoices,
      previous_year_lines AS previous_lines, {_PB} AS previous_average_basket,
      {pct('current_total', 'previous_year_total')} AS delta,
      CASE WHEN previous_year_invoices > 0 THEN (({_CB}) - ({_PB})) / greatest(0.01, {_PB}) * 100.0 END AS basket_delta,
      {trends()} FROM s WHERE current_lines > 0""",
        f"""s AS (SELECT channel AS channel_name,
      {period_measures(YEAR, ('total', 'margin', 'invoices', 'lines'))}, {period_measures(TREND, ('total',))}
      FROM f GROUP BY 1)""",
    ),
)
def _(spark, sf):
    return C.channel_summaries(_all(spark, sf), STD)


@query(
    "c9_basket_delta",
    with_fact(
        f"""SELECT channel_name, {_CB} AS current_basket, {_PB} AS previous_basket,
      CASE WHEN previous_year_invoices > 0 THEN (({_CB}) - ({_PB})) / greatest(0.01, {_PB}) * 100.0 END AS basket_delta
      FROM s WHERE current_lines > 0""",
        f"s AS (SELECT channel AS channel_name, {period_measures(YEAR, ('total', 'invoices', 'lines'))} FROM f GROUP BY 1)",
    ),
)
def _(spark, sf):
    return C.channel_summaries(_all(spark, sf), STD).select(
        "channel_name",
        F.col("average_basket").alias("current_basket"),
        F.col("previous_average_basket").alias("previous_basket"),
        "basket_delta",
    )


_GOODS_COLS = f"""current_total, previous_year_total AS previous_total,
  {pct('current_total', 'previous_year_total')} AS delta, current_lines, previous_year_lines AS previous_lines,
  current_invoices, previous_year_invoices AS previous_invoices, {trends()}"""
_GOODS_MEASURES = period_measures(YEAR, ("total", "lines", "invoices")) + ", " + period_measures(TREND, ("total",))

for _name, _occ in (("c10_occasion", True), ("c11_new_goods", False)):
    _cond = "is_occ" if _occ else "NOT is_occ"
    query(
        f"{_name}_summary",
        with_fact(f"SELECT {_GOODS_COLS} FROM s", f"s AS (SELECT {_GOODS_MEASURES} FROM f WHERE {_cond})"),
    )(lambda spark, sf, occ=_occ: C.goods_summary(_all(spark, sf), STD, occ))
    query(
        f"{_name}_channels",
        with_fact(
            f"""SELECT channel_name, {short('channel_name')} AS label, {_GOODS_COLS} FROM s
          WHERE current_lines > 0 OR previous_year_lines > 0""",
            f"s AS (SELECT channel AS channel_name, {_GOODS_MEASURES} FROM f WHERE {_cond} GROUP BY 1)",
        ),
    )(lambda spark, sf, occ=_occ: C.goods_channel_summaries(_all(spark, sf), STD, occ))


# --- highlights ---------------------------------------------------------------------------------------

_BOTH = "({p}_new_{k} + {p}_occ_{k})"


def _highlight_sql(key, alias, extra, universe, k=8, partition=None):
    cols = f"""{alias}, {extra} current_new_total AS current_total, current_occ_total AS current_occasion_total,
      previous_year_new_total AS previous_total, previous_year_occ_total AS previous_occasion_total,
      current_new_total + current_occ_total AS current_global_total,
      previous_year_new_total + previous_year_occ_total AS previous_global_total,
      {pct('current_new_total', 'previous_year_new_total')} AS delta,
      {pct('(current_new_total + current_occ_total)', '(previous_year_new_total + previous_year_occ_total)')} AS global_delta,
      {trends('total', _BOTH)}"""
    inner = f"""s AS (SELECT {key}, {period_measures(YEAR, ('total', 'lines'), split=True)},
      {period_measures(TREND, ('total',), split=True)} FROM f GROUP BY ALL)"""
    return cols, inner, universe


_NEW_SEEN = "(current_new_lines > 0 OR previous_year_new_lines > 0)"
_ANY_SEEN = (
    "(current_new_lines + current_occ_lines + previous_year_new_lines + previous_year_occ_lines > 0)"
)

_cols, _inner, _u = _highlight_sql(
    "CAST(brand_key AS INTEGER) AS brand_id, brand_label AS brand_name", "brand_id", "brand_name,", _NEW_SEEN
)


@query(
    "c12_brand_highlights",
    with_fact(f"SELECT {_cols} FROM s WHERE {_u} ORDER BY current_global_total DESC, brand_id LIMIT 8", _inner),
)
def _(spark, sf):
    return C.brand_highlights(_all(spark, sf), STD)


@query(
    "c12_brand_highlights_web",
    with_fact(
        f"SELECT {_cols} FROM s WHERE {_u} ORDER BY current_global_total DESC, brand_id LIMIT 8",
        _inner.replace("FROM f ", "FROM f WHERE channel = 'Web' "),
    ),
)
def _(spark, sf):
    return C.brand_highlights(_all(spark, sf), STD, channel="Web")


_ccols, _cinner, _ = _highlight_sql(
    "channel AS channel_name, CAST(brand_key AS INTEGER) AS brand_id, brand_label AS brand_name",
    "channel_name, brand_id",
    "brand_name,",
    _NEW_SEEN,
)


@query(
    "c12_channel_brand_highlights",
    with_fact(
        f"""SELECT *, CAST(row_number() OVER (PARTITION BY channel_name ORDER BY current_global_total DESC, brand_id)
      AS INTEGER) AS rank FROM (SELECT {_ccols} FROM s WHERE {_u}) QUALIFY rank <= 8""",
        _cinner,
    ),
)
def _(spark, sf):
    return C.channel_highlights(_all(spark, sf), STD)


_kcols, _kinner, _ = _highlight_sql("category AS category_name", "category_name", "", _ANY_SEEN)


@query(
    "c13_category_highlights",
    with_fact(
        f"SELECT {_kcols} FROM s WHERE {_ANY_SEEN} ORDER BY current_global_total DESC, category_name LIMIT 8", _kinner
    ),
)
def _(spark, sf):
    return C.category_highlights(_all(spark, sf), STD)


def _breakdown_sql(key, alias):
    cur, prev = "(current_new_total + current_occ_total)", "(previous_year_new_total + previous_year_occ_total)"
    d = {
        "delta": pct("current_new_total", "previous_year_new_total"),
        "global_delta": pct(cur, prev),
        "occasion_delta": pct("current_occ_total", "previous_year_occ_total"),
    }
    return with_fact(
        f"""SELECT {alias}, rank, channel_name, {short('channel_name')} AS label, current_new_total AS current_total,
      current_occ_total AS current_occasion_total, previous_year_new_total AS previous_total,
      previous_year_occ_total AS previous_occasion_total, {', '.join(f'{v} AS {k}' for k, v in d.items())},
      {', '.join(f'{klass("(" + v + ")")} AS {k}_class' for k, v in d.items())}
      FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {alias} ORDER BY CASE channel_name WHEN 'Nantes' THEN 0
        WHEN 'Bordeaux' THEN 1 WHEN 'Web' THEN 2 WHEN 'École' THEN 3 WHEN 'Autre' THEN 4 ELSE 99 END,
        lower(channel_name), channel_name) AS INTEGER) AS rank FROM s) WHERE rank <= 3""",
        f"""s AS (SELECT {key}, channel AS channel_name, {period_measures(YEAR, ('total',), split=True)} FROM f
      WHERE {CUR} OR {within('previous_year')} GROUP BY ALL)""",
    )


@query("c14_brand_channel_breakdown", _breakdown_sql("CAST(brand_key AS INTEGER) AS brand_id", "brand_id"))
def _(spark, sf):
    return C.channel_breakdown(_all(spark, sf), STD, {"brand_id": L.brand_key()})


@query("c14_category_channel_breakdown", _breakdown_sql("category AS category_name", "category_name"))
def _(spark, sf):
    return C.channel_breakdown(_all(spark, sf), STD, {"category_name": L.category_path()})


# --- movers -------------------------------------------------------------------------------------------

_MOVERS = f"""movers AS (
  SELECT CASE WHEN delta > 0 THEN 'gainer' ELSE 'loser' END AS kind, brand_id, brand_name, current_total,
    previous_year_total AS previous_total, delta, CAST(cur_dec - prev_dec AS DOUBLE) AS absolute_delta
  FROM (SELECT *, {pct('current_total', 'previous_year_total')} AS delta FROM
    (SELECT CAST(brand_key AS INTEGER) AS brand_id, brand_label AS brand_name,
      {period_measures(YEAR, ('total',))},
      coalesce(sum(total_ht) FILTER (WHERE {CUR}),0) AS cur_dec,
      coalesce(sum(total_ht) FILTER (WHERE {within('previous_year')}),0) AS prev_dec
     FROM f WHERE NOT is_occ GROUP BY ALL))
  WHERE greatest(current_total, previous_year_total) >= 500 AND delta <> 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY kind ORDER BY delta DESC, brand_id) AS INTEGER) AS rank
  FROM movers)"""


@query("c15_brand_movers", with_fact("SELECT * FROM ranked WHERE rank <= 3", _MOVERS))
def _(spark, sf):
    return C.brand_movers(_all(spark, sf), STD)


def _basket_cte(name, prev):
    low = {"current_basket": ratio("current_total", "current_invoices"), "previous_basket": ratio("p_total", "p_invoices")}
    return f"""{name} AS (SELECT *, {pct('current_total', 'previous_total')} AS delta,
      {pct('current_basket', 'previous_basket')} AS basket_delta
      FROM (SELECT channel, {short('channel')} AS label, current_total, p_total AS previous_total,
        {low['current_basket']} AS current_basket, {low['previous_basket']} AS previous_basket
        FROM (SELECT channel, {period_measures(('current',), ('total', 'invoices', 'lines'))},
          {period_measures((prev,), ('total', 'invoices', 'lines')).replace(prev + '_', 'p_')}
          FROM f GROUP BY 1) WHERE current_lines > 0 OR p_lines > 0))"""


@query(
    "c16_channel_movers",
    with_fact(
        """SELECT channel, label, current_total, previous_total, delta, basket_delta,
      abs(coalesce(basket_delta,0.0)) + abs(coalesce(delta,0.0)) AS score FROM y ORDER BY score DESC, channel LIMIT 5""",
        _basket_cte("y", "previous_year"),
    ),
)
def _(spark, sf):
    return C.channel_movers(_all(spark, sf), STD)


@query(
    "c17_basket_movers",
    with_fact(
        """SELECT channel, label, current_basket, previous_basket, basket_delta FROM m
      ORDER BY abs(coalesce(basket_delta,0.0)) DESC, channel LIMIT 5""",
        _basket_cte("m", "previous_month"),
    ),
)
def _(spark, sf):
    return C.basket_movers(_all(spark, sf), STD)


@query(
    "c28_alerts",
    with_fact(
        f"""SELECT 'brand_' || kind AS alert, brand_name AS label, {money('current_total')} AS current_display,
      {money('previous_total')} AS previous_display, {pct_text('delta')} AS delta_display,
      {mover_klass('delta')} AS delta_class FROM ranked WHERE rank <= 3
    UNION ALL SELECT 'channel', label, {money('current_total')}, {money('previous_total')}, {pct_text('delta')},
      {mover_klass('delta')} FROM (SELECT * FROM y ORDER BY abs(coalesce(basket_delta,0.0)) + abs(coalesce(delta,0.0))
      DESC, channel LIMIT 4)
    UNION ALL SELECT 'basket', label, {money('current_basket')}, {money('previous_basket')}, {pct_text('basket_delta')},
      {mover_klass('basket_delta')} FROM (SELECT * FROM m ORDER BY abs(coalesce(basket_delta,0.0)) DESC, channel LIMIT 4)""",
        _MOVERS,
        _basket_cte("y", "previous_year"),
        _basket_cte("m", "previous_month"),
    ),
)
def _(spark, sf):
    return C.alerts(_all(spark, sf), STD)


@query(
    "c18_aligned_daily_trend",
    with_fact(
        """SELECT d.date, strftime(d.date, '%d/%m') AS label, CAST(coalesce(c.t, 0) AS DOUBLE) AS current,
      CAST(coalesce(p.t, 0) AS DOUBLE) AS previous
      FROM (SELECT CAST(unnest(generate_series(DATE '2001-07-01', DATE '2001-08-01', INTERVAL 1 DAY)) AS DATE) AS date) d
      LEFT JOIN (SELECT invoice_date, sum(total_ht) AS t FROM f GROUP BY 1) c ON c.invoice_date = d.date
      LEFT JOIN (SELECT invoice_date, sum(total_ht) AS t FROM f GROUP BY 1) p
        ON p.invoice_date = d.date - 365"""
    ),
)
def _(spark, sf):
    return C.aligned_trend(_all(spark, sf), STD, spark)


@query(
    "c19_multi_period",
    with_fact(
        f"""SELECT channel AS channel_name, is_occ,
      {period_measures(tuple(within_k for within_k in ('current', 'previous_year', 'previous_six_month',
        'previous_three_month', 'previous_month')), ('total', 'margin', 'qty', 'lines', 'invoices'))}
      FROM f WHERE ({CUR} OR {within('previous_year')} OR {within('previous_six_month')}
        OR {within('previous_three_month')} OR {within('previous_month')}) GROUP BY 1, 2"""
    ),
)
def _(spark, sf):
    periods = STD.comparison_periods()
    rows = apply_filters(fx.fact(spark, sf), STD, periods)
    keys = {"channel_name": L.channel(), "is_occ": L.is_occasion()}
    return A.as_report(A.multi_period(rows, periods, keys, ("total", "margin", "qty", "lines", "invoices")))


# --- shares, cards, display ---------------------------------------------------------------------------


@query(
    "c20_shares",
    with_fact(
        f"""SELECT channel_name, current_total AS current, {share('current_total', 'g')} AS share_global,
      {share('current_new_total', 'gn')} AS share_section_new, {share('current_occ_total', 'go')} AS share_section_occasion,
      {share('current_occ_total', 'current_total')} AS share_channel_occasion
      FROM s, (SELECT sum(current_total) AS g, sum(current_new_total) AS gn, sum(current_occ_total) AS go FROM
        (SELECT CAST(sum(total_ht) AS DOUBLE) AS current_total,
           CAST(sum(total_ht) FILTER (WHERE NOT is_occ) AS DOUBLE) AS current_new_total,
           CAST(sum(total_ht) FILTER (WHERE is_occ) AS DOUBLE) AS current_occ_total FROM f WHERE {CUR}))""",
        f"""s AS (SELECT channel AS channel_name, {period_measures(('current',), ('total',))},
      {period_measures(('current',), ('total',), split=True)} FROM f WHERE {CUR} GROUP BY 1)""",
    ),
)
def _(spark, sf):
    return C.goods_shares(_fact(spark, sf), STD)


@query(
    "c21_channel_shares",
    with_fact(
        f"""SELECT channel_name, current_total AS current, {share('current_total', 'g')} AS share_global,
      {share('current_total', 'm')} AS share_of_max,
      CASE WHEN current_total > 0 THEN current_margin / current_total * 100.0 END AS margin_percent
      FROM s, (SELECT CAST(sum(t) AS DOUBLE) AS g, CAST(max(t) AS DOUBLE) AS m
        FROM (SELECT channel, sum(total_ht) AS t FROM f WHERE {CUR} GROUP BY 1))""",
        f"""s AS (SELECT channel AS channel_name, {period_measures(('current',), ('total', 'margin'))} FROM f
      WHERE {CUR} GROUP BY 1)""",
    ),
)
def _(spark, sf):
    return C.channel_shares(_fact(spark, sf), STD)


_CMP_CUR, _CMP_PREV = "(current_new_total + current_occ_total)", "(previous_year_new_total + previous_year_occ_total)"


@query(
    "c22_new_vs_occasion",
    with_fact(
        f"""SELECT label, {_CMP_CUR} AS current_total, {_CMP_PREV} AS previous_total, {pct(_CMP_CUR, _CMP_PREV)} AS delta,
      current_new_total AS current_new, current_occ_total AS current_occasion,
      {share('current_new_total', _CMP_CUR)} AS share_new, {share('current_occ_total', _CMP_CUR)} AS share_occasion
      FROM (SELECT 'Global' AS label, 0 AS place, {period_measures(YEAR, ('total',), split=True)} FROM f
        UNION ALL SELECT {short('channel')}, 1, {period_measures(YEAR, ('total',), split=True)} FROM f
        WHERE {CUR} OR {within('previous_year')} GROUP BY channel)
      ORDER BY place, current_total DESC, label LIMIT 4"""
    ),
)
def _(spark, sf):
    return C.goods_comparison(_all(spark, sf), STD)


@query(
    "c23_summary_series",
    with_fact(
        f"""SELECT brand_name AS label, v AS current, {money('v')} AS value,
      {one_decimal('(' + share('v', 'g') + ')')} || ' %' AS share_global_value, {share('v', 'g')} AS share_global_ratio
      FROM (SELECT brand_name, current_new_total + current_occ_total AS v FROM s WHERE {_NEW_SEEN}
        ORDER BY v DESC, brand_id LIMIT 8),
      (SELECT CAST(sum(total_ht) AS DOUBLE) AS g FROM f WHERE {CUR})""",
        _inner,
    ),
)
def _(spark, sf):
    fact = _all(spark, sf)
    base = A.period_summary(_fact(spark, sf), STD).select("total_ht")
    return C.summary_series(C.brand_highlights(fact, STD), "brand_name", "current_global_total", base)


@query(
    "c24_exclude_house_brand",
    with_fact(
        f"""SELECT brand_id, brand_name, v AS current_global_total FROM
      (SELECT brand_id, brand_name, current_new_total + current_occ_total AS v FROM s WHERE {_NEW_SEEN}
        ORDER BY v DESC, brand_id LIMIT 8) WHERE upper(brand_name) NOT IN ('HM', 'BRAND#7', 'BRAND#13')""",
        _inner,
    ),
)
def _(spark, sf):
    top = C.brand_highlights(_all(spark, sf), STD)
    return C.exclude_brands(top, ("HM", "Brand#7", "brand#13")).select("brand_id", "brand_name", "current_global_total")


@query(
    "c25_delta_class",
    with_fact(
        f"SELECT category_name, {klass('(' + pct('current_total', 'previous_year_total') + ')')} AS delta_class FROM s",
        f"""s AS (SELECT category AS category_name, {period_measures(YEAR, ('total',))} FROM f
      WHERE {CUR} OR {within('previous_year')} GROUP BY 1)""",
    ),
)
def _(spark, sf):
    periods = C.report_periods(STD, trends=False)
    rows = A.multi_period(
        apply_filters(_all(spark, sf), STD, periods), periods, {"category_name": L.category_path()}, ("total",)
    )
    return rows.select(
        "category_name", M.delta_class(M.pct_change("current_total", "previous_year_total")).alias("delta_class")
    )


@query(
    "c26_display_formats",
    f"""SELECT o_orderkey, {money('v')} AS money, {pct_text('d')} AS delta
    FROM (SELECT o_orderkey, o_totalprice - 200000.0 AS v, (o_totalprice - 200000.0) / 1000.0 AS d FROM orders)""",
)
def _(spark, sf):
    v = F.col("o_totalprice") - F.lit(200000.0)
    return fx.table(spark, sf, "orders").select(
        "o_orderkey", M.fmt_money(v).alias("money"), M.fmt_pct(v / F.lit(1000.0)).alias("delta")
    )


@query(
    "c27_channel_label",
    with_fact(f"SELECT channel AS channel_name, {short('channel')} AS label, count(*) AS n FROM f GROUP BY 1, 2"),
)
def _(spark, sf):
    rows = fx.fact(spark, sf).where(L.not_excluded())
    return rows.groupBy(L.channel().alias("channel_name")).agg(F.count("*").alias("n")).select(
        "channel_name", L.channel_label("channel_name").alias("label"), "n"
    )


# --- detail -------------------------------------------------------------------------------------------

_DETAIL = """SELECT source_line_id, invoice_date, invoice_number, channel AS channel_name, product_id AS idart,
  CAST(brand_key AS INTEGER) AS brand_id, brand_label AS brand_name, category AS category_name, product_code,
  product_name, supplier_name, supplier_reference, CAST(quantity AS DOUBLE) AS quantity,
  CAST(total_ht AS DOUBLE) AS total_ht, CAST(margin_ht AS DOUBLE) AS margin_ht, customer_id,
  CAST(is_occ AS INTEGER) AS is_occasion,
  CASE WHEN total_ht > 0 THEN CAST(margin_ht AS DOUBLE) / CAST(total_ht AS DOUBLE) * 100.0 END AS margin_percent"""


@query("p7_detail_projection", with_fact(f"{_DETAIL} FROM f WHERE {CUR}"))
def _(spark, sf):
    return A.as_report(D.detail_rows(apply_filters(_fact(spark, sf), STD)))


@query(
    "j2_detail_with_previous",
    with_fact(
        f"""SELECT d.*, CAST(coalesce(p.q,0) AS DOUBLE) AS previous_quantity,
      CAST(coalesce(p.t,0) AS DOUBLE) AS previous_total_ht FROM ({_DETAIL} FROM f WHERE {CUR}) d
      LEFT JOIN (SELECT product_id, channel, brand_key, product_code, supplier_reference, category, is_occ,
        sum(quantity) AS q, sum(total_ht) AS t FROM f WHERE {within('previous_year')} GROUP BY ALL) p
      ON d.idart = p.product_id AND d.channel_name = p.channel AND d.brand_id = p.brand_key
        AND d.product_code = p.product_code AND d.supplier_reference = p.supplier_reference
        AND d.category_name = p.category AND d.is_occasion = CAST(p.is_occ AS INTEGER)"""
    ),
)
def _(spark, sf):
    return A.as_report(D.detail_with_previous(_all(spark, sf), STD))


@query(
    "p8_line_margin_rate",
    with_fact("""SELECT source_line_id, CASE WHEN total_ht > 0 THEN CAST(margin_ht AS DOUBLE) /
      CAST(total_ht AS DOUBLE) * 100.0 END AS margin_percent FROM fact"""),
)
def _(spark, sf):
    return fx.fact(spark, sf).select("source_line_id", M.margin_rate("margin_ht", "total_ht").alias("margin_percent"))


@query("o1_sorted_detail", with_fact(f"{_DETAIL} FROM f WHERE {CUR}"))
def _(spark, sf):
    rows = D.detail_rows(apply_filters(_fact(spark, sf), STD))
    return A.as_report(D.sort_detail(rows, "brand_name", "asc"))


@query(
    "o2_page",
    with_fact(f"{_DETAIL} FROM f WHERE {CUR} ORDER BY total_ht DESC, source_line_id LIMIT 25 OFFSET 50"),
)
def _(spark, sf):
    rows = D.sort_detail(D.detail_rows(apply_filters(_fact(spark, sf), STD)), "total_ht", "desc")
    return A.as_report(D.page(rows, 3, D.page_size(25)))


@query(
    "o3_top_categories",
    with_fact(f"""SELECT category AS category_name, CAST(sum(total_ht) AS DOUBLE) AS total_ht FROM f WHERE {CUR}
      GROUP BY 1 ORDER BY sum(total_ht) DESC, 1 LIMIT 8"""),
)
def _(spark, sf):
    totals = A.multi_period(
        apply_filters(_fact(spark, sf), STD), {"p": STD.period}, {"category_name": L.category_path()}, ("total",)
    )
    top = totals.orderBy(F.col("p_total").desc(), "category_name").limit(8)
    return top.select("category_name", F.col("p_total").cast("double").alias("total_ht"))


@query(
    "o4_top_products_per_channel",
    with_fact(f"""SELECT channel AS channel_name, product_id, CAST(sum(total_ht) AS DOUBLE) AS total_ht,
      CAST(row_number() OVER (PARTITION BY channel ORDER BY sum(total_ht) DESC, product_id) AS INTEGER) AS rank
      FROM f WHERE {CUR} GROUP BY 1, 2 QUALIFY rank <= 5"""),
)
def _(spark, sf):
    from ..sources.incremental import top_k_per

    totals = (
        apply_filters(_fact(spark, sf), STD)
        .groupBy(L.channel().alias("channel_name"), "product_id")
        .agg(F.sum("total_ht").alias("total_ht"))
    )
    return A.as_report(top_k_per(totals, ["channel_name"], [F.col("total_ht").desc(), F.col("product_id")], 5))


@query(
    "o5_key_union",
    with_fact(f"""SELECT coalesce(c.k, p.k) AS product_id, CAST(coalesce(c.t,0) AS DOUBLE) AS current_total_ht,
      CAST(coalesce(p.t,0) AS DOUBLE) AS previous_total_ht
      FROM (SELECT product_id AS k, sum(total_ht) AS t FROM f WHERE {CUR} GROUP BY 1) c
      FULL JOIN (SELECT product_id AS k, sum(total_ht) AS t FROM f WHERE {within('previous_year')} GROUP BY 1) p
      ON c.k = p.k"""),
)
def _(spark, sf):
    fact = _all(spark, sf)
    periods = C.report_periods(STD, trends=False)
    by = lambda p: apply_filters(fact, STD, {p: periods[p]}).groupBy("product_id").agg(
        F.sum("total_ht").cast("double").alias("total_ht")
    )
    return C.outer_compare(by("current"), by("previous_year"), ["product_id"], ["total_ht"])


@query(
    "o6_preferred_channel_order",
    with_fact("""SELECT channel_name, n, CAST(CASE channel_name WHEN 'Nantes' THEN 0
      WHEN 'Bordeaux' THEN 1 WHEN 'Web' THEN 2 WHEN 'École' THEN 3 WHEN 'Autre' THEN 4 ELSE 99 END AS INTEGER)
      AS preference FROM (SELECT channel AS channel_name, count(*) AS n FROM f GROUP BY 1)"""),
)
def _(spark, sf):
    counts = (
        fx.fact(spark, sf).where(L.not_excluded()).groupBy(L.channel().alias("channel_name")).agg(F.count("*").alias("n"))
    )
    return C.order_channels(counts)


@query(
    "s8_detail_csv_projection",
    with_fact(f"""SELECT invoice_date AS "Date", invoice_number AS "Facture", channel AS "Canal", product_id AS "IDART",
      brand_label AS "Marque", product_name AS "Produit", product_code AS "Code", supplier_name AS "Fournisseur",
      supplier_reference AS "Ref four", CAST(quantity AS DOUBLE) AS "Quantité", CAST(total_ht AS DOUBLE) AS "CA HT",
      CAST(margin_ht AS DOUBLE) AS "Marge HT", CASE WHEN is_occ THEN 'oui' ELSE 'non' END AS "Occasion"
      FROM f WHERE {CUR}"""),
)
def _(spark, sf):
    return A.as_report(D.export_projection(D.detail_rows(apply_filters(_fact(spark, sf), STD))))
