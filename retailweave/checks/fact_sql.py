"""Reference SQL fragments: the fact adapter and period helpers, written for an ANSI engine."""

from __future__ import annotations

PERIODS = {
    "current": ("2001-07-01", "2001-08-01"),
    "previous_year": ("2000-07-01", "2000-08-01"),
    "previous_six_month": ("2001-01-01", "2001-02-01"),
    "previous_three_month": ("2001-04-01", "2001-05-01"),
    "previous_month": ("2001-06-01", "2001-07-01"),
    "t1y_current": ("2000-08-02", "2001-08-01"),
    "t1y_previous": ("1999-08-02", "2000-08-01"),
    "t6m_current": ("2001-02-02", "2001-08-01"),
    "t6m_previous": ("2000-02-02", "2000-08-01"),
    "t3m_current": ("2001-05-02", "2001-08-01"),
    "t3m_previous": ("2000-05-02", "2000-08-01"),
}
YEAR = ("current", "previous_year")
TREND = tuple(k for k in PERIODS if k.startswith("t"))

RAY = (
    "CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'MEDIUM' THEN 3 WHEN 'PROMO' THEN 4 "
    "WHEN 'SMALL' THEN 5 WHEN 'STANDARD' THEN 6 END"
)
CODE = (
    "(CASE WHEN p_type='PROMO' THEN 'B-' WHEN p_size=2 THEN 'DEPV' WHEN p_size=3 THEN 'X-OCCAS-' ELSE 'A-' END"
    " || CAST(p_partkey AS VARCHAR))"
)
BRAND_NO = "CAST(replace(p_brand,'Brand#','') AS INTEGER)"
NET = "CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(12,2))"
CHANNEL_CODE = (
    f"CASE WHEN {RAY}=2 THEN 'ECOLE' WHEN o_orderpriority='1-URGENT' THEN 'WEB' WHEN l_returnflag='A' THEN 'NANTES'"
    " WHEN l_returnflag='R' THEN 'BORDEAUX' ELSE 'AUTRE' END"
)
CHANNEL_NAME = (
    f"CASE WHEN {RAY}=2 THEN 'École' WHEN o_orderpriority='1-URGENT' THEN 'Web' WHEN l_returnflag='A' THEN 'Nantes'"
    " WHEN l_returnflag='R' THEN 'Bordeaux' ELSE 'Autre' END"
)
MARGIN = "CAST(net * CAST(l_partkey % 50 AS DECIMAL(4,0)) * CAST(0.01 AS DECIMAL(4,2)) AS DECIMAL(12,2))"
TTC = "CAST(net * (1 + CAST(l_tax AS DECIMAL(4,2))) AS DECIMAL(12,2))"
VERSION = "l_shipdate {0}, l_partkey {0}, l_suppkey {0}, l_quantity {0}"

FACT = f"""
lines AS (
  SELECT l.*, o.*, p.*, {NET} AS net,
         row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {VERSION.format('DESC')}) AS rn
  FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey JOIN part p ON l_partkey = p_partkey
  WHERE NOT (l_linenumber = 7 AND l_quantity = 50) AND p_size <> 1
),
fact AS (
  SELECT l_orderkey * 10 + l_linenumber AS source_line_id, l_orderkey AS source_invoice_id,
         CASE WHEN l_orderkey <> 0 THEN CAST(l_orderkey AS VARCHAR)
              ELSE 'POSTE-' || CAST(l_linenumber AS VARCHAR) END AS invoice_number,
         CAST(o_orderdate AS DATE) AS invoice_date, l_partkey AS product_id, {CODE} AS product_code,
         p_name AS product_name, p_type AS rayon_name, split_part(p_name,' ',2) AS family_name,
         CASE WHEN p_size % 5 = 0 THEN '' ELSE split_part(p_name,' ',1) END AS subfamily_name,
         CASE WHEN {BRAND_NO} <> 25 THEN {BRAND_NO} END AS brand_id,
         CASE WHEN {BRAND_NO} = 24 THEN '' ELSE p_brand END AS brand_name, '' AS supplier_name,
         'REF-' || CAST(l_partkey AS VARCHAR) AS supplier_reference, o_custkey AS customer_id,
         l_linestatus AS mode_vente, {CHANNEL_NAME} AS channel_name,
         CAST(l_quantity AS DECIMAL(12,3)) AS quantity, net AS total_ht, {TTC} AS total_ttc, {MARGIN} AS margin_ht
  FROM lines WHERE rn = 1
),
f AS (
  SELECT *, coalesce(nullif(channel_name,''),'Autre') AS channel, coalesce(brand_id,0) AS brand_key,
         coalesce(nullif(brand_name,''), CASE WHEN coalesce(brand_id,0)=0 THEN 'Sans marque'
                  ELSE 'IDFAB ' || CAST(coalesce(brand_id,0) AS VARCHAR) END) AS brand_label,
         concat_ws(' > ', coalesce(nullif(rayon_name,''),'Sans rayon'), coalesce(nullif(family_name,''),'Sans famille'),
                   nullif(subfamily_name,'')) AS category,
         (lower(product_code) LIKE 'b-%' OR lower(product_code) LIKE '%occas%' OR upper(product_code) LIKE 'DEPV%'
          OR lower(product_name) LIKE '%occas%') AS is_occ
  FROM fact WHERE NOT (product_id = 18823 OR upper(supplier_reference) LIKE 'REPRISE%')
)"""


def within(period: str, col: str = "invoice_date") -> str:
    low, high = PERIODS[period]
    return f"{col} BETWEEN DATE '{low}' AND DATE '{high}'"


def with_fact(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([FACT, *ctes]) + "\n" + body


def pct(cur: str, prev: str, guard: str = "> 0") -> str:
    return f"CASE WHEN {prev} {guard} THEN ({cur} - {prev}) / {prev} * 100.0 END"


def ratio(value: str, base: str) -> str:
    return f"CASE WHEN {base} > 0 THEN {value} / {base} ELSE 0.0 END"


def share(value: str, base: str) -> str:
    return f"CASE WHEN {base} > 0 THEN {value} / {base} * 100.0 ELSE 0.0 END"


def measure(kind: str, where: str, alias: str) -> str:
    col = {"total": "total_ht", "margin": "margin_ht", "qty": "quantity"}.get(kind)
    if col:
        return f"CAST(coalesce(sum({col}) FILTER (WHERE {where}), 0) AS DOUBLE) AS {alias}"
    if kind == "lines":
        return f"CAST(count(*) FILTER (WHERE {where}) AS BIGINT) AS {alias}"
    return f"CAST(count(DISTINCT invoice_number) FILTER (WHERE {where}) AS BIGINT) AS {alias}"


def period_measures(periods, kinds, split: bool = False) -> str:
    out = []
    for p in periods:
        for k in kinds:
            if split:
                out.append(measure(k, f"{within(p)} AND NOT is_occ", f"{p}_new_{k}"))
                out.append(measure(k, f"{within(p)} AND is_occ", f"{p}_occ_{k}"))
            else:
                out.append(measure(k, within(p), f"{p}_{k}"))
    return ", ".join(out)


def trends(kind: str = "total", value: str = "{p}_{k}") -> str:
    parts = []
    for t in ("1y", "6m", "3m"):
        cur, prev = value.format(p=f"t{t}_current", k=kind), value.format(p=f"t{t}_previous", k=kind)
        parts.append(f"{pct(cur, prev)} AS trend_{t}")
    return ", ".join(parts)


def money(v: str) -> str:
    return f"replace(format('{{:,}}', CAST(round({v}) AS BIGINT)), ',', ' ') || ' €'"


def one_decimal(v: str) -> str:
    return f"translate(format('{{:,.1f}}', round({v}, 1) + 0.0), ',.', ' ,')"


def pct_text(v: str) -> str:
    return f"CASE WHEN {v} IS NULL THEN '--' ELSE (CASE WHEN {v} > 0 THEN '+' ELSE '' END) || {one_decimal(v)} || ' %' END"


def klass(v: str) -> str:
    return f"CASE WHEN {v} > 0 THEN 'delta-up' WHEN {v} < 0 THEN 'delta-down' ELSE 'delta-neutral' END"


def mover_klass(v: str) -> str:
    return f"CASE WHEN {v} IS NULL THEN 'delta-neutral' WHEN {v} > 0 THEN 'delta-up' ELSE 'delta-down' END"


def short(v: str) -> str:
    return f"CASE {v} WHEN 'Nantes' THEN 'NTS' WHEN 'Bordeaux' THEN 'BDX' ELSE {v} END"
