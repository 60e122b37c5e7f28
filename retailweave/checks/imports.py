"""Queries of the import side: scans, mapping, upserts, observation sinks and backfills."""

from __future__ import annotations

import datetime as dt
from contextlib import contextmanager

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixtures as fx
from ..functions import labels as L
from ..operators import feed as W
from ..operators import fact_build as B
from ..operators.aggregates import as_report
from ..plans import import_job as job
from ..session import SCRATCH, heavy_writes, remove_path, work_path
from ..sources import fact_store
from ..sources import incremental as S
from ..sources import observations as O
from .competitor_sql import with_ci
from .fact_sql import BRAND_NO, CHANNEL_CODE, CHANNEL_NAME, CODE, NET, RAY, TTC, MARGIN, VERSION, with_fact
from .registry import query

NOW = dt.datetime(2001, 8, 2, 3, 4, 5)


def _catalogue(spark, sf):
    articles = fx.articles(spark, sf)
    return job.Catalogue(articles, **fx.dimensions(articles))


@contextmanager
def _source_lines(spark, sf):
    """The raw lines as a stored table, which is what an import scans: several runs do not each build them."""
    path = work_path(spark, "invoice-lines")
    lines = fx.invoice_lines(spark, sf)
    with heavy_writes(spark):
        lines.write.options(**SCRATCH).parquet(path)
    try:
        yield spark.read.schema(lines.schema).parquet(path)
    finally:
        remove_path(spark, path)


# --- scans --------------------------------------------------------------------------------------------


@query(
    "s1_cursor_scan",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 500",
)
def _(spark, sf):
    return S.scan_after(fx.table(spark, sf, "orders"), "o_orderkey", 1000, 500).select("o_orderkey", "o_custkey")


@query("s2_high_water_mark", with_fact("SELECT coalesce(max(source_line_id), 0) AS high_water_mark FROM fact"))
def _(spark, sf):
    return S.high_water_mark(fx.fact(spark, sf))


@query(
    "s3_since_backfill",
    """SELECT l_orderkey * 10 + l_linenumber AS line_id, l_partkey AS product, CAST(o_orderdate AS DATE) AS d
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE CAST(o_orderdate AS DATE) >= DATE '2001-01-15'""",
)
def _(spark, sf):
    rows = S.scan_since(fx.invoice_lines(spark, sf), S.parse_since("2001-01-15"))
    return rows.select(F.col("IDLigneFac").alias("line_id"), F.col("IDART").alias("product"), S.line_date().alias("d"))


@query(
    "s4_row_limited_load",
    f"""SELECT l_orderkey * 10 + l_linenumber AS line_id, l_partkey AS product, l_quantity AS qty
    FROM lineitem JOIN part ON l_partkey = p_partkey WHERE NOT (l_linenumber = 7 AND l_quantity = 50)
      AND p_size <> 1 AND l_partkey <> 18823 AND l_orderkey * 10 + l_linenumber > 500
    ORDER BY line_id, {VERSION.format('DESC')} LIMIT 1000""",
)
def _(spark, sf):
    lines = S.scan_after(fx.invoice_lines(spark, sf), "IDLigneFac", 500)
    rows = job.accepted_lines(lines, _catalogue(spark, sf), 1000, [F.col("line_version").desc()])
    return rows.select(
        F.col("IDLigneFac").alias("line_id"), F.col("IDART").alias("product"), F.col("Q_FAC").cast("double").alias("qty")
    )


# --- projections --------------------------------------------------------------------------------------


@query(
    "f2_standing_exclusion",
    """SELECT l_orderkey * 10 + l_linenumber AS line_id, l_partkey AS product
    FROM lineitem JOIN part ON l_partkey = p_partkey
    WHERE NOT (l_partkey IN (18823, 42, 77) OR p_size = 1)""",
)
def _(spark, sf):
    """Trade-in references and the excluded ids (the default one plus two that exist at every scale)."""
    lines = fx.invoice_lines(spark, sf).join(fx.articles(spark, sf).select("IDART", "REF_FOU"), "IDART")
    kept = lines.where(L.not_excluded("IDART", "REF_FOU", ids=(*L.EXCLUDED_PRODUCT_IDS, 42, 77)))
    return kept.select(F.col("IDLigneFac").alias("line_id"), F.col("IDART").alias("product"))


@query("f10_feed_eligibility", with_ci("SELECT id_product, reference FROM eligible"))
def _(spark, sf):
    return W.eligible_feed(fx.feed(spark, sf)).select("id_product", "reference")


_DIMS = f"""a AS (SELECT p_partkey AS IDART, p_name AS DESIGNATION, {CODE} AS CODE, {RAY} AS IDRAY,
    CAST((length(split_part(p_name,' ',2)) * 7 + ascii(split_part(p_name,' ',2))) % 1000 AS INTEGER) AS IDFAM,
    CASE WHEN p_size % 5 = 0 THEN 0 ELSE CAST((length(split_part(p_name,' ',1)) * 7 + ascii(split_part(p_name,' ',1)))
      % 1000 AS INTEGER) END AS IDSSFAM, CASE WHEN {BRAND_NO} = 25 THEN 0 ELSE {BRAND_NO} END AS ID_FAB,
    CASE WHEN p_size = 1 THEN 'REPRISE-' ELSE 'REF-' END || CAST(p_partkey AS VARCHAR) AS REF_FOU,
    split_part(p_name,' ',2) AS fw, split_part(p_name,' ',1) AS sw, p_type, p_brand FROM part),
  ray AS (SELECT IDRAY, min(p_type) AS Rayon FROM a WHERE IDRAY <> 0 GROUP BY 1),
  fam AS (SELECT IDFAM, min(fw) AS Famille FROM a WHERE IDFAM <> 0 GROUP BY 1),
  sub AS (SELECT IDSSFAM, min(sw) AS SSFam FROM a WHERE IDSSFAM <> 0 GROUP BY 1),
  fab AS (SELECT ID_FAB AS IDFAB, CASE WHEN ID_FAB = 24 THEN '' ELSE min(p_brand) END AS NOM_FAB FROM a
    WHERE ID_FAB <> 0 GROUP BY ID_FAB),
  art AS (SELECT a.*, Rayon, Famille, SSFam, NOM_FAB FROM a LEFT JOIN ray USING (IDRAY) LEFT JOIN fam USING (IDFAM)
    LEFT JOIN sub USING (IDSSFAM) LEFT JOIN fab ON ID_FAB = IDFAB),
  src AS (SELECT l.*, o.*, art.*, {NET} AS net, l_orderkey * 10 + l_linenumber AS line_id
    FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey LEFT JOIN art ON l_partkey = IDART)"""


@query(
    "j1_star_enrichment",
    f"""WITH {_DIMS} SELECT line_id, l_partkey AS product, DESIGNATION AS article_name, Rayon AS rayon, Famille AS family,
      SSFam AS subfamily, NOM_FAB AS brand FROM src""",
)
def _(spark, sf):
    rows = B.enrich_lines(fx.invoice_lines(spark, sf), _catalogue(spark, sf).enriched())
    return rows.select(
        F.col("IDLigneFac").alias("line_id"),
        F.col("IDART").alias("product"),
        "article_name",
        F.col("Rayon").alias("rayon"),
        F.col("Famille").alias("family"),
        F.col("SSFam").alias("subfamily"),
        F.col("NOM_FAB").alias("brand"),
    )


_STAMP = "'2001-08-02 03:04:05'"
_FACT35 = f"""SELECT line_id AS source_line_id, l_orderkey AS source_invoice_id,
  CASE WHEN l_orderkey <> 0 THEN CAST(l_orderkey AS VARCHAR) ELSE 'POSTE-' || CAST(l_linenumber AS VARCHAR) END AS invoice_number,
  CAST(o_orderdate AS DATE) AS invoice_date, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS invoice_datetime,
  l_partkey AS product_id, CODE AS product_code, DESIGNATION AS product_name, IDRAY AS ray_id,
  coalesce(Rayon,'') AS rayon_name, IDFAM AS family_id, coalesce(Famille,'') AS family_name,
  IDSSFAM AS subfamily_id, coalesce(SSFam,'') AS subfamily_name, ID_FAB AS brand_id,
  coalesce(NOM_FAB,'') AS brand_name, CAST(0 AS BIGINT) AS supplier_id, '' AS supplier_name,
  REF_FOU AS supplier_reference, o_custkey AS customer_id, l_linestatus AS mode_vente,
  {CHANNEL_CODE.replace(RAY, 'IDRAY')} AS channel_code, {CHANNEL_NAME.replace(RAY, 'IDRAY')} AS channel_name,
  CAST(l_quantity AS DOUBLE) AS quantity, CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS DOUBLE) AS unit_price_ttc,
  CAST(net AS DOUBLE) AS total_ht, CAST({TTC} AS DOUBLE) AS total_ttc, CAST({MARGIN} AS DOUBLE) AS margin_ht,
  CAST(CAST(l_discount AS DECIMAL(4,2)) * 100 AS DOUBLE) AS discount_percent, CAST(0 AS DOUBLE) AS discount_amount,
  CAST(CAST(l_tax AS DECIMAL(4,2)) * 100 AS DOUBLE) AS tax_rate, o_orderstatus AS raw_origin, l_linestatus AS raw_type_piece,
  {_STAMP} AS imported_at, {_STAMP} AS updated_at"""
_KEEP = "NOT (l_linenumber = 7 AND l_quantity = 50) AND REF_FOU NOT LIKE 'REPRISE%' AND l_partkey <> 18823"


def _stamps_as_text(df):
    stamps = [f.name for f in df.schema if isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType))]
    text = df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in stamps})
    ids = [f.name for f in df.schema if isinstance(f.dataType, (T.IntegerType, T.LongType)) and f.name != "source_line_id"]
    return as_report(text).fillna(0, ids)  # null ids shown as 0


@query("p1_fact_mapping", f"WITH {_DIMS} {_FACT35} FROM src WHERE {_KEEP}")
def _(spark, sf):
    rows = job.fact_rows(fx.invoice_lines(spark, sf), _catalogue(spark, sf), fx.AS_OF, NOW)
    return _stamps_as_text(rows)


_IMPORTED = f"""WITH {_DIMS} SELECT * EXCLUDE (rn) FROM ({_FACT35.replace('SELECT', 'SELECT row_number() OVER (PARTITION BY line_id'
      + ' ORDER BY ' + VERSION.format('DESC') + ') AS rn,', 1)} FROM src WHERE {_KEEP} AND line_id > 0) WHERE rn = 1"""


@query(
    "s6_incremental_import",
    _IMPORTED,
)
def _(spark, sf):
    """Two runs into a new store: a backfill of the recent lines, then everything again since the first day."""
    target = work_path(spark, "fact-store")
    catalogue = _catalogue(spark, sf)
    with _source_lines(spark, sf) as lines:
        for since in ("2001-01-01", "1990-01-01"):
            job.import_invoice_lines(spark, lines, catalogue, target, fx.AS_OF, NOW, since=since, version="line_version")
    return _stamps_as_text(fact_store.read_fact(spark, target).drop("invoice_month"))


@query("s6_cursor_import", _IMPORTED)
def _(spark, sf):
    """Three runs by the cursor into a new store: two of a limited number of rows, one of the rest."""
    target = work_path(spark, "fact-store")
    catalogue = _catalogue(spark, sf)
    with _source_lines(spark, sf) as lines:
        for max_rows in (1000, 2000, None):
            job.import_invoice_lines(
                spark, lines, catalogue, target, fx.AS_OF, NOW, max_rows=max_rows, version="line_version"
            )
    return _stamps_as_text(fact_store.read_fact(spark, target).drop("invoice_month"))


@query(
    "p2_channel_resolution",
    f"""SELECT l_orderkey * 10 + l_linenumber AS line_id, {CHANNEL_CODE} AS code, {CHANNEL_NAME} AS name
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
)
def _(spark, sf):
    rows = fx.invoice_lines(spark, sf).join(fx.articles(spark, sf).select("IDART", "IDRAY"), "IDART")
    return rows.select(
        F.col("IDLigneFac").alias("line_id"),
        L.resolve_channel("IDRAY", "WEB", "SITE").alias("code"),
        L.resolve_channel("IDRAY", "WEB", "SITE", name=True).alias("name"),
    )


@query(
    "p3_brand_label",
    f"""SELECT p_partkey AS product_id, CASE WHEN {BRAND_NO} = 24 THEN 'IDFAB 24' WHEN {BRAND_NO} = 25 AND p_size % 2 = 0
      THEN 'Sans marque' ELSE p_brand END AS label FROM part""",
)
def _(spark, sf):
    number = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    name = F.when((number == 24) | ((number == 25) & (F.col("p_size") % 2 == 0)), "").otherwise(F.col("p_brand"))
    return fx.table(spark, sf, "part").select(
        F.col("p_partkey").alias("product_id"), L.brand_label(F.when(number != 25, number), name).alias("label")
    )


@query(
    "p4_category_path",
    with_fact("""SELECT source_line_id, CASE WHEN subfamily_name = '' THEN rayon_name || ' > ' || family_name
      ELSE rayon_name || ' > ' || family_name || ' > ' || subfamily_name END AS category FROM fact"""),
)
def _(spark, sf):
    return fx.fact(spark, sf).select("source_line_id", L.category_path().alias("category"))


@query(
    "p5_invoice_timestamp",
    """SELECT l_orderkey * 10 + l_linenumber AS line_id, l_partkey AS product, strftime(CASE
      WHEN l_linenumber = 5 THEN TIMESTAMP '2001-08-01 00:00:00'
      WHEN l_linenumber % 2 = 0 THEN o_orderdate
      WHEN l_linenumber = 3 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)
      ELSE CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL '14:30:05' HOUR_SECOND END,
      '%Y-%m-%d %H:%M:%S') AS stamp FROM lineitem JOIN orders ON l_orderkey = o_orderkey""".replace(
        "INTERVAL '14:30:05' HOUR_SECOND", "INTERVAL 52205 SECOND"
    ),
)
def _(spark, sf):
    """Full stamp, date with a good or a bad time, and neither (today)."""
    n = F.substring("NumFacPoste", -1, 1).cast("int")
    rows = fx.invoice_lines(spark, sf).withColumns(
        {
            "DateFacture": F.when(n == 5, "0000-00-00").otherwise(F.col("DateFacture")),
            "HeureFacture": F.when(n == 3, "not a time").otherwise("14:30:05"),
        }
    )
    return rows.select(
        F.col("IDLigneFac").alias("line_id"),
        F.col("IDART").alias("product"),
        F.date_format(B.resolve_invoice_ts(fx.AS_OF), "yyyy-MM-dd HH:mm:ss").alias("stamp"),
    )


@query(
    "p6_invoice_number",
    """SELECT l_orderkey * 10 + l_linenumber AS line_id, CASE WHEN l_orderkey <> 0 THEN CAST(l_orderkey AS VARCHAR)
      ELSE 'POSTE-' || CAST(l_linenumber AS VARCHAR) END AS invoice_number FROM lineitem""",
)
def _(spark, sf):
    return fx.invoice_lines(spark, sf).select(
        F.col("IDLigneFac").alias("line_id"), B.invoice_number().alias("invoice_number")
    )


@query(
    "p9_null_trim_normalisers",
    """SELECT p_partkey AS id_product, CASE WHEN p_size % 10 <> 0 THEN p_brand END AS brand,
      CASE WHEN p_size = 50 THEN 'Product ' || CAST(p_partkey AS VARCHAR) ELSE p_name END AS name FROM part""",
)
def _(spark, sf):
    padded = F.when(F.col("p_size") % 10 == 0, "  ").otherwise(F.concat(F.lit(" "), "p_brand", F.lit("  ")))
    name = F.when(F.col("p_size") == 50, " ").otherwise(F.col("p_name"))
    return fx.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id_product"),
        L.nullable_trim(padded).alias("brand"),
        L.product_label(name, "p_partkey").alias("name"),
    )


@query(
    "p10_image_path",
    """SELECT o_orderkey AS id_image, array_to_string(string_split(CAST(o_orderkey AS VARCHAR), ''), '/') AS path
    FROM orders""",
)
def _(spark, sf):
    return fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id_image"), L.image_path("o_orderkey").alias("path")
    )


# --- upsert and schema evolution ----------------------------------------------------------------------

_UP = f"""v AS (SELECT l_orderkey * 10 + l_linenumber AS line_id, l_partkey AS product, CAST({NET} AS DOUBLE) AS total,
    l_orderkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {VERSION.format('DESC')}) AS newest,
    row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {VERSION.format('ASC')}) AS oldest,
    o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query(
    "s5_upsert",
    f"""WITH {_UP} SELECT n.line_id, n.product, n.total,
      CASE WHEN n.o_orderdate < TIMESTAMP '2000-01-01' THEN 'first load' ELSE 'second load' END AS imported_at,
      'second load' AS updated_at FROM (SELECT * FROM v WHERE newest = 1) n""",
)
def _(spark, sf):
    """Old versions of the early lines are stored; the newest version of every line comes in."""
    lines = fx.invoice_lines(spark, sf).select(
        F.col("IDLigneFac").alias("line_id"),
        F.col("IDART").alias("product"),
        F.col("TotalHT").cast("double").alias("total"),
        "DateFacture",
        "line_version",
    )
    load = lambda df, label: df.select(
        "line_id", "product", "total", F.lit(label).alias("imported_at"), F.lit(label).alias("updated_at")
    )
    early = lines.where("DateFacture < '2000-01-01'")
    stored = load(S.latest_per_key(early, ["line_id"], [F.col("line_version").asc()]), "first load")
    incoming = load(S.latest_per_key(lines, ["line_id"], [F.col("line_version").desc()]), "second load")
    return S.upsert(stored, incoming, ["line_id"], keep_from_target=["imported_at"])


@query(
    "s7_schema_evolution",
    with_fact("""SELECT source_line_id, CAST(NULL AS VARCHAR) AS brand_name, CAST(NULL AS VARCHAR) AS rayon_name,
      family_name, CAST(NULL AS VARCHAR) AS subfamily_name FROM fact"""),
)
def _(spark, sf):
    old = fx.fact(spark, sf).select("source_line_id", "family_name")
    names = ("brand_name", "rayon_name", "family_name", "subfamily_name")
    return S.ensure_columns(old, {n: "string" for n in names}).select("source_line_id", *names)


# --- observations -------------------------------------------------------------------------------------


@query(
    "s9_append_observations",
    with_ci("""SELECT competitor_id, id_product, url, CAST(price AS DOUBLE) AS price, source,
      CAST(observed_at AS DATE) AS day FROM history
      UNION ALL SELECT CAST(user_id % 4 + 1 AS INTEGER), user_id, 'https://x/' || CAST(user_id AS VARCHAR),
        CAST(CAST(value AS DECIMAL(12,2)) AS DOUBLE), 'event', CAST(ts AS DATE) FROM events
      WHERE event_type IN ('view','click') AND user_id > 0"""),
)
def _(spark, sf):
    """Prices with a comma; errors carry no number and sign-ups no url."""
    kind = F.col("event_type")
    incoming = fx.table(spark, sf, "events").select(
        (F.col("user_id") % 4 + 1).cast("int").alias("competitor_id"),
        F.col("user_id").alias("id_product"),
        F.when(kind == "signup", "  ").otherwise(F.concat(F.lit("https://x/"), F.col("user_id").cast("string"))).alias("url"),
        F.when(kind == "error", "n/a")
        .when(kind == "purchase", F.lit(None))
        .otherwise(F.translate(F.col("value").cast("decimal(12,2)").cast("string"), ".", ","))
        .alias("price"),
        F.lit("event").alias("source"),
        F.col("ts").alias("observed_at"),
    )
    out = O.append_observations(fx.price_history(spark, sf), incoming)
    return out.select(
        "competitor_id", "id_product", "url", F.col("price").cast("double").alias("price"), "source",
        F.to_date("observed_at").alias("day"),
    )


@query(
    "s10_delete_observations",
    with_ci("""SELECT h.competitor_id, h.id_product, CAST(h.price AS DOUBLE) AS price, CAST(h.observed_at AS DATE) AS day
      FROM history h WHERE NOT EXISTS (SELECT 1 FROM tests t WHERE t.validation_status = 'rejected' AND t.id_product > 0
      AND t.id_product = h.id_product AND t.competitor_id = h.competitor_id AND t.url = h.url)"""),
)
def _(spark, sf):
    keys = fx.tests(spark, sf).where("validation_status = 'rejected'")
    out = O.delete_observations(fx.price_history(spark, sf), keys)
    return out.select(
        "competitor_id", "id_product", F.col("price").cast("double").alias("price"), F.to_date("observed_at").alias("day")
    )


@query(
    "s11_backfill_finals",
    with_ci("""SELECT f.id_product, f.competitor_id, CAST(CASE WHEN f.id_product % 2 = 0 THEN t.competitor_price
        ELSE f.competitor_price END AS DOUBLE) AS price,
      CAST(CASE WHEN f.id_product % 2 = 0 THEN t.last_tested_at ELSE f.created_at END AS DATE) AS created
      FROM finals f JOIN tests t USING (id_product, competitor_id)"""),
)
def _(spark, sf):
    bare = fx.finals(spark, sf)
    even = F.col("id_product") % 2 == 0
    bare = bare.withColumns(
        {c: F.when(~even, F.col(c)) for c in ("competitor_price", "created_at", "updated_at")}
    )
    out = O.backfill_finals(bare, fx.tests(spark, sf), dt.datetime(2001, 8, 1))
    return out.select(
        "id_product", "competitor_id", F.col("competitor_price").cast("double").alias("price"),
        F.to_date("created_at").alias("created"),
    )


@query(
    "s11_seed_history",
    with_ci("""SELECT competitor_id, id_product, url, CAST(competitor_price AS DOUBLE) AS price, 'backfill' AS source,
      CAST(updated_at AS DATE) AS day FROM finals"""),
)
def _(spark, sf):
    return O.seed_history(fx.finals(spark, sf)).select(
        "competitor_id", "id_product", "url", F.col("price").cast("double").alias("price"), "source",
        F.to_date("observed_at").alias("day"),
    )


@query(
    "s11_backfill_statuses",
    with_ci("""SELECT id_product, competitor_id, CASE WHEN score > 50 THEN validation_status ELSE 'pending' END AS validation_status,
      competitor_page_status FROM tests"""),
)
def _(spark, sf):
    blanked = fx.tests(spark, sf).withColumn(
        "validation_status", F.when(F.col("score") > 50, F.col("validation_status")).otherwise(" ")
    )
    return O.backfill_statuses(blanked).select(
        "id_product", "competitor_id", "validation_status", "competitor_page_status"
    )


@query(
    "s12_json_payload",
    """SELECT user_id, CAST(count(*) AS BIGINT) AS items, CAST(0 AS BIGINT) AS ignored, sum(CAST(regexp_extract(props,
      '([0-9]+)', 1) AS BIGINT)) AS score_sum FROM events WHERE event_type <> 'error' GROUP BY 1
    UNION ALL SELECT user_id, 0, CAST(count(*) AS BIGINT), 0 FROM events WHERE event_type = 'error' GROUP BY 1""".replace(
        "sum(CAST", "CAST(sum(CAST"
    ).replace("AS BIGINT)) AS score_sum", "AS BIGINT)) AS BIGINT) AS score_sum"),
)
def _(spark, sf):
    """Event properties sent as one-item payloads; errors send broken JSON."""
    schema = T.StructType(
        [
            T.StructField("competitor_id", T.IntegerType()),
            T.StructField("tests", T.ArrayType(T.StructType([T.StructField("k", T.IntegerType())]))),
        ]
    )
    body = F.concat(F.lit('{"competitor_id": 1, "tests": ['), "props", F.lit("]}"))
    docs = fx.table(spark, sf, "events").select(
        "user_id", F.when(F.col("event_type") == "error", '{"competitor_id": 1, "tests": [{').otherwise(body).alias("doc")
    )
    rows = O.parse_payload(docs, "doc", schema, "tests")
    return rows.groupBy("user_id", "ok").agg(
        F.count_if("ok").alias("items"), F.count_if(~F.col("ok")).alias("ignored"), F.coalesce(F.sum("item.k"), F.lit(0)).alias("score_sum")
    ).drop("ok")
