"""Adapters: the shared star-schema tables seen as the tables of the two domains.

Nothing here is part of the engine; it only gives queries, tests and the bench inputs of the right shape.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import calendar as cal
from .functions import labels as L
from .sources.incremental import latest_per_key

AS_OF = dt.date(2001, 8, 1)
START, END = dt.date(2001, 7, 1), dt.date(2001, 8, 1)
MONEY = "decimal(12,2)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- invoice lines -------------------------------------------------------------------------------------

RAYONS = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


def _rayon_id() -> Column:
    return F.nullif(F.array_position(F.array(*map(F.lit, RAYONS)), F.col("p_type")).cast("int"), F.lit(0))


def _product_code() -> Column:
    prefix = (
        F.when(F.col("p_type") == "PROMO", "B-")
        .when(F.col("p_size") == 2, "DEPV")
        .when(F.col("p_size") == 3, "X-OCCAS-")
        .otherwise("A-")
    )
    return F.concat(prefix, F.col("p_partkey").cast("string"))


def _word(i: int) -> Column:
    return F.split(F.col("p_name"), " ").getItem(i)


def _brand_number() -> Column:
    return F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")


def _money(expr: Column) -> Column:
    return expr.cast(MONEY)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    family = F.pmod(F.length(_word(1)) * 7 + F.ascii(_word(1)), F.lit(1000)).cast("int")
    sub = F.pmod(F.length(_word(0)) * 7 + F.ascii(_word(0)), F.lit(1000)).cast("int")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("IDART"),
        F.col("p_name").alias("DESIGNATION"),
        _product_code().alias("CODE"),
        _rayon_id().alias("IDRAY"),
        family.alias("IDFAM"),
        F.when(F.col("p_size") % 5 == 0, F.lit(0)).otherwise(sub).alias("IDSSFAM"),
        F.when(_brand_number() == 25, F.lit(0)).otherwise(_brand_number()).alias("ID_FAB"),
        F.lit(None).cast("string").alias("supplier"),
        F.concat(F.when(F.col("p_size") == 1, "REPRISE-").otherwise("REF-"), F.col("p_partkey").cast("string")).alias(
            "REF_FOU"
        ),
        F.lit(0).cast("bigint").alias("IDFOU"),
        F.col("p_type"),
        _word(1).alias("family_word"),
        _word(0).alias("subfamily_word"),
        F.col("p_brand"),
    )


def _labels_of(articles_df: DataFrame, key: str, label: str, key_name: str, label_name: str) -> DataFrame:
    """One label per id; ids with several words keep the smallest."""
    return articles_df.where(F.col(key) != 0).groupBy(F.col(key).alias(key_name)).agg(F.min(label).alias(label_name))


def dimensions(articles_df: DataFrame) -> dict[str, DataFrame]:
    brands = _labels_of(articles_df, "ID_FAB", "p_brand", "IDFAB", "NOM_FAB")
    return {
        "rayons": _labels_of(articles_df, "IDRAY", "p_type", "IDRAY", "Rayon"),
        "families": _labels_of(articles_df, "IDFAM", "family_word", "IDFAM", "Famille"),
        "subfamilies": _labels_of(articles_df, "IDSSFAM", "subfamily_word", "IDSSFAM", "SSFam"),
        "brands": brands.withColumn("NOM_FAB", F.when(F.col("IDFAB") == 24, "").otherwise(F.col("NOM_FAB"))),
    }


def invoice_lines(spark: SparkSession, sf_dir: str, lineitem: DataFrame | None = None) -> DataFrame:
    """Raw invoice lines. Line ids repeat; (line_version) orders the repeats. `lineitem` may be a stream."""
    li = table(spark, sf_dir, "lineitem") if lineitem is None else lineitem
    o = table(spark, sf_dir, "orders")
    rate = "decimal(4,2)"
    # The join moves decimals, which compress better than doubles, and not the sums that follow from them.
    sold = li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_shipdate",
        _money(F.col("l_extendedprice")).alias("price"),
        "l_linenumber", "l_quantity", "l_linestatus",
        F.col("l_discount").cast(rate).alias("discount"),
        F.col("l_tax").cast(rate).alias("tax"),
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "R", 1).alias("SITE"),
    )
    o = o.withColumn("WEB", F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0))
    size = F.pmod(F.col("l_partkey"), F.lit(50)).cast("decimal(4,0)")
    net = _money(F.col("price") * (F.lit(1) - F.col("discount")))
    with_net = sold.join(o, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("net", net)
    return with_net.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("IDLigneFac"),
        F.col("l_orderkey").alias("IDFAC"),
        F.concat(F.lit(" POSTE-"), F.col("l_linenumber").cast("string")).alias("NumFacPoste"),
        F.col("l_partkey").alias("IDART"),
        F.lit("").alias("CODE"),
        F.lit("").alias("DESIGNATION_PRODUIT"),
        F.col("o_custkey").alias("IDCLI"),
        "SITE",
        F.col("l_linestatus").alias("MODE_VENTE"),
        "WEB",
        F.when((F.col("l_linenumber") == 7) & (F.col("l_quantity") == 50), F.lit(0))
        .otherwise(F.col("l_quantity"))
        .cast("decimal(12,3)")
        .alias("Q_FAC"),
        F.col("price").alias("PrixTTC"),
        F.col("net").alias("TotalHT"),
        _money(F.col("net") * (F.lit(1) + F.col("tax"))).alias("TotalTTC"),
        _money(F.col("net") * size * F.lit("0.01").cast("decimal(4,2)")).alias("MARGE"),
        (F.col("discount") * 100).cast("decimal(5,2)").alias("Remise"),
        F.lit(0).cast(MONEY).alias("RemiseMontant"),
        (F.col("tax") * 100).cast("decimal(5,2)").alias("TauxTVA"),
        F.col("o_orderstatus").alias("OrigineData"),
        F.col("l_linestatus").alias("TypePiece"),
        F.when(F.col("l_linenumber") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.lit("0000-00-00 00:00:00"))
        .alias("DH_Facture"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("DateFacture"),
        F.when(F.col("l_linenumber") == 3, "not a time").otherwise("00:00:00").alias("HeureFacture"),
        F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_quantity").alias("line_version"),
    )


def fact(spark: SparkSession, sf_dir: str, periods: dict[str, cal.Period] | None = None) -> DataFrame:
    """The fact table, denormalised straight from the star tables.

    `periods` bounds the order dates that are read, as folder pruning does on the stored fact. The latest
    version of a line is taken per (order, line, date); an order has one date, so the extra key changes nothing
    and lets the date filter through.
    """
    li, o, p = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "part"))
    if periods:
        low, high = cal.span(periods)
        o = o.where((F.col("o_orderdate") >= F.lit(low)) & (F.col("o_orderdate") < F.lit(high + dt.timedelta(days=1))))
    # What one table decides is worked out on that table, before the joins.
    brand_no = "CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT)"
    code = "CASE WHEN p_type = 'PROMO' THEN 'B-' WHEN p_size = 2 THEN 'DEPV' WHEN p_size = 3 THEN 'X-OCCAS-' ELSE 'A-' END"
    articles_side = p.where("p_size <> 1").selectExpr(
        "p_partkey AS product_id",
        f"nullif(CAST(array_position(array{RAYONS}, p_type) AS INT), 0) AS ray_id",
        f"concat({code}, CAST(p_partkey AS STRING)) AS product_code",
        "p_name AS product_name",
        "p_type AS rayon_name",
        "split(p_name, ' ')[1] AS family_name",
        "CASE WHEN p_size % 5 = 0 THEN '' ELSE split(p_name, ' ')[0] END AS subfamily_name",
        f"CASE WHEN {brand_no} <> 25 THEN {brand_no} END AS brand_id",
        f"CASE WHEN {brand_no} = 24 THEN '' ELSE p_brand END AS brand_name",
        "concat('REF-', CAST(p_partkey AS STRING)) AS supplier_reference",
    )
    invoices = o.selectExpr(
        "o_orderkey AS source_invoice_id",
        "to_date(o_orderdate) AS invoice_date",
        "o_custkey AS customer_id",
        "CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS WEB",
    )
    lines = li.where("NOT (l_linenumber = 7 AND l_quantity = 50)").selectExpr(
        "*",
        "CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(12,2)) AS total_ht",
        "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 1 END AS SITE",
    )
    rows = lines.join(invoices, F.col("l_orderkey") == F.col("source_invoice_id")).join(
        articles_side, F.col("l_partkey") == F.col("product_id")
    )
    rows = latest_per_key(
        rows,
        ["l_orderkey", "l_linenumber", "invoice_date"],
        [F.col(c).desc() for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity")],
    )
    return rows.withColumn("channel_name", L.resolve_channel("ray_id", "WEB", "SITE", name=True)).selectExpr(
        "l_orderkey * 10 + l_linenumber AS source_line_id",
        "source_invoice_id",
        "CASE WHEN l_orderkey <> 0 THEN CAST(l_orderkey AS STRING)"
        " ELSE concat('POSTE-', CAST(l_linenumber AS STRING)) END AS invoice_number",
        "invoice_date",
        "product_id",
        "product_code",
        "product_name",
        "rayon_name",
        "family_name",
        "subfamily_name",
        "brand_id",
        "brand_name",
        "'' AS supplier_name",
        "supplier_reference",
        "customer_id",
        "l_linestatus AS mode_vente",
        "channel_name",
        "CAST(l_quantity AS DECIMAL(12,3)) AS quantity",
        "total_ht",
        "CAST(total_ht * (1 + CAST(l_tax AS DECIMAL(4,2))) AS DECIMAL(12,2)) AS total_ttc",
        "CAST(total_ht * CAST(pmod(l_partkey, 50) AS DECIMAL(4,0)) * CAST(0.01 AS DECIMAL(4,2)) AS DECIMAL(12,2)) AS margin_ht",
    )


# --- competitor domain ---------------------------------------------------------------------------------

COMPETITORS = (
    (1, "Alpha Sound", "c1.example.com", "index"),
    (2, "Bravo Music", "c2.example.com", "stock"),
    (3, "Charlie", "c3.example.com", "tokens"),
    (4, "Delta Audio", "c4.example.com", "signature"),
)


def competitors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(COMPETITORS, "id int, name string, domain string, profile string")


def _page_url(competitor: Column, product: Column) -> Column:
    return F.concat(
        F.lit("https://c"), competitor.cast("string"), F.lit(".example.com/p"), product.cast("string"), F.lit("/x")
    )


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id_product"),
        _product_code().alias("reference"),
        F.lpad(F.col("p_partkey").cast("string"), 13, "0").alias("ean13"),
        F.col("p_brand").alias("manufacturer_name"),
        F.when(F.col("p_size") == 50, " ").otherwise(F.concat_ws(" ", "p_brand", "p_name")).alias("product_name"),
        _money(F.col("p_retailprice")).alias("price_tax_incl"),
    )


def price_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One observation per line item; the price moves with the ordered quantity around the list price."""
    factor = F.lit("0.50").cast("decimal(4,2)") + F.col("l_quantity").cast("decimal(5,2)") * F.lit("0.02").cast(
        "decimal(4,2)"
    )
    competitor = (F.col("l_suppkey") % 4 + 1).cast("int")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return (
        table(spark, sf_dir, "lineitem")
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            competitor.alias("competitor_id"),
            F.col("l_partkey").alias("id_product"),
            _page_url(competitor, F.col("l_partkey")).alias("url"),
            _money(_money(F.col("p_retailprice")) * factor).alias("price"),
            F.lit("seed").alias("source"),
            F.col("l_shipdate").alias("observed_at"),
        )
    )


def _observed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        price_history(spark, sf_dir)
        .groupBy("id_product", "competitor_id", "url")
        .agg(F.max(F.struct("observed_at", "price")).alias("last"), F.min("observed_at").alias("created_at"))
        .select("id_product", "competitor_id", "url", "last.price", "last.observed_at", "created_at")
    )


def finals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _observed_pairs(spark, sf_dir)
        .where(F.col("id_product") % 3 != 0)
        .select(
            "id_product",
            "competitor_id",
            "url",
            F.col("price").alias("competitor_price"),
            F.lit(None).cast("int").alias("last_http_status"),
            (F.col("id_product") % 3).cast("int").alias("consecutive_http_failures"),
            "created_at",
            F.col("observed_at").alias("updated_at"),
        )
    )


def _choose(col: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (col % len(values)).cast("int") + 1)


def tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return (
        _observed_pairs(spark, sf_dir)
        .join(parts, F.col("id_product") == F.col("p_partkey"))
        .select(
            "id_product",
            "competitor_id",
            _choose(F.col("id_product"), ("matched", "not_found", "pending", "error")).alias("result"),
            "url",
            F.when(F.col("p_size") % 9 == 0, "").otherwise(F.concat_ws(" ", "p_name", "p_brand")).alias("competitor_title"),
            F.col("p_brand").alias("competitor_brand"),
            F.when(F.col("p_size") % 4 == 0, "").otherwise(F.concat("url", F.lit(".jpg"))).alias("competitor_image_url"),
            F.when(F.col("p_size") % 10 == 0, "gone").otherwise("ok").alias("competitor_page_status"),
            F.concat(F.lit("Home > "), F.col("p_type")).alias("competitor_breadcrumb"),
            (F.col("p_size") * 2).alias("score"),
            F.col("price").alias("competitor_price"),
            _choose(F.col("id_product"), ("pending", "postponed", "valid", "rejected", "ignored")).alias("validation_status"),
            F.col("p_name").alias("matched_query"),
            F.lit(None).cast("string").alias("message"),
            F.col("observed_at").alias("last_tested_at"),
        )
    )


def rejected_urls(tests_df: DataFrame) -> DataFrame:
    return tests_df.where("validation_status = 'rejected'").select("competitor_id", "url").distinct()


def reference_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two dated rows per product; the newer one of some products has no usable price."""
    price = F.col("p_retailprice").cast(MONEY)
    rows = F.array(
        F.struct(_money(price * F.lit("0.95").cast("decimal(4,2)")).alias("price_ttc"), F.lit(dt.date(2001, 1, 1)).alias("date_upd")),
        F.struct(
            F.when(F.col("p_size") % 7 == 0, F.lit(0).cast(MONEY))
            .otherwise(_money(price * F.lit("0.90").cast("decimal(4,2)")))
            .alias("price_ttc"),
            F.lit(dt.date(2001, 6, 1)).alias("date_upd"),
        ),
    )
    return (
        table(spark, sf_dir, "part")
        .where(F.col("p_partkey") % 4 == 0)
        .select(F.col("p_partkey").alias("id_product"), F.explode(rows).alias("r"))
        .select("id_product", "r.*")
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id_product"), F.col("p_partkey").alias("id_category_default")
    )


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tree by integer division; blank names at size 50 and a two-node cycle between categories 8 and 9."""
    key = F.col("p_partkey")
    parent = F.when(key == 9, 8).when(key == 8, 9).otherwise(F.floor(key / 10)).cast("bigint")
    return table(spark, sf_dir, "part").where(key > 0).select(
        key.alias("id_category"),
        parent.alias("id_parent"),
        F.when(F.col("p_size") == 50, " ").otherwise(_word(0)).alias("name"),
    )


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    j = F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)]))
    return (
        table(spark, sf_dir, "part")
        .where(key > 0)
        .select(key.alias("id_product"), size, j.alias("j"))
        .select(
            (F.col("id_product") * 10 + F.col("j")).alias("id_image"),
            "id_product",
            F.when(size % 4 == F.col("j"), 1).otherwise(0).alias("cover"),
            ((F.col("j") + size) % 3).alias("position"),
            F.when(size % 5 == F.col("j"), 1).when(size % 5 == 0, 0).alias("shop_cover"),
        )
    )


def image_shop(images_df: DataFrame) -> DataFrame:
    return images_df.where("shop_cover IS NOT NULL").select("id_image", F.col("shop_cover").alias("cover"))


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Competitor catalogue: own parts with reshuffled titles, some used, some packs, references kept on half."""
    key, size = F.col("p_partkey"), F.col("p_size")
    competitor = (key % 4 + 1).cast("int")
    suffix = F.concat(
        F.when(size % 7 == 0, " pack").otherwise(""), F.when(size % 11 == 0, " used").otherwise("")
    )
    shift = (size - 25).cast("decimal(4,0)") * F.lit("0.01").cast("decimal(4,2)")
    return table(spark, sf_dir, "part").select(
        competitor.alias("competitor_id"),
        _page_url(competitor, key).alias("url"),
        F.concat(F.col("p_name"), F.lit(" "), F.col("p_brand"), F.lit(" "), _product_code(), suffix).alias("title"),
        F.when(key % 2 == 0, _product_code()).otherwise("").alias("reference"),
        F.when(key % 3 == 0, F.lpad(key.cast("string"), 13, "0")).otherwise("").alias("ean"),
        F.col("p_brand").alias("brand"),
        F.concat(F.lit("Home > "), F.col("p_type"), F.lit(" > "), _word(1)).alias("breadcrumb"),
        _money(_money(F.col("p_retailprice")) * (F.lit(1) + shift)).alias("price"),
    )


def incoming_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test outcomes in arrival order (`seq`), several per (product, competitor)."""
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    competitor = (F.col("event_id") % 4 + 1).cast("int")
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("id_product"),
        competitor.alias("competitor_id"),
        F.when(kind == "purchase", "matched")
        .when(kind == "view", "pending")
        .when(kind == "click", "not_found")
        .when(kind == "error", "error")
        .otherwise("")
        .alias("result"),
        F.when(k % 7 == 0, " ").otherwise(_page_url(competitor, F.col("user_id"))).alias("url"),
        F.concat(F.lit("  Title "), k.cast("string")).alias("competitor_title"),
        F.when(k != 50, k).alias("score"),
        F.when(k % 11 == 0, "n/a")
        .otherwise(F.translate(F.col("value").cast("decimal(12,2)").cast("string"), ".", ","))
        .alias("competitor_price"),
        F.when(k % 13 == 0, " GONE ").otherwise("weird").alias("competitor_page_status"),
        F.col("ts").alias("tested_at"),
    )


def url_events(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Fetch outcomes per (competitor, product): 404/410/500 failures and price observations."""
    rows = table(spark, sf_dir, "events") if events is None else events
    kind = F.col("event_type")
    competitor = (F.col("user_id") % 4 + 1).cast("int")
    return rows.select(
        F.col("event_id").alias("seq"),
        F.col("ts").alias("event_at"),
        competitor.alias("competitor_id"),
        F.col("user_id").alias("id_product"),
        _page_url(competitor, F.col("user_id")).alias("url"),
        F.when(kind == "error", 404).when(kind == "signup", 410).when(kind == "purchase", 500).alias("http_status"),
        F.when(kind.isin("view", "click"), F.col("value").cast(MONEY)).alias("price"),
        F.when(kind == "error", F.repeat(F.concat(F.lit(" HTTP 404 "), F.col("event_id").cast("string")), 20))
        .when(kind == "signup", " ")
        .when(kind == "purchase", "HTTP 500")
        .alias("error"),
    )


# --- matching ------------------------------------------------------------------------------------------

MODEL_SUFFIXES = (
    "Mk II LH",
    "Les Paul '59 SB",
    "Bass Amp 2019 bk",
    "Stratocaster III left handed",
    "Pedal pack v2 x",
    "piano VIII wine candy",
)


def match_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed(spark, sf_dir).select(
        "id_product",
        F.col("reference").alias("supplier_reference"),
        F.col("ean13").alias("ean"),
        F.col("manufacturer_name").alias("brand"),
        F.col("product_name").alias("name"),
        F.col("price_tax_incl").alias("source_price"),
    )


def model_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product names with variants, years, colours and handedness, and a competitor's way to write them."""
    suffix = _choose(F.col("p_size"), MODEL_SUFFIXES)
    other = _choose(F.col("p_size") + F.col("p_partkey") % 2, MODEL_SUFFIXES)
    price = _money(F.col("p_retailprice"))
    shift = (F.col("p_size") - 25).cast("decimal(4,0)") * F.lit("0.02").cast("decimal(4,2)")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id_product"),
        (F.col("p_partkey") % 4 + 1).cast("int").alias("competitor_id"),
        F.concat_ws(" ", "p_brand", "p_name", suffix).alias("name"),
        F.concat_ws(" ", "p_name", other, "p_brand").alias("c_title"),
        F.col("p_brand").alias("brand"),
        F.when(F.col("p_size") % 8 == 0, "").otherwise(F.col("p_brand")).alias("c_brand"),
        price.alias("source_price"),
        _money(price * (F.lit(1) + shift)).alias("c_price"),
    )


def price_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals written in four ways; whole euros in the last one."""
    cents = F.col("o_totalprice").cast("decimal(14,2)")
    english = F.format_number(cents, 2)
    plain = cents.cast("string")
    way = F.col("o_orderkey") % 4
    text = (
        F.when(way == 0, F.concat(F.translate(F.replace(F.replace(english, F.lit(","), F.lit("_")), F.lit("."), F.lit(",")), "_", "."), F.lit(" €")))
        .when(way == 1, english)
        .when(way == 2, F.concat(F.translate(plain, ".", ","), F.lit(" EUR")))
        .otherwise(F.concat(F.translate(F.format_number(F.floor("o_totalprice"), 0), ",", " "), F.lit(" €")))
    )
    value = F.when(way == 3, F.floor("o_totalprice").cast("double")).otherwise(cents.cast("double"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"), value.alias("value"))


PROFILES = ("index", "stock", "tokens", "signature", "other", "other", "index")


def shop_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product pages written from the orders: seven ways to show a price, a title, a reference and a search payload.

    Every other page has a snare for its way: nested boxes, another element with the same class, a second meta price.
    """
    key = F.col("o_orderkey").cast("string")
    way = F.col("o_orderkey") % len(PROFILES)
    cents = F.col("o_totalprice").cast("decimal(14,2)").cast("string")
    cat = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    comma = F.translate(cents, ".", ",")
    snare = F.floor(F.col("o_orderkey") / len(PROFILES)) % 2 == 1
    snared = (
        F.when(way == 0, cat('<div class="fwb lh1 fs40 fs30-md fs28-sm"><div>Prix <div>TTC</div></div><div>', comma, " €</div></div><div>1 €</div>"))
        .when(way == 1, cat('<script type="application/ld+json">{"name":"Item ', key, '","mpn":"M-', key, '","gtin13":"', F.lpad(key, 13, "7"),
                            '","offers":{"price":"1.00"}}</script><div class="product-final-price"><div>TTC</div><div><b>', comma, "</b></div></div>"))
        .when(way == 2, cat('<span class="price">9,00 €</span><div class="price"><span>', comma, " €</span></div>"))
        .when(way == 3, cat('<div class="price">9,00 €</div><span class="big price"><span><b>', comma, "</b></span> €</span>"))
        .when(way == 6, cat('<meta itemprop="price" content="9.00"><meta property="og:price:amount" content="', cents, '">'))
    )
    price = (
        F.when(snare & snared.isNotNull(), snared)
        .when(way == 0, cat('<div class="x fwb lh1 fs40 fs30-md fs28-sm"> ', F.translate(cents, ".", ","), " €</div>"))
        .when(way == 1, cat('<script type="application/ld+json">{"name":"Item ', key, '","mpn":"M-', key, '","gtin13":"', F.lpad(key, 13, "7"),
                            '","offers":{"price":"', cents, '"}}</script>'))
        .when(way == 2, cat("<meta content='", cents, "' itemprop='price'>"))
        .when(way == 3, cat('<span class="price"><b>', F.translate(cents, ".", ","), "</b> €</span>"))
        .when(way == 4, cat("<p>Prix : ", F.translate(cents, ".", ","), " € TTC</p>"))
        .when(way == 5, cat('<meta property="og:price:amount" content="', cents, '">'))
        .otherwise(cat('<script>var p = {"salePrice": "', cents, '"};</script>'))
    )
    reference = (
        F.when(way == 0, cat("<p><span>Référence marque :</span> <span> R-", key, " </span></p>"))
        .when(way == 3, cat('<ul><li class="spec-item">Réf : S-', key, '</li><li class="spec-item">EAN : ', F.lpad(key, 8, "3"), "</li></ul>"))
        .otherwise("")
    )
    crumb = F.when(way % 2 == 0, cat('<nav class="top breadcrumb"><a href="/">Accueil</a> » <a href="/g">Guitares &amp; cie</a> / <b>', key, "x</b></nav>")).otherwise("")
    image = F.when(way == 2, '<meta property="og:image" content="//img.example.com/a.jpg">').when(way == 3, cat('<img id="photoCover" data-src="i/', key, '.jpg">')).otherwise("")
    search = F.when(
        way == 2,
        cat("<script>tho.bootstrapModule('search.index', [{\"articleListsSettings\":{\"articles\":[{\"title\":\"T [", key,
            ']","manufacturer":"M","relativeLink":"a', key, '.htm"},{"model":"dup","relativeLink":"a', key,
            '.htm"}],"alternativeArticles":[{"name":"N","url":"b.htm"},{"title":"x"}]}}], {"k":[1]});</script>'),
    ).otherwise("")
    url = F.when(way == 3, cat("https://c4.example.com/p", key, "/x")).otherwise(cat("https://Shop.example.com/item/", key, "/?a=1#f"))
    head = F.when(way == 5, cat('<meta property="og:title" content="Social ', key, '">')).otherwise(cat("<title>Doc ", key, "</title>"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("page_id"),
        url.alias("url"),
        _choose(F.col("o_orderkey"), PROFILES).alias("profile"),
        cat("<html><head>", head, image, "</head><body>", crumb, price, reference, search, "</body></html>").alias("html"),
        F.col("o_totalprice").cast("decimal(14,2)").cast("double").alias("expected"),
    )
