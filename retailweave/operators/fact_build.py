"""Invoice line -> fact row: star enrichment, exclusion and mapping."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import labels as L

def enrich_articles(
    articles: DataFrame, rayons: DataFrame, families: DataFrame, subfamilies: DataFrame, brands: DataFrame
) -> DataFrame:
    """Article dimension with its four labels. Joined on the article side first: it is far smaller than the lines,
    so the lines shuffle at most once."""
    return (
        articles.join(rayons, "IDRAY", "left")
        .join(families, "IDFAM", "left")
        .join(subfamilies, "IDSSFAM", "left")
        .join(brands, articles["ID_FAB"] == brands["IDFAB"], "left")
        .select(
            "IDART",
            F.col("DESIGNATION").alias("article_name"),
            articles["CODE"].alias("article_code"),
            "IDRAY",
            "Rayon",
            "IDFAM",
            "Famille",
            "IDSSFAM",
            "SSFam",
            "ID_FAB",
            "NOM_FAB",
            "supplier",
            "REF_FOU",
            "IDFOU",
        )
    )


def enrich_lines(lines: DataFrame, enriched_articles: DataFrame) -> DataFrame:
    """Left join: lines without an article stay. A hot article is split by AQE (the line side of a left join)."""
    return lines.join(enriched_articles, "IDART", "left")


def keep_line() -> Column:
    """Lines the import accepts: standing exclusion plus non-zero quantity."""
    return L.not_excluded("IDART", F.trim("REF_FOU")) & (F.coalesce(F.col("Q_FAC"), F.lit(0)) != 0)


def _stamp(name: str) -> Column:
    """Blank text, the zero date and anything unreadable are null."""
    return F.col(name).try_cast("timestamp_ntz")


def resolve_invoice_ts(as_of: dt.date) -> Column:
    """Full stamp, else date and time (a bad time counts as midnight), else `as_of`."""
    day = _stamp("DateFacture").cast("date")
    at = F.concat(day.cast("string"), F.lit(" "), F.coalesce("HeureFacture", F.lit(""))).try_cast("timestamp_ntz")
    return F.coalesce(_stamp("DH_Facture"), at, day.cast("timestamp_ntz"), F.lit(as_of).cast("timestamp_ntz"))


def invoice_number(invoice_id: str = "IDFAC", post_number: str = "NumFacPoste") -> Column:
    key = F.coalesce(F.col(invoice_id), F.lit(0))
    return F.when(key != 0, key.cast("string")).otherwise(L.text_or_empty(post_number))


LINE_MEASURES = {
    "quantity": "Q_FAC",
    "unit_price_ttc": "PrixTTC",
    "total_ht": "TotalHT",
    "total_ttc": "TotalTTC",
    "margin_ht": "MARGE",
    "discount_percent": "Remise",
    "discount_amount": "RemiseMontant",
    "tax_rate": "TauxTVA",
}


def _number(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def line_facts(lines: DataFrame, as_of: dt.date, carry: Sequence[str] = ()) -> DataFrame:
    """The part of a fact row that a line alone decides. Unusable lines leave before anything is joined.

    These rows are what moves, so what others of their columns give (invoice number and date) is left to `finish_fact`.
    Columns of many values stand together before those of few: shuffled rows compress by runs of bytes.
    """
    kept = lines.where(L.not_excluded("IDART", F.lit("")) & (_number("Q_FAC") != 0))
    measures = {name: _number(source).alias(name) for name, source in LINE_MEASURES.items()}
    amounts = ("unit_price_ttc", "total_ht", "total_ttc", "margin_ht")
    return kept.select(
        F.col("IDLigneFac").alias("source_line_id"),
        F.col("IDFAC").alias("source_invoice_id"),
        L.int_or_null("IDCLI").alias("customer_id"),
        resolve_invoice_ts(as_of).alias("invoice_datetime"),
        _number("IDART").alias("product_id"),
        *[measures[name] for name in amounts],
        *carry,
        L.text_or_empty("CODE").alias("line_code"),
        L.text_or_empty("DESIGNATION_PRODUIT").alias("line_name"),
        F.when(_number("IDFAC") == 0, L.text_or_empty("NumFacPoste")).alias("post_number"),
        L.text_or_empty("MODE_VENTE").alias("mode_vente"),
        L.text_or_empty("TypePiece").alias("raw_type_piece"),
        L.text_or_empty("OrigineData").alias("raw_origin"),
        "WEB",
        "SITE",
        *[column for name, column in measures.items() if name not in amounts],
    )


ARTICLE_TEXTS = {
    "article_code": "article_code",
    "article_name": "article_name",
    "rayon_name": "Rayon",
    "family_name": "Famille",
    "subfamily_name": "SSFam",
    "brand_name": "NOM_FAB",
    "supplier_name": "supplier",
    "supplier_reference": "REF_FOU",
}
ARTICLE_IDS = {"ray_id": "IDRAY", "family_id": "IDFAM", "subfamily_id": "IDSSFAM", "brand_id": "ID_FAB", "supplier_id": "IDFOU"}


def article_facts(enriched: DataFrame) -> DataFrame:
    """The part an article alone decides, worked out once per article."""
    return enriched.select(
        F.col("IDART").alias("product_id"),
        *[L.text_or_empty(source).alias(name) for name, source in ARTICLE_TEXTS.items()],
        *[L.int_or_null(source).alias(name) for name, source in ARTICLE_IDS.items()],
    )


def trade_ins(articles: DataFrame) -> DataFrame:
    """(product_id) of the articles whose lines the standing exclusion keeps out."""
    ids = articles.select(F.col("IDART").alias("product_id"), L.text_or_empty("REF_FOU").alias("supplier_reference"))
    return ids.where(~L.not_excluded()).select("product_id")


def beside_articles(line_part: DataFrame, article_part: DataFrame) -> DataFrame:
    """Lines beside their article; lines without one stay. A hot article is split by AQE."""
    return line_part.join(article_part, "product_id", "left")


def accept(line_part: DataFrame, article_part: DataFrame) -> DataFrame:
    """Lines beside their article, without trade-ins."""
    return beside_articles(line_part, article_part).where(L.not_excluded("product_id", "supplier_reference"))


def finish_fact(accepted: DataFrame, imported_at: dt.datetime, carry: Sequence[str] = ()) -> DataFrame:
    """The 35 fact columns; the article's code and name go before the line's own."""
    now = F.lit(imported_at.isoformat(sep=" ")).cast("timestamp_ntz")
    values = {
        "invoice_number": invoice_number("source_invoice_id", "post_number"),
        "invoice_date": F.col("invoice_datetime").cast("date"),
        "product_code": F.coalesce(L.blank_to_null("article_code"), F.col("line_code")),
        "product_name": F.coalesce(L.blank_to_null("article_name"), F.col("line_name")),
        "channel_code": L.resolve_channel("ray_id", "WEB", "SITE"),
        "channel_name": L.resolve_channel("ray_id", "WEB", "SITE", name=True),
        "imported_at": now,
        "updated_at": now,
        **{name: F.coalesce(F.col(name), F.lit("")) for name in ARTICLE_TEXTS if name not in ("article_code", "article_name")},
    }
    return accepted.select(
        *[values.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in schemas.FACT], *carry
    )
