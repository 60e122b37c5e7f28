"""Line-level report: projection, comparison with the previous year, sorting, paging and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import labels as L
from ..functions import measures as M
from .filters import Filters, apply_filters

# Fixed values.
PAGE_SIZES, DEFAULT_PAGE_SIZE = (25, 50, 100), 50
SORT_COLUMNS = (
    "invoice_date",
    "invoice_number",
    "channel_name",
    "brand_name",
    "category_name",
    "product_name",
    "total_ht",
    "margin_ht",
    "quantity",
)
EXPORT_COLUMNS = {
    "Date": "invoice_date",
    "Facture": "invoice_number",
    "Canal": "channel_name",
    "IDART": "idart",
    "Marque": "brand_name",
    "Produit": "product_name",
    "Code": "product_code",
    "Fournisseur": "supplier_name",
    "Ref four": "supplier_reference",
    "Quantité": "quantity",
    "CA HT": "total_ht",
    "Marge HT": "margin_ht",
    "Occasion": "is_occasion",
}


def detail_rows(rows: DataFrame) -> DataFrame:
    """Detail projection of (filtered) fact rows, with the line margin rate."""
    return rows.select(
        "source_line_id",
        "invoice_date",
        "invoice_number",
        L.channel().alias("channel_name"),
        F.col("product_id").alias("idart"),
        L.brand_key().alias("brand_id"),
        L.brand_label().alias("brand_name"),
        L.category_path().alias("category_name"),
        "product_code",
        "product_name",
        "supplier_name",
        "supplier_reference",
        "quantity",
        "total_ht",
        "margin_ht",
        "customer_id",
        L.is_occasion().cast("int").alias("is_occasion"),
        M.margin_rate("margin_ht", "total_ht").alias("margin_percent"),
    )


MATCH_KEYS = (
    "idart",
    "channel_name",
    "brand_id",
    "product_code",
    "supplier_reference",
    "category_name",
    "is_occasion",
)


def detail_with_previous(fact: DataFrame, filters: Filters) -> DataFrame:
    """Current lines beside last year's total of the same product, channel, brand, code, reference, category and
    kind. Null keys never match; every current line repeats its group's total.

    Last year is aggregated first, so the join side is unique on the key; a product that fills the current side
    is split by the skew join.
    """
    year = cal.shift_date(filters.start, -12), cal.shift_date(filters.end, -12)
    now = detail_rows(apply_filters(fact, filters))
    before = (
        detail_rows(apply_filters(fact, filters, {"previous": year}))
        .groupBy(*MATCH_KEYS)
        .agg(F.sum("quantity").alias("previous_quantity"), F.sum("total_ht").alias("previous_total_ht"))
    )
    zero = F.lit(0)
    return now.join(before, list(MATCH_KEYS), "left").withColumns(
        {c: F.coalesce(F.col(c), zero) for c in ("previous_quantity", "previous_total_ht")}
    )


def sort_keys(sort: str = "invoice_date", direction: str = "desc") -> list[Column]:
    """Whitelisted sort column, made total by the line id."""
    name = sort if sort in SORT_COLUMNS else "invoice_date"
    key = F.col(name)
    ordered = key.asc() if direction.lower() == "asc" else key.desc()
    return [ordered, F.col("source_line_id").asc()]


def sort_detail(df: DataFrame, sort: str = "invoice_date", direction: str = "desc") -> DataFrame:
    return df.orderBy(*sort_keys(sort, direction))


def page_size(requested: int) -> int:
    return requested if requested in PAGE_SIZES else DEFAULT_PAGE_SIZE


def page(df: DataFrame, number: int, size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """Page of a sorted frame; planned as a distributed take-ordered, not a global sort."""
    return df.offset(max(0, (max(1, number) - 1) * size)).limit(size)


def export_projection(detail: DataFrame) -> DataFrame:
    flag = F.when(F.col("is_occasion") == 1, "oui").otherwise("non")
    return detail.select(
        *[(flag if name == "is_occasion" else F.col(name)).alias(title) for title, name in EXPORT_COLUMNS.items()]
    )


def export_detail_csv(
    fact: DataFrame, filters: Filters, path: str, sort: str = "invoice_date", direction: str = "desc"
) -> None:
    """Sorted CSV part files with a header each; the range-partitioned sort keeps the write distributed."""
    rows = sort_detail(detail_rows(apply_filters(fact, filters)), sort, direction)
    export_projection(rows).write.mode("overwrite").csv(path, header=True)
