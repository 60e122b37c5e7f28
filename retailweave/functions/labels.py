"""Column builders for labels and classifications on the invoice-line fact.

Every function returns a native Column, so the expressions stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The labels, codes and patterns of the reporting domain.
DEFAULT_CHANNEL = "Autre"
SCHOOL_RAYON_ID = 2
CHANNELS = {
    "ECOLE": "École",
    "WEB": "Web",
    "NANTES": "Nantes",
    "BORDEAUX": "Bordeaux",
    "AUTRE": "Autre",
}
CHANNEL_SHORT_LABELS = {"Nantes": "NTS", "Bordeaux": "BDX"}
PREFERRED_CHANNELS = {"Nantes": 0, "Bordeaux": 1, "Web": 2, "Ecole": 3, "École": 3, "Autre": 4}
UNRANKED = 99
NO_BRAND, NO_RAYON, NO_FAMILY = "Sans marque", "Sans rayon", "Sans famille"
EXCLUDED_PRODUCT_IDS = (18823,)
EXCLUDED_REFERENCE_PREFIX = "REPRISE"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def blank_to_null(col: Column | str) -> Column:
    """'' becomes null; other values are kept untouched."""
    return F.nullif(_c(col), F.lit(""))


def nullable_trim(col: Column | str) -> Column:
    """Trimmed text, null when nothing is left."""
    return F.nullif(F.trim(F.coalesce(_c(col), F.lit(""))), F.lit(""))


def int_or_null(col: Column | str) -> Column:
    """0 is the source's way to say 'no reference'."""
    return F.nullif(_c(col), F.lit(0))


def text_or_empty(col: Column | str) -> Column:
    return F.trim(F.coalesce(_c(col).cast("string"), F.lit("")))


def product_label(name: Column | str, product_id: Column | str) -> Column:
    return F.coalesce(nullable_trim(name), F.concat(F.lit("Product "), _c(product_id).cast("string")))


def channel(col: Column | str = "channel_name") -> Column:
    return F.coalesce(blank_to_null(col), F.lit(DEFAULT_CHANNEL))


def channel_label(col: Column | str) -> Column:
    out = _c(col)
    for name, short in CHANNEL_SHORT_LABELS.items():
        out = F.when(_c(col) == name, F.lit(short)).otherwise(out)
    return out


def resolve_channel(ray_id: Column | str, web: Column | str, site: Column | str, name: bool = False) -> Column:
    """Channel code (or name) of a source line: school rayon first, then the web flag, then the site."""

    def value(code: str) -> Column:
        return F.lit(CHANNELS[code] if name else code)

    return (
        F.when(_c(ray_id) == SCHOOL_RAYON_ID, value("ECOLE"))
        .when(_c(web) == 1, value("WEB"))
        .when(_c(site) == 0, value("NANTES"))
        .when(_c(site) == 1, value("BORDEAUX"))
        .otherwise(value("AUTRE"))
    )


def preferred_rank(col: Column | str, order: dict[str, int] = PREFERRED_CHANNELS) -> Column:
    out = F.lit(UNRANKED)
    for name, rank in order.items():
        out = F.when(_c(col) == name, F.lit(rank)).otherwise(out)
    return out


def brand_key(brand_id: Column | str = "brand_id") -> Column:
    return F.coalesce(_c(brand_id), F.lit(0))


def brand_label(brand_id: Column | str = "brand_id", brand_name: Column | str = "brand_name") -> Column:
    key = brand_key(brand_id)
    fallback = F.when(key == 0, F.lit(NO_BRAND)).otherwise(F.concat(F.lit("IDFAB "), key.cast("string")))
    return F.coalesce(blank_to_null(brand_name), fallback)


def category_path(
    rayon: Column | str = "rayon_name",
    family: Column | str = "family_name",
    subfamily: Column | str = "subfamily_name",
) -> Column:
    """`rayon > family [> subfamily]`; concat_ws skips the null sub-family."""
    return F.concat_ws(
        " > ",
        F.coalesce(blank_to_null(rayon), F.lit(NO_RAYON)),
        F.coalesce(blank_to_null(family), F.lit(NO_FAMILY)),
        blank_to_null(subfamily),
    )


def is_occasion(code: Column | str = "product_code", name: Column | str = "product_name") -> Column:
    """Second-hand goods, told by product code or name."""
    low = F.lower(F.coalesce(_c(code), F.lit("")))
    return (
        low.startswith("b-")
        | low.contains("occas")
        | F.upper(F.coalesce(_c(code), F.lit(""))).startswith("DEPV")
        | F.lower(F.coalesce(_c(name), F.lit(""))).contains("occas")
    )


def not_excluded(
    product_id: Column | str = "product_id",
    supplier_reference: Column | str = "supplier_reference",
    ids: tuple[int, ...] = EXCLUDED_PRODUCT_IDS,
    prefix: str = EXCLUDED_REFERENCE_PREFIX,
) -> Column:
    """Standing exclusion of technical products and trade-ins."""
    return ~(
        F.coalesce(_c(product_id).isin(*ids), F.lit(False))
        | F.upper(F.coalesce(_c(supplier_reference), F.lit(""))).startswith(prefix)
    )


def eligible_reference(reference: Column | str) -> Column:
    """Feed eligibility. Unlike `is_occasion`, the markers count anywhere in the reference."""
    ref = F.lower(F.trim(F.coalesce(_c(reference), F.lit(""))))
    return (ref != "") & ~ref.contains("b-") & ~ref.contains("occas") & ~ref.contains("depv")


def image_path(image_id: Column | str) -> Column:
    """Digits of an image id as nested folders: 1234 -> 1/2/3/4."""
    return F.regexp_replace(_c(image_id).cast("string"), r"(?<=\d)(?=\d)", "/")


def slug(name: Column | str, default: str = "competitor") -> Column:
    dashed = F.regexp_replace(F.lower(F.trim(_c(name))), "[^a-z0-9]+", "-")
    return F.coalesce(blank_to_null(F.regexp_replace(dashed, "^-+|-+$", "")), F.lit(default))
