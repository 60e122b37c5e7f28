"""Table schemas of the two domains."""

from __future__ import annotations

from pyspark.sql import types as T

_MONEY = T.DecimalType(12, 2)
_QTY = T.DecimalType(12, 3)
_PCT = T.DecimalType(5, 2)


def _struct(spec: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in spec.items()])


_L, _I, _S, _D, _TS = T.LongType(), T.IntegerType(), T.StringType(), T.DateType(), T.TimestampNTZType()

FACT = _struct(
    {
        "source_line_id": _L,
        "source_invoice_id": _L,
        "invoice_number": _S,
        "invoice_date": _D,
        "invoice_datetime": _TS,
        "product_id": _L,
        "product_code": _S,
        "product_name": _S,
        "ray_id": _I,
        "rayon_name": _S,
        "family_id": _I,
        "family_name": _S,
        "subfamily_id": _I,
        "subfamily_name": _S,
        "brand_id": _I,
        "brand_name": _S,
        "supplier_id": _L,
        "supplier_name": _S,
        "supplier_reference": _S,
        "customer_id": _L,
        "mode_vente": _S,
        "channel_code": _S,
        "channel_name": _S,
        "quantity": _QTY,
        "unit_price_ttc": _MONEY,
        "total_ht": _MONEY,
        "total_ttc": _MONEY,
        "margin_ht": _MONEY,
        "discount_percent": _PCT,
        "discount_amount": _MONEY,
        "tax_rate": _PCT,
        "raw_origin": _S,
        "raw_type_piece": _S,
        "imported_at": _TS,
        "updated_at": _TS,
    }
)

COMPETITOR = _struct({"id": _I, "name": _S, "domain": _S})

FEED = _struct(
    {
        "id_product": _L,
        "reference": _S,
        "ean13": _S,
        "manufacturer_name": _S,
        "product_name": _S,
        "price_tax_incl": _MONEY,
    }
)

TEST_RESULT = _struct(
    {
        "id_product": _L,
        "competitor_id": _I,
        "result": _S,
        "url": _S,
        "competitor_title": _S,
        "competitor_brand": _S,
        "competitor_image_url": _S,
        "competitor_page_status": _S,
        "competitor_breadcrumb": _S,
        "score": _I,
        "competitor_price": _MONEY,
        "validation_status": _S,
        "matched_query": _S,
        "message": _S,
        "last_tested_at": _TS,
    }
)

FINAL = _struct(
    {
        "id_product": _L,
        "competitor_id": _I,
        "url": _S,
        "competitor_price": _MONEY,
        "last_http_status": _I,
        "consecutive_http_failures": _I,
        "last_http_error_at": _TS,
        "last_http_error_message": _S,
        "created_at": _TS,
        "updated_at": _TS,
    }
)

PRICE_HISTORY = _struct(
    {"competitor_id": _I, "id_product": _L, "url": _S, "price": _MONEY, "source": _S, "observed_at": _TS}
)

TEST_PAYLOAD = _struct(
    {
        "competitor_id": _I,
        "tests": T.ArrayType(
            _struct(
                {
                    "id_product": _L,
                    "result": _S,
                    "url": _S,
                    "title": _S,
                    "score": _I,
                    "price": T.DoubleType(),
                    "matched_query": _S,
                    "message": _S,
                }
            )
        ),
    }
)

# State vocabularies.
RESULTS = ("matched", "pending", "not_found", "cloudflare", "search_input_not_found", "error")
REVIEWS = ("pending", "postponed", "valid", "rejected", "ignored")
PAGE_STATES = ("ok", "gone")
