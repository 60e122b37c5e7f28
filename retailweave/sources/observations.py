"""Append-only price observations, their deletion, and the backfills that seed them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import labels as L

PRICE = "decimal(12,2)"
DEFAULT_STATUS = {"validation_status": "pending", "competitor_page_status": "ok"}


def decimal_price(col: Column | str) -> Column:
    """Two-decimal price of a number or text (comma or dot); null when it is not a number."""
    text = L.nullable_trim((F.col(col) if isinstance(col, str) else col).cast("string"))
    return F.translate(text, ",", ".").try_cast(PRICE)


def valid_observations(observations: DataFrame, price: str = "price") -> DataFrame:
    """Rows a price history accepts: numeric price, positive product, non-blank url."""
    return observations.withColumn(price, decimal_price(price)).where(
        F.col(price).isNotNull() & (F.col("id_product") > 0) & (F.trim(F.coalesce("url", F.lit(""))) != "")
    )


def append_observations(history: DataFrame, observations: DataFrame) -> DataFrame:
    return history.unionByName(valid_observations(observations).select(*history.columns))


def delete_observations(history: DataFrame, keys: DataFrame) -> DataFrame:
    """Drops the history of the given (competitor, product, url)."""
    gone = keys.select("competitor_id", "id_product", F.trim("url").alias("url")).where(
        (F.col("id_product") > 0) & (F.col("url") != "")
    )
    return history.join(gone, ["competitor_id", "id_product", "url"], "left_anti")


def backfill_statuses(tests: DataFrame, defaults: dict[str, str] = DEFAULT_STATUS) -> DataFrame:
    return tests.withColumns({c: F.coalesce(L.nullable_trim(c), F.lit(v)) for c, v in defaults.items()})


def backfill_finals(finals: DataFrame, tests: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Timestamps and price of final urls taken from their tests: the newest priced test gives the price."""
    known = tests.groupBy("id_product", "competitor_id").agg(
        F.max("last_tested_at").alias("__tested"),
        F.max_by("competitor_price", F.when(F.col("competitor_price").isNotNull(), F.col("last_tested_at"))).alias("__price"),
    )
    stamp = F.coalesce("__tested", F.lit(as_of).cast("timestamp_ntz"))
    return (
        finals.join(known, ["id_product", "competitor_id"], "left")
        .withColumns(
            {
                "created_at": F.coalesce("created_at", stamp),
                "updated_at": F.coalesce("updated_at", stamp),
                "competitor_price": F.coalesce("competitor_price", "__price"),
            }
        )
        .select(*finals.columns)
    )


def seed_history(finals: DataFrame) -> DataFrame:
    """First observation of every priced final url."""
    return finals.where(F.col("competitor_price").isNotNull()).select(
        "competitor_id",
        "id_product",
        "url",
        F.col("competitor_price").alias("price"),
        F.lit("backfill").alias("source"),
        F.col("updated_at").alias("observed_at"),
    )


def parse_payload(df: DataFrame, col: str, schema: T.StructType, items: str) -> DataFrame:
    """One row per element of the JSON array `items`; a document or element that does not parse comes out once
    with `ok` = false, so it can be counted as ignored."""
    parsed = df.withColumn("__doc", F.from_json(col, schema, {"mode": "PERMISSIVE"}))
    rows = parsed.select(
        *[c for c in df.columns if c != col],
        *[F.col(f"__doc.{f.name}").alias(f.name) for f in schema if f.name != items],
        F.posexplode_outer(f"__doc.{items}").alias("position", "item"),
    )
    return rows.withColumn("ok", F.col("item").isNotNull())
