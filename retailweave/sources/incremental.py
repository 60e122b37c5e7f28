"""Cursor scans, high-water marks and keyed upserts on line tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key in `order`. The rank filter also runs before the shuffle, so a hot key sends one row
    per map task and never gathers in one place."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") == 1).drop("__rank")


def top_k_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First k rows per key, with their rank."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def scan_after(df: DataFrame, key: str, after_id: int | Column, limit: int | None = None) -> DataFrame:
    """Rows above the cursor in ascending key order. With a limit this is a distributed top-n."""
    rows = df.where(F.col(key) > after_id)
    return rows if limit is None else rows.orderBy(key).limit(limit)


def high_water_mark(df: DataFrame, key: str = "source_line_id") -> DataFrame:
    return df.agg(F.coalesce(F.max(key), F.lit(0)).cast("bigint").alias("high_water_mark"))


def parse_since(text: str | None) -> dt.date | None:
    """Empty means no backfill; anything that is not a real YYYY-MM-DD day is an error."""
    if not text:
        return None
    try:
        return dt.datetime.strptime(text, "%Y-%m-%d").date()
    except ValueError as exc:
        raise ValueError("since date must be YYYY-MM-DD") from exc


def line_date(stamp: str = "DH_Facture", day: str = "DateFacture") -> Column:
    """Date of a raw line; the zero date counts as missing."""
    return F.coalesce(F.to_date(F.try_to_timestamp(F.col(stamp))), F.to_date(F.try_to_timestamp(F.col(day))))


def scan_since(df: DataFrame, since: dt.date, date_col: Column | None = None) -> DataFrame:
    return df.where((date_col if date_col is not None else line_date()) >= F.lit(since))


def ensure_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds the missing columns as nulls of the given type."""
    missing = {n: F.lit(None).cast(t) for n, t in columns.items() if n not in df.columns}
    return df.withColumns(missing) if missing else df


def upsert(
    target: DataFrame, incoming: DataFrame, keys: Sequence[str], keep_from_target: Sequence[str] = ()
) -> DataFrame:
    """Insert new keys, overwrite known ones except the `keep_from_target` columns.

    `incoming` has one row per key (see `latest_per_key`). One full outer join on the key: both sides are
    unique on it, so no key is hot.
    """
    columns = list(target.columns)
    new = ensure_columns(incoming, {f.name: f.dataType.simpleString() for f in target.schema}).select(
        F.struct(*columns).alias("n"), *[F.col(k).alias(f"__n_{k}") for k in keys]
    )
    old = target.select(F.struct(*columns).alias("o"), *[F.col(k).alias(f"__o_{k}") for k in keys])
    joined = old.join(new, [F.col(f"__o_{k}") == F.col(f"__n_{k}") for k in keys], "full_outer")
    has_new, has_old = F.col(f"__n_{keys[0]}").isNotNull(), F.col(f"__o_{keys[0]}").isNotNull()
    return joined.select(
        *[
            (
                F.when(has_old, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
                if c in keep_from_target
                else F.when(has_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
            ).alias(c)
            for c in columns
        ]
    )
