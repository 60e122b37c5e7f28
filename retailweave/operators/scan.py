"""Ordered scans over keyed event logs that survive hot keys.

A window over one key runs in one task. Here a key's rows are cut into chunks of the arrival number, so no window
sees more than `chunk_rows` rows; what a chunk hands on to the next ones is worked out on one summary row per
(key, chunk) and joined back. `seq` is the arrival number: unique and growing within the log.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 200_000


def _chunked(df: DataFrame, seq: str, chunk_rows: int) -> DataFrame:
    return df.withColumn("__chunk", F.floor(F.col(seq) / chunk_rows))


def previous_values(
    df: DataFrame, keys: Sequence[str], seq: str, values: Mapping[str, Column], chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Adds, per entry of `values`, its last non-null value on an earlier row of the same key."""
    by = [*keys, "__chunk"]
    rows = _chunked(df, seq, chunk_rows).withColumns({f"__v_{n}": v for n, v in values.items()})
    earlier = Window.partitionBy(*by).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumns({f"__l_{n}": F.last(f"__v_{n}", ignorenulls=True).over(earlier) for n in values})

    before = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = rows.groupBy(*by).agg(
        *[F.max_by(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), F.col(seq))).alias(f"__e_{n}") for n in values]
    )
    carried = chunks.select(
        *by, *[F.last(f"__e_{n}", ignorenulls=True).over(before).alias(f"__c_{n}") for n in values]
    )
    out = local.join(carried, by, "left").withColumns({n: F.coalesce(f"__l_{n}", f"__c_{n}") for n in values})
    return out.drop("__chunk", *[f"__{p}_{n}" for n in values for p in ("v", "l", "c")])


def run_length(
    df: DataFrame,
    keys: Sequence[str],
    seq: str,
    hit: Column,
    start: Column,
    name: str,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Adds `name`: how many hits in a row end at each row (0 on a miss); `start` hits precede a key's first row."""
    by = [*keys, "__chunk"]
    rows = _chunked(df, seq, chunk_rows).withColumns({"__hit": hit.cast("int"), "__start": start})
    upto = Window.partitionBy(*by).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("__sum", F.sum("__hit").over(upto))
    local = local.withColumn("__reset", F.max(F.when(F.col("__hit") == 0, F.col("__sum"))).over(upto))

    before = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = local.groupBy(*by).agg(F.max("__sum").alias("__total"), F.max("__reset").alias("__last"))
    chunks = chunks.withColumn("__base", F.coalesce(F.sum("__total").over(before), F.lit(0)))
    chunks = chunks.withColumn("__since", F.max(F.col("__base") + F.col("__last")).over(before))
    carried = chunks.select(*by, "__base", "__since")

    inside = F.col("__sum") - F.col("__reset")
    across = F.col("__sum") + F.col("__base") - F.coalesce("__since", -F.col("__start"))
    run = F.when(F.col("__hit") == 0, 0).when(F.col("__reset").isNotNull(), inside).otherwise(across)
    out = local.join(carried, by, "left").withColumn(name, run.cast("int"))
    return out.drop("__chunk", "__hit", "__start", "__sum", "__reset", "__base", "__since")
