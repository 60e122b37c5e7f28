"""The stored fact: Parquet folders by invoice month, upserted by line id.

Lines above the cursor are appended: the store is neither read nor rewritten. Other batches look their ids up in the
store's row groups that can hold them, by the files' id statistics, and rewrite the months of the lines found.

Whole fact rows are wide, mostly by article texts, so an import moves narrow rows and completes them where they are written:
a month has one file of each writing task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..session import heavy_writes, in_buckets, path_exists, remove_path
from .incremental import high_water_mark

KEY = "source_line_id"
MONTH = "invoice_month"
KEPT = ("imported_at",)


def empty_fact(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], schemas.FACT)


def read_fact(spark: SparkSession, path: str) -> DataFrame:
    """The stored fact. The schema is given, not collected from the files: columns older files lack are null, and
    opening a large store costs no scan of footers. Empty when absent."""
    if not path_exists(spark, path):
        return empty_fact(spark).withColumn(MONTH, F.lit(None).cast("string"))
    schema = T.StructType([*schemas.FACT.fields, T.StructField(MONTH, T.StringType())])
    return spark.read.schema(schema).parquet(path).where(F.col(KEY).isNotNull())  # a month all lines left holds a null


def _cursor_path(path: str) -> str:
    return f"{path.rstrip('/')}/_cursor"  # hidden from readers of the store


def cursor(spark: SparkSession, path: str) -> int:
    """Highest imported line id: from the one-row cursor file, else from the store itself.

    A cursor that lags behind (a run lost between commit and cursor) only makes the next run repeat lines; the mark
    of the unfinished run keeps them from being appended twice.
    """
    if path_exists(spark, _cursor_path(path)):
        return spark.read.parquet(_cursor_path(path)).first()[0]
    return high_water_mark(read_fact(spark, path), KEY).first()[0]


def _advance_cursor(spark: SparkSession, path: str, top: int) -> None:
    top = max(cursor(spark, path), top)
    spark.range(1).select(F.lit(top).cast("bigint").alias("high_water_mark")).coalesce(1).write.mode("overwrite").parquet(
        _cursor_path(path)
    )


def _pending_path(path: str) -> str:
    return f"{path.rstrip('/')}/_pending"  # there while an append has not moved the cursor yet


def with_month(df: DataFrame) -> DataFrame:
    return df.withColumn(MONTH, F.date_format("invoice_date", "yyyy-MM"))


def _write(df: DataFrame, path: str, append: bool = False) -> None:
    columns = [f.name for f in schemas.FACT]
    (
        with_month(df.select(*columns))
        .sortWithinPartitions(MONTH, "invoice_date")
        .write.mode("append" if append else "overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy(MONTH)
        .parquet(path)
    )


def _by_block(df: DataFrame) -> DataFrame:
    """Whole rows by (month, id block): a month is spread over several writers, so a busy month is no straggler."""
    return with_month(df).repartition(MONTH, F.floor(F.col(KEY) / 5_000_000))


def upsert_fact(
    spark: SparkSession,
    path: str,
    incoming: DataFrame,
    complete: Callable[[DataFrame, Sequence[str]], DataFrame] | None = None,
    by_key: bool = False,
) -> int:
    """Merges rows (one per line id) into the store; returns their number.

    Rows that all lie above the cursor are appended. Else only the months that hold an incoming or a replaced line are
    rewritten, months that all their lines leave among them, all in one commit. A failed or repeated run leaves a
    whole store behind.

    `incoming` may hold less than fact rows: line id, invoice date and what `complete` makes fact rows of, one of each,
    beside the columns it is told to carry. Only these narrow rows are kept as the batch and moved; the completed ones are
    written by the tasks that complete them, which have to spread a month. `by_key` says that `incoming` comes out of a
    shuffle by line id. The batch lies in buckets by line id, so to look it up in the store moves only the store's ids.
    """
    rows = with_month(incoming)
    with heavy_writes(spark), in_buckets(spark, rows if by_key else rows.repartition(KEY), "fact-batch", KEY) as batch:
        ids = batch.agg(F.count(F.lit(1)).alias("n"), F.min(KEY).alias("low"), F.max(KEY).alias("high")).first()
        if ids["n"]:
            _merge(spark, path, batch, ids["low"], ids["high"], complete)
    return ids["n"]


def _merge(spark: SparkSession, path: str, batch: DataFrame, low: int, high: int, complete: Callable | None) -> None:
    whole = complete or (lambda rows, carry: rows)
    spread = (lambda rows: rows) if complete else _by_block
    unfinished = path_exists(spark, _pending_path(path))
    if not path_exists(spark, path) or not unfinished and low > cursor(spark, path):
        spark.range(1).write.mode("overwrite").parquet(_pending_path(path))
        _write(spread(whole(batch, [])), path, append=True)
        _advance_cursor(spark, path, high)
        remove_path(spark, _pending_path(path))
        return

    stored = read_fact(spark, path)
    known = stored.where(F.col(KEY).between(low, high)).select(
        KEY, F.col(MONTH).alias("old_month"), F.struct(*KEPT).alias("kept")  # no struct: a new line
    )
    found = batch.join(known, KEY).groupBy("old_month").agg(F.count(F.lit(1)).alias("n"))
    # Calendar months: a short list whatever the number of lines.
    replaced = {r["old_month"]: r["n"] for r in found.collect()}
    arriving = {r[0] for r in batch.select(MONTH).distinct().collect()}
    counts = stored.where(F.col(MONTH).isin(*sorted({*replaced, *arriving}))).groupBy(MONTH).count()
    staying = {r[MONTH]: r["count"] - replaced.get(r[MONTH], 0) for r in counts.collect()}  # lines that the batch lacks

    columns = [f.name for f in schemas.FACT]
    new = whole(batch.join(known.drop("old_month"), KEY, "left"), ["kept"])
    merged = new.withColumns({c: F.when(F.col("kept").isNotNull(), F.col(f"kept.{c}")).otherwise(F.col(c)) for c in KEPT})
    merged = merged.select(*columns)
    partial = sorted(m for m, n in staying.items() if n)
    if partial:
        others = stored.where(F.col(MONTH).isin(*partial)).join(batch.select(KEY), KEY, "left_anti")
        merged = merged.unionByName(others.select(*columns))
    emptied = sorted(m for m, n in staying.items() if not n and m not in arriving)
    if emptied:  # the dynamic overwrite replaces only months it has a row for
        marks = spark.createDataFrame([(m,) for m in emptied], "m string")
        day = F.to_date(F.concat("m", F.lit("-01")))
        nulls = {f.name: F.lit(None).cast(f.dataType) for f in schemas.FACT if f.name != "invoice_date"}
        merged = merged.unionByName(marks.select(day.alias("invoice_date"), *[c.alias(n) for n, c in nulls.items()]))
    _write(spread(merged), path)
    _advance_cursor(spark, path, high)
    remove_path(spark, _pending_path(path))
