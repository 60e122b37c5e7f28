"""Substring search by grams: which texts hold which needles, and a stored index for single look-ups.

A text is indexed by its parts of a few fixed lengths (`SIZES`, doubling). A needle is looked up by the rarest of its own
parts of the longest of these lengths that fits it, so the part covers more than half of a short needle, and the texts
found are verified by `contains`. Rows made per text are its positions times the few sizes, whatever lengths the needles
have. Parts that very many texts share are cut into blocks and their needles repeated per block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import path_exists, shuffled, written

SIZES = (1, 2, 4, 8)
BLOCK_ROWS = 50_000
BUCKETS = 64
POSTING_ROWS = 4096


def _col(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def parts(text: Column | str, size: Column | int) -> Column:
    """Distinct parts of this length; none of a shorter text."""
    whole, n = _col(text), F.lit(size) if isinstance(size, int) else size
    last = F.length(whole) - n + 1
    starts = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(whole, i, n)))


def all_parts(text: Column | str) -> Column:
    return F.flatten(F.array(*[parts(text, size) for size in SIZES]))


def fitting_size(needle: Column | str) -> Column:
    """The longest indexed length that fits the needle."""
    out = F.lit(None).cast("int")
    for size in SIZES:
        out = F.when(F.length(_col(needle)) >= size, size).otherwise(out)
    return out


def substring_pairs(
    needles: DataFrame, texts: DataFrame, keys: Sequence[str], *, text: str = "text", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(needle, *keys): every text that holds the needle, for the distinct non-empty values of needles.needle.

    `keys` name a text; rows that repeat one are listed once each. Null texts hold nothing.
    """
    spark = texts.sparkSession
    wanted = needles.select("needle").where("needle <> ''").distinct()
    asked = wanted.select("needle", F.explode(parts("needle", fitting_size("needle"))).alias("part"))
    asked = written(spark, asked, "gram-needles")
    known = asked.select("part").distinct()
    postings = texts.select(*keys, F.col(text).alias("__text"), F.explode(all_parts(text)).alias("part"))
    postings = written(spark, postings.join(shuffled(known), "part", "left_semi"), "gram-postings")

    frequency = postings.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    rarest = asked.join(shuffled(frequency), "part", "left").groupBy("needle").agg(
        F.min(F.struct("n", "part")).alias("key"), F.bool_and(F.col("n").isNotNull()).alias("found")
    )
    blocks = F.ceil(F.col("n") / block_rows).cast("int")
    keyed = rarest.where("found").select("needle", "key.part", "key.n").select(
        "needle", "part", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block")
    )
    crowded = frequency.where(F.col("n") > block_rows).select("part", blocks.alias("__blocks"))
    spread = postings.join(crowded, "part", "left").withColumn(
        "block", F.coalesce(F.pmod(F.xxhash64(*keys), F.col("__blocks")).cast("int"), F.lit(0))
    )
    hits = keyed.join(shuffled(spread), ["part", "block"])
    return hits.where(F.contains(F.col("__text"), F.col("needle"))).select("needle", *keys)


# --- stored index -------------------------------------------------------------------------------------


def write_index(texts: DataFrame, key: str, columns: Sequence[str], path: str, *, block_rows: int = POSTING_ROWS) -> None:
    """Stores which rows hold which parts of their columns' lower-case forms; a missing path is made, an older index
    replaced. Rows are dealt into blocks by key, and a part is stored once per block with the keys that hold it, so what
    moves and is written grows with the distinct parts of a block, not with every part of every row. Rows are laid out by
    bucket and part, so a look-up reads a few row groups of one folder."""
    lowered = [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    found = F.array_distinct(F.flatten(F.array(*map(all_parts, lowered))))
    # rows of null keys share a block, like those of any one key, and their set of keys is empty
    blocks = max(1, -(-texts.count() // block_rows))
    block = F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("block")
    rows = texts.select(F.col(key).alias("key"), *columns).select("*", block).repartition("block")
    postings = rows.select("block", "key", F.explode(found).alias("part"))
    postings = postings.groupBy("block", "part").agg(F.collect_set("key").alias("keys"))
    bucket = F.pmod(F.xxhash64("part"), F.lit(BUCKETS)).cast("int")
    laid_out = postings.select("part", "keys", bucket.alias("bucket")).repartition(BUCKETS, "bucket")
    laid_out.sortWithinPartitions("bucket", "part").write.partitionBy("bucket").mode("overwrite").parquet(path)


def rows_with_part(spark: SparkSession, path: str, part: str, key_type: str = "bigint") -> DataFrame:
    """(key) of the rows that hold the part, a string of one of the indexed lengths."""
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    postings = spark.read.schema(f"part string, keys array<{key_type}>, bucket int").parquet(path)
    bucket = spark.range(1).select(F.pmod(F.xxhash64(F.lit(part)), F.lit(BUCKETS)).cast("int")).first()[0]
    found = postings.where((F.col("bucket") == bucket) & (F.col("part") == part))
    return found.select(F.explode("keys").alias("key"))


def rows_with_parts(spark: SparkSession, path: str, needle: str, key_type: str = "bigint") -> DataFrame | None:
    """(key) of the rows that may hold the needle: those with all of its parts at a stride of their length.

    None if the needle is empty: the index knows no row that has not.
    """
    sizes = [s for s in SIZES if s <= len(needle)]
    if not sizes:
        return None
    size = sizes[-1]
    starts = sorted({*range(0, len(needle) - size + 1, size), len(needle) - size})
    found = None
    for start in starts:
        rows = rows_with_part(spark, path, needle[start : start + size], key_type)
        found = rows if found is None else found.join(rows, "key", "left_semi")
    return found
