"""Near-identical 64-bit hashes in a whole table, by multi-index hashing.

A hash is cut into `limit` + 2 bands. Two hashes that differ in `limit` bits at most have at least two bands in common, so
every hash is filed under each pair of its bands and only hashes of one file are compared, exactly, by the bits in which
they differ. Equal hashes are one row with a count, so a hash that very many images share costs no more than any other.

A file that still holds more than `crowded` hashes (images with the same blank parts) is cut again: the bits outside its
two bands are cut into `limit` + 2 bands in turn, by the same reasoning. What is crowded even then is compared in blocks,
each block with each, spread over tasks: exact at any size. A pair is listed by the first file it has in common alone.
"""

from __future__ import annotations

import json
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

CROWDED = 2_000
BLOCK = 1_000
_ALL_BITS = tuple(range(64))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def band_masks(bits: tuple[int, ...], bands: int) -> list[int]:
    """The bits dealt into so many runs, as masks."""
    edges = [len(bits) * i // bands for i in range(bands + 1)]
    return [sum(1 << b for b in bits[low:high]) for low, high in zip(edges, edges[1:], strict=False)]


def _files(masks: list[int]) -> list[tuple[int, list[int]]]:
    """Per pair of bands its mask, and the masks of bands that would make an earlier pair if they agreed too."""
    pairs = list(combinations(range(len(masks)), 2))
    return [(masks[i] | masks[j], [masks[k] for k in range(j) if k != i]) for i, j in pairs]


def _filed(rows: DataFrame, masks: Column, number: str, key: str) -> DataFrame:
    filed = rows.select("*", F.posexplode(masks).alias(number, "__mask"))
    return filed.withColumn(key, F.col("hash").bitwiseAND(F.col("__mask"))).drop("__mask")


def _constant(value: list, kind: str) -> Column:
    """A nested array as one literal, which Spark turns into a constant: plans stay small."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _masks(files: list[tuple[int, list[int]]]) -> list[int]:
    return [_signed(mask) for mask, _ in files]


def _earlier(files: list[tuple[int, list[int]]]) -> list[list[int]]:
    return [[_signed(m) for m in before] for _, before in files]


def _none_agrees(masks: Column) -> Column:
    return F.forall(masks, lambda m: F.col("differing").bitwiseAND(m) != 0)


def _pairs(filed: DataFrame, keys: list[str], limit: int) -> DataFrame:
    a = filed.select(*keys, F.col("hash").alias("hash_a"), F.col("n").alias("n_a"))
    b = filed.select(*keys, F.col("hash").alias("hash_b"), F.col("n").alias("n_b"))
    differing = F.col("hash_a").bitwiseXOR(F.col("hash_b"))
    near = (F.col("hash_a") < F.col("hash_b")) & (F.bit_count(differing) <= limit)
    return a.join(b, keys).where(near).withColumn("differing", differing)


def _in_blocks(filed: DataFrame, sizes: DataFrame, keys: list[str], block: int) -> DataFrame:
    """The rows of crowded files in blocks, each filed under every pair of blocks that it belongs to."""
    blocks = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("hash"), F.col("blocks")).cast("int")
    rows = filed.join(sizes.select(*keys, blocks.alias("blocks")), keys).withColumn("own", own)
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.select("*", others.alias("other"))
    return rows.withColumns({"first": F.least("own", "other"), "second": F.greatest("own", "other")})


def near_hashes(hashes: DataFrame, limit: int, *, crowded: int = CROWDED, block: int = BLOCK) -> DataFrame:
    """(hash_a, hash_b, n_a, n_b, distance) of all pairs of different hashes within `limit` bits, hash_a < hash_b, with
    the images that show each, and a row at distance 0 for every hash of two images or more.

    `hashes` is (id, hash); null hashes belong to no image.
    """
    if not 0 <= limit <= 30:
        raise ValueError("limit must be between 0 and 30 bits")
    spark = hashes.sparkSession
    distinct = hashes.where("hash is not null").groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    distinct = written(spark, distinct, "hash-rows")

    files = _files(band_masks(_ALL_BITS, limit + 2))
    filed = _filed(distinct, _constant(_masks(files), "array<bigint>"), "file", "key")
    sizes = filed.groupBy("file", "key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > crowded)
    sizes = written(spark, sizes, "hash-crowds")
    even = filed.join(sizes, ["file", "key"], "left_anti")
    # no band agrees that would put the pair into an earlier file
    first = _none_agrees(F.element_at(_constant(_earlier(files), "array<array<bigint>>"), F.col("file") + 1))
    found = _pairs(even, ["file", "key"], limit).where(first)

    if not sizes.isEmpty():
        # the bits outside each file's bands, cut again
        inner = [_files(band_masks(tuple(b for b in _ALL_BITS if not mask >> b & 1), limit + 2)) for mask, _ in files]
        masks = F.element_at(_constant([_masks(f) for f in inner], "array<array<bigint>>"), F.col("file") + 1)
        rows = filed.join(sizes.select("file", "key"), ["file", "key"])
        keys = ["file", "key", "inner", "inner_key"]
        refiled = written(spark, _filed(rows, masks, "inner", "inner_key"), "hash-refiled")
        inner_sizes = refiled.groupBy(*keys).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > crowded)
        inner_sizes = written(spark, inner_sizes, "hash-inner-crowds")
        small = _pairs(refiled.join(inner_sizes, keys, "left_anti"), keys, limit)
        cells = _in_blocks(refiled, inner_sizes, keys, block)
        sides = [*keys, "first", "second"]
        # a pair within one block meets once for each of the blocks it is filed with; its own cell alone counts
        a, b = (cells.select(*sides, F.col("hash").alias(f"hash_{x}"), F.col("n").alias(f"n_{x}"), F.col("own").alias(f"own_{x}")) for x in "ab")
        differing = F.col("hash_a").bitwiseXOR(F.col("hash_b"))
        own_cell = (F.least("own_a", "own_b") == F.col("first")) & (F.greatest("own_a", "own_b") == F.col("second"))
        near = (F.col("hash_a") < F.col("hash_b")) & own_cell & (F.bit_count(differing) <= limit)
        large = a.join(b, sides).where(near).withColumn("differing", differing).drop("first", "second", "own_a", "own_b")
        both = small.select(*large.columns).unionByName(large)
        before = F.element_at(_constant([_earlier(f) for f in inner], "array<array<array<bigint>>>"), F.col("file") + 1)
        in_file = _none_agrees(F.element_at(before, F.col("inner") + 1))
        found = found.select("hash_a", "hash_b", "n_a", "n_b", "differing").unionByName(
            both.where(first).where(in_file).select("hash_a", "hash_b", "n_a", "n_b", "differing")
        )
    found = found.select("hash_a", "hash_b", "n_a", "n_b", F.bit_count("differing").alias("distance"))
    alone = distinct.where("n > 1").select(
        F.col("hash").alias("hash_a"), F.col("hash").alias("hash_b"), F.col("n").alias("n_a"), F.col("n").alias("n_b"), F.lit(0).alias("distance")
    )
    return found.unionByName(alone)
