"""Merkle manifest of a dataset: one tree a group, a tree over the groups' roots, and a proof for every row.

A row's leaf is the sha256 of its columns, each `-` if null, else its UTF-8 byte count, `:` and its value. Within a
group the leaves stand in the order of their ids; while several nodes remain, every eight consecutive ones become the
sha256 of their hex digests one after the other. The groups' roots, by group (null first, bytewise), likewise give the
root of the dataset.

Trees are stored in blocks: aligned subtrees of `height` levels, 8 ** height leaves each, that one task builds. Inside a
block the nodes lie in van Emde Boas order: the tree is cut at half its height, the upper part comes first, the lower
subtrees follow one after the other, and each of these parts is laid out alike. `slots` works a node's place out by that
rule alone, with no pointers and whatever the cache or page size; building a block and looking up siblings both use it.
Block roots are the leaves of the next round of blocks, until one block holds what is left, so the rounds number
log(rows) to the base 8 ** height, and a block never depends on the size of its group: a hot group is only more blocks.

Proofs go down again: every block gets the siblings on the way from its own root to the dataset's, adds those inside the
block, and hands them to the blocks below; at the lowest round the rows of a block meet its nodes in one task. Places
within a group come from a range partitioning by (group, id) with counts per partition, never from one sorted task, and
only digests and ids are shuffled, no texts. All tables are written to the shared folder, so a lost executor costs tasks.

Defined cases: a null id comes first in its group; rows with equal ids stand in the order of their leaves, and rows that
repeat in all columns have equal leaves, each with its own place; a null group is a group; empty and long texts are
hashed whole; an empty table has no rows and the root of no leaves, null; helper columns are named apart from the
table's; of the table's columns only the id, the group and those named in `keep` are carried.
"""

from __future__ import annotations

import binascii
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import remove_path, work_path, written

FANOUT = 8
HEIGHT = 4
_HEX = "S64"
_SLICE = 256
_PATH = "array<struct<before:string,after:string>>"
_BLOCKS = "tree string, block long, n int, levels int, nodes binary, root string"
_TOP = "top"


# --- leaves -----------------------------------------------------------------------------------------------------------


def counted(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, `:` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(counted, values)), 256)


# --- van Emde Boas layout ---------------------------------------------------------------------------------------------


def tree_size(levels: int) -> int:
    """Nodes of a complete tree with so many levels of nodes."""
    return (FANOUT**levels - 1) // (FANOUT - 1)


def slots(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places of the nodes `index` of row `depth` (0 is the root) in a complete tree of `levels` rows."""
    if levels == 1:
        return np.zeros_like(index)
    upper = levels // 2
    if depth < upper:
        return slots(upper, depth, index)
    lower = levels - upper
    subtree, inside = np.divmod(index, FANOUT ** (depth - upper))
    return tree_size(upper) + subtree * tree_size(lower) + slots(lower, depth - upper, inside)


def levels_of(n: int) -> int:
    """Rows of nodes until one remains."""
    levels = 1
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def _row(store: np.ndarray, levels: int, n: int, up: int) -> list[bytes]:
    """The nodes `up` rows above the n leaves, in order."""
    count = -(-n // FANOUT**up)
    return store[slots(levels, levels - 1 - up, np.arange(count))].tolist()


def _digest(nodes: Sequence[bytes]) -> bytes:
    return sha256(b"".join(nodes)).hexdigest().encode()


def laid_out(leaves: Sequence[bytes], levels: int) -> np.ndarray:
    """Hex digests of all nodes over the leaves; places without a node hold zeros."""
    store = np.full(tree_size(levels), b"0" * 64, _HEX)
    n = len(leaves)
    store[slots(levels, levels - 1, np.arange(n))] = leaves
    for up in range(1, levels):
        below = _row(store, levels, n, up - 1)
        nodes = [_digest(below[i : i + FANOUT]) for i in range(0, len(below), FANOUT)]
        store[slots(levels, levels - 1 - up, np.arange(len(nodes)))] = nodes
    return store


def _sides(store: np.ndarray, levels: int, n: int, up: int) -> list[tuple[bytes, bytes]]:
    """Of every node of a row, the siblings before and after it."""
    row = _row(store, levels, n, up)
    out = []
    for start in range(0, len(row), FANOUT):
        run = row[start : start + FANOUT]
        out += [(b"".join(run[:i]), b"".join(run[i + 1 :])) for i in range(len(run))]
    return out


def _all_sides(nodes: bytes, levels: int, n: int) -> list[list[tuple[bytes, bytes]]]:
    store = np.frombuffer(binascii.hexlify(nodes), _HEX)
    return [_sides(store, levels, n, up) for up in range(levels - 1)]


# --- building ---------------------------------------------------------------------------------------------------------


def _placed(rows: DataFrame, tree: str, order: Sequence[str]) -> DataFrame:
    """Adds `place`, the row's number within its tree in this order, by a range partitioning and counts."""
    spark = rows.sparkSession
    sorted_rows = rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order)
    numbered = written(spark, sorted_rows.withColumn("__number", F.monotonically_increasing_id()), "merkle-order")
    part = F.shiftright("__number", 33)
    counts = numbered.groupBy(tree, part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"), F.min("__number").alias("__first"))
    before = Window.partitionBy(tree).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(tree, "__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"))
    placed = numbered.withColumn("__part", part).join(starts, [tree, "__part"])
    return placed.withColumn("place", F.col("__number") + F.col("__shift")).drop("__number", "__shift", "__part")


def _built(nodes: DataFrame, height: int) -> list[DataFrame]:
    """Blocks of the trees over nodes (tree, place, digest), round by round, lowest first."""
    spark, width = nodes.sparkSession, FANOUT**height
    schema = to_arrow_schema(T.StructType.fromDDL(_BLOCKS))

    def build(key: tuple, table: pa.Table) -> pa.Table:
        places, digests = table["place"].to_numpy(), table["digest"].to_pylist()
        leaves = [digests[i].encode() for i in np.argsort(places)]
        n, block = len(leaves), key[1].as_py()
        # a block that is not full and not its tree's only one is carried up to the full height
        levels = height + 1 if block else levels_of(n)
        store = laid_out(leaves, levels)
        root = store[0].decode()
        return pa.Table.from_pylist(
            [{"tree": key[0].as_py(), "block": block, "n": n, "levels": levels, "nodes": binascii.unhexlify(store.tobytes()), "root": root}],
            schema,
        )

    rounds = []
    while True:
        dealt = nodes.select("tree", F.floor(F.col("place") / width).alias("block"), "place", "digest")
        blocks = written(spark, dealt.groupBy("tree", "block").applyInArrow(build, _BLOCKS), "merkle-blocks")
        rounds.append(blocks)
        # a full block may have others beside it; a lone one only becomes the single node of the next round
        nodes = blocks.where((F.col("block") > 0) | (F.col("n") == width)).select(
            "tree", F.col("block").alias("place"), F.col("root").alias("digest")
        )
        if nodes.isEmpty():
            return rounds


def _roots(rounds: Sequence[DataFrame], height: int) -> DataFrame:
    """(tree, root) of the trees' last blocks."""
    last = [b.where((F.col("block") == 0) & (F.col("n") < FANOUT**height)).select("tree", "root") for b in rounds]
    out = last[0]
    for more in last[1:]:
        out = out.union(more)
    return out


@dataclass(frozen=True)
class Manifest:
    """leaves: (id, group, kept columns, leaf, tree, place); rounds and top: blocks of the groups' trees and of the tree
    over them; subroots: (tree, group, place, subroot); root: of the dataset, null without rows."""

    leaves: DataFrame
    rounds: tuple[DataFrame, ...]
    top: tuple[DataFrame, ...]
    subroots: DataFrame
    root: str | None
    height: int


def build_manifest(
    rows: DataFrame,
    columns: Sequence[str],
    *,
    id_column: str = "doc_id",
    group: str = "lang",
    keep: Sequence[str] = (),
    height: int = HEIGHT,
) -> Manifest:
    """Trees over the leaves of `columns`; columns named in `keep` stand beside the leaves."""
    if taken := {c.lower() for c in keep} & {"id", "group", "leaf", "tree", "place"}:
        raise ValueError(f"kept columns need other names than {sorted(taken)}")
    spark: SparkSession = rows.sparkSession
    narrow = rows.select(
        F.col(id_column).alias("id"),
        F.col(group).alias("group"),
        *[F.col(c).alias(c) for c in keep],
        leaf_digest([F.col(c) for c in columns]).alias("leaf"),
        counted(F.col(group)).alias("tree"),
    )
    path = work_path(spark, "merkle-leaves")
    narrow.write.parquet(path)
    leaves = _placed(spark.read.schema(narrow.schema).parquet(path), "tree", ["id", "leaf"])
    remove_path(spark, path)
    rounds = _built(leaves.select("tree", "place", F.col("leaf").alias("digest")), height)

    groups = leaves.where("place = 0").select("tree", "group").join(_roots(rounds, height), "tree")
    ordered = _placed(groups.withColumn("__top", F.lit(_TOP)), "__top", ["group"]).drop("__top")
    subroots = written(spark, ordered.withColumnRenamed("root", "subroot"), "merkle-subroots")
    top = _built(subroots.select(F.lit(_TOP).alias("tree"), "place", F.col("subroot").alias("digest")), height)
    root = _roots(top, height).first()
    return Manifest(leaves, tuple(rounds), tuple(top), subroots, root["root"] if root else None, height)


# --- proofs -----------------------------------------------------------------------------------------------------------


def _handed_down(blocks: DataFrame, width: int) -> DataFrame:
    """(tree, place, path) of all nodes at the foot of blocks that have their own path."""
    schema = T.StructType.fromDDL(f"tree string, place long, path {_PATH}")
    arrow = to_arrow_schema(schema)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sides = _all_sides(row["nodes"], row["levels"], row["n"])
                out = []
                for i in range(row["n"]):
                    own = [sides[up][i // FANOUT**up] for up in range(len(sides))]
                    steps = [{"before": b.decode(), "after": a.decode()} for b, a in own]
                    out.append({"tree": row["tree"], "place": row["block"] * width + i, "path": steps + row["path"]})
                    if len(out) == _SLICE or i + 1 == row["n"]:
                        yield pa.RecordBatch.from_pylist(out, arrow)
                        out = []

    return blocks.select("tree", "block", "n", "levels", "nodes", "path").mapInArrow(expand, schema)


def _with_paths(rounds: Sequence[DataFrame], top_paths: DataFrame, height: int) -> DataFrame:
    """Blocks of the lowest round with `path`: the siblings from the block's root to the dataset's root.

    `top_paths` (tree, path): from the trees' roots on.
    """
    spark, width, paths = rounds[0].sparkSession, FANOUT**height, None
    for number in reversed(range(len(rounds))):
        blocks = rounds[number]
        last = (F.col("block") == 0) & (F.col("n") < width)
        ready = blocks.where(last).join(top_paths, "tree")
        if paths is not None:
            below = paths.withColumnRenamed("place", "block")
            ready = ready.unionByName(blocks.where(~last).join(below, ["tree", "block"]))
        ready = written(spark, ready, "merkle-paths")
        if number:
            paths = _handed_down(ready, width)
    return ready


def prove(manifest: Manifest, claimed: str = "leaf", *, keep_path: bool = False) -> DataFrame:
    """Every leaf with the proof from the stored nodes: `subroot`, `root`, `proof_sha256` of the siblings' digests from
    the leaf up, left to right, `folded_root` worked out from the leaf in column `claimed` and the siblings, `verified`
    where that is the root; with `keep_path` also `path`, the siblings before and after it level by level."""
    width = FANOUT**manifest.height
    no_path = F.array().cast(_PATH)
    tops = manifest.top[-1].select("tree").distinct().withColumn("path", no_path)
    top_blocks = _with_paths(manifest.top, tops, manifest.height)
    group_paths = _handed_down(top_blocks, width).select("place", "path")
    top_paths = manifest.subroots.join(group_paths, "place").select("tree", "path")
    blocks = _with_paths(manifest.rounds, top_paths, manifest.height).join(manifest.subroots.select("tree", "subroot"), "tree")
    blocks = blocks.select("tree", "block", "n", "levels", "nodes", "path", "subroot")

    leaves = manifest.leaves.withColumn("block", F.floor(F.col("place") / width))
    extra = f", path {_PATH}" if keep_path else ""
    found = T.StructType.fromDDL(f"subroot string, proof_sha256 string, folded_root string{extra}")
    schema = T.StructType([*leaves.schema.fields, *found.fields])
    arrow, kinds = to_arrow_schema(schema), to_arrow_schema(found)

    def check(mine: pa.Table, block: pa.Table) -> pa.Table:
        if not mine.num_rows:
            return arrow.empty_table()
        row = block.to_pylist()[0]
        sides = _all_sides(row["nodes"], row["levels"], row["n"])
        outer = [(s["before"].encode(), s["after"].encode()) for s in row["path"]]
        # what all leaves under a node of the first row share
        upper = []
        for i in range(len(sides[1]) if len(sides) > 1 else 1):
            upper.append([sides[up][i // FANOUT ** (up - 1)] for up in range(1, len(sides))] + outer)
        joined = [b"".join(b + a for b, a in steps) for steps in upper]
        out: list[dict] = []
        for place, digest in zip(mine["place"].to_pylist(), mine[claimed].to_pylist(), strict=True):
            i = place % width
            own = [sides[0][i]] if sides else []
            folded = digest.encode()
            for before, after in own + upper[i // FANOUT if sides else 0]:
                folded = _digest((before, folded, after))
            proof = _digest((*(x for pair in own for x in pair), joined[i // FANOUT if sides else 0]))
            cells = {"subroot": row["subroot"], "proof_sha256": proof.decode(), "folded_root": folded.decode()}
            if keep_path:
                steps = own + upper[i // FANOUT if sides else 0]
                cells["path"] = [{"before": b.decode(), "after": a.decode()} for b, a in steps]
            out.append(cells)
        more = pa.Table.from_pylist(out, kinds)
        return pa.Table.from_arrays([*mine.columns, *more.columns], schema=arrow)

    proofs = leaves.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInArrow(check, schema)
    root = F.lit(manifest.root).cast("string")
    return proofs.withColumns({"root": root, "verified": F.col("folded_root") == root}).drop("tree", "block", "place")
