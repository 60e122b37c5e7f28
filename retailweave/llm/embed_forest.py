"""Embedding near-dedup with a forest of random-projection trees.

A tree splits its points at the median of their projections on a random direction. Points near the median go to both
sides: how near is read off the node. A pair at the threshold's angle lies a normal gap of known width apart on any
direction, so from a sample of the node's projections follows the share of such pairs that a spill would part, and the
least of `SPILLS` is taken that keeps `KEPT_PER_LEVEL` of them. Dense nodes, whose projections lie close together, so get
more spill than loose ones. Splitting goes on, in rounds of `ROUND_DEPTH` levels, until every leaf has `LEAF` points at
most or is dense: no spill keeps enough, as the node is not wider than the pairs it must not part. Points are compared
within leaves, by cosine in double precision; leaves beyond `BLOCK` points are cut into blocks, each compared with each.

How many trees it takes depends on the depth that the vectors lead to, so the miss is measured. For `PROBES` of the points
a partner at the threshold's angle is made up and sent down beside the points. Trees are added, `BATCH` at a time, until
in each eighth of the first tree's space the share of partners that never shared a leaf with their point is `MISS` or
less. A batch's tables are removed when its pairs are written.

Groups of copies are not expanded. Equal vectors are one point from the start. Points are then gathered into balls by a
few passes over unspilled trees: all members lie within a third of the threshold's angle of the ball's centre, so by the
triangle inequality all of them are linked to each other, and balls whose centres are as close as that are linked as a
whole. The forest holds the balls' centres. Two balls whose angle and radii leave no doubt are linked as a whole, or not
at all; only balls on the edge have their members compared.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite components, link with nothing; vectors of
different lengths never link; a null id is an id after all others, so a component has it only if it has no other, and then
component_id is null; rows that repeat an id are vectors of their own; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remove_path, work_path
from .graph import connected_components

SIMILARITY = 0.9
LEAF = 512
SPILLS = (0.0, 0.02, 0.05, 0.08, 0.12, 0.16, 0.2, 0.25)
SAMPLE = 1024
ROUND_DEPTH = 6
MISS = 0.01
KEPT_PER_LEVEL = 0.92
PROBES = 2048
BATCH = 4
BLOCK = 1024
LAST_ID = 2**63 - 1
_EPS = 1e-9
_ASSIGNED = "tree int, leaf string, node binary, v array<double>, radius double"


class _Tables:
    """Tables in the shared folder that are removed together."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, label: str) -> DataFrame:
        path = work_path(self.spark, label)
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self) -> None:
        while self.paths:
            remove_path(self.spark, self.paths.pop())


def _valid(vector: Column) -> Column:
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    )
    some = F.exists(vector, lambda x: x != 0)
    return F.coalesce(vector.isNotNull() & finite & some, F.lit(False))


def _bound(value: Column, body) -> Column:
    """`body` of the value, which is worked out once however often the body looks at it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _unit(vector: Column) -> Column:
    """Scaled to its largest component first, so squares neither overflow nor vanish."""
    largest = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))
    scaled = _bound(largest, lambda m: F.transform(vector, lambda x: x.cast("double") / m))

    def divided(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
        return _bound(norm, lambda n: F.transform(v, lambda x: x / n))

    return _bound(scaled, divided)


# --- trees -----------------------------------------------------------------------------------------------------------


def _directions(tree: int, leaf: str, seed: int, width: int) -> np.ndarray:
    """Directions of the inner nodes below a leaf, the same wherever they are drawn."""
    state = xxhash.xxh64_intdigest(f"{seed}/{tree}/{leaf}/{width}")
    return np.random.Generator(np.random.PCG64(state)).standard_normal(((1 << ROUND_DEPTH) - 1, width))


def _rows(column: pa.Array) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _normal_above(x: np.ndarray) -> np.ndarray:
    """Share of a standard normal beyond x."""
    return 0.5 * np.vectorize(math.erfc, otypes=[float])(x / math.sqrt(2))


def _limits(p: np.ndarray, gap: float) -> tuple[float, float] | None:
    """Where a node with these projections is split: the least spill that keeps enough pairs of this gap."""
    for spill in SPILLS:
        low, high = np.quantile(p, (0.5 - spill, 0.5 + spill))
        # a pair is parted if one point lies below the spill and the other beyond it
        parted = _normal_above((high - p[p < low]) / gap).sum() + _normal_above((p[p > high] - low) / gap).sum()
        if parted <= (1 - KEPT_PER_LEVEL) * len(p):
            return low, high
    return None


def _fit(frame: pd.DataFrame, seed: int, gap: float | None, leaf_size: int) -> pd.DataFrame:
    """Lower and upper limits of a round's inner nodes, from a node's sample; none if the node is dense.

    An inner node that is small enough already is passed on whole, and so is a dense one, for the next round to find.
    """
    tree, leaf, points = int(frame["tree"].iloc[0]), frame["leaf"].iloc[0], int(frame["points"].iloc[0])
    x = np.stack(frame.sort_values("node")["v"].to_numpy())
    projected = x @ _directions(tree, leaf, seed, x.shape[1]).T
    inner = projected.shape[1]
    low, high = np.zeros(inner), np.zeros(inner)
    members = {0: np.arange(len(x))}
    for node in range(inner):
        own = members.get(node, np.array([], int))
        p = projected[own, node]
        if node and points * len(p) <= leaf_size * len(x):
            low[node] = high[node] = -np.inf
        elif len(p):
            found = (np.median(p),) * 2 if gap is None else _limits(p, gap)
            if found is None and node == 0:
                return pd.DataFrame({"tree": [tree], "leaf": [leaf], "low": [[]], "high": [[]]})
            # below all points: nothing goes to the lower child
            low[node], high[node] = (-np.inf, -np.inf) if found is None else found
        members[2 * node + 1], members[2 * node + 2] = own[p <= high[node]], own[p > low[node]]
    return pd.DataFrame({"tree": [tree], "leaf": [leaf], "low": [low.tolist()], "high": [high.tolist()]})


def _send_down(seed: int):
    """Points of crowded leaves to the leaves of the next round."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees, leaves = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            places: dict[tuple[int, str], list[int]] = {}
            for i, key in enumerate(zip(trees, leaves, strict=True)):
                places.setdefault(key, []).append(i)
            taken, to_tree, to_leaf = [], [], []
            every = _rows(batch.column(3)) if len({len(v) for v in batch.column(3)}) == 1 else None
            for (tree, leaf), own in places.items():
                x = every[own] if every is not None else _rows(batch.column(3).take(pa.array(own)))
                low, high = (np.array(batch.column(c)[own[0]].as_py()) for c in (5, 6))
                projected = x @ _directions(tree, leaf, seed, x.shape[1]).T
                members = {0: np.arange(len(x))}
                for node in range(len(low)):
                    mine = members.pop(node)
                    p = projected[mine, node]
                    members[2 * node + 1], members[2 * node + 2] = mine[p <= high[node]], mine[p > low[node]]
                for node, mine in members.items():
                    if len(mine):
                        taken.append(np.array(own)[mine])
                        to_tree += [tree] * len(mine)
                        to_leaf += [f"{leaf}{chr(48 + node - len(low))}"] * len(mine)
            if taken:
                out = batch.take(pa.array(np.concatenate(taken))).select(["node", "v", "radius"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to_tree, pa.int32()), pa.array(to_leaf, pa.string()), *out.columns],
                    names=["tree", "leaf", "node", "v", "radius"],
                )

    return send


def _forest(
    points: DataFrame, trees: range, gap: float | None, seed: int, leaf_size: int, tables: _Tables
) -> DataFrame:
    """(tree, leaf, node, v, radius, points): every point in its leaves and the points there, `leaf_size` at most where a
    leaf is not dense. Without a gap there is no spill.

    Probes (radius below 0) go down with the points and have no say in the splits.
    """
    real = F.col("radius") >= 0
    rows = points.select(
        F.explode(F.array(*map(F.lit, trees))).alias("tree"),
        F.concat(F.size("v").cast("string"), F.lit(":")).alias("leaf"),
        "node",
        "v",
        "radius",
    )
    done: DataFrame | None = None
    last = None
    while True:
        sizes = rows.groupBy("tree", "leaf").agg(F.count(F.when(real, 1)).alias("points"))
        sizes = tables.written(sizes, "forest-sizes")
        small = rows.join(sizes.where(F.col("points") <= leaf_size), ["tree", "leaf"])
        done = small if done is None else done.unionByName(small)
        big = rows.join(sizes.where(F.col("points") > leaf_size), ["tree", "leaf"])
        state = tuple(sizes.where(F.col("points") > leaf_size).agg(F.count(F.lit(1)), F.max("points")).first())
        if not state[0] or state == last:  # nothing is left, or points on one spot as far as directions tell
            return done.unionByName(big)
        last = state
        draw = F.pmod(F.xxhash64("node", "tree", F.lit(seed)), F.lit(1 << 30)) < F.lit(SAMPLE << 30) / F.col("points")
        limits = (
            big.where(draw & real)
            .select("tree", "leaf", "node", "v", "points")
            .groupBy("tree", "leaf")
            .applyInPandas(lambda f: _fit(f, seed, gap, leaf_size), "tree int, leaf string, low array<double>, high array<double>")
        )
        limits = tables.written(limits, "forest-limits")
        dense = F.size("low") == 0
        done = done.unionByName(big.join(limits.where(dense).select("tree", "leaf"), ["tree", "leaf"], "left_semi"))
        sent = rows.join(limits.where(~dense), ["tree", "leaf"]).select("tree", "leaf", "node", "v", "radius", "low", "high")
        rows = tables.written(sent.mapInArrow(_send_down(seed), _ASSIGNED), "forest-points")


# --- balls -----------------------------------------------------------------------------------------------------------


def _gather(frame: pd.DataFrame, reach: float) -> pd.DataFrame:
    """Balls within a leaf: each next point that is still free takes in all free ones that fit."""
    frame = frame.sort_values("node", ignore_index=True)
    x, radius = np.stack(frame["v"].to_numpy()), frame["radius"].to_numpy()
    owner = np.full(len(x), -1)
    bound = radius.copy()
    for i in range(len(x)):
        if owner[i] >= 0:
            continue
        free = np.flatnonzero(owner < 0)
        angle = np.arccos(np.clip(x[free] @ x[i], -1, 1))
        fits = (angle + radius[free] <= reach) | (free == i)
        taken = free[fits]
        owner[taken] = i
        bound[taken] = np.where(taken == i, radius[i], angle[fits] + radius[taken])
    return pd.DataFrame({"node": frame["node"], "centre": frame["node"].to_numpy()[owner], "bound": bound})


def _balls(points: DataFrame, reach: float, leaf_size: int) -> tuple[DataFrame, _Tables]:
    """(node, centre, radius of the ball), by passes until a pass gathers less than a tenth of the balls; and its tables."""
    spark = points.sparkSession
    centres = points.select("node", "v", F.lit(0.0).alias("radius"))
    owners = points.select("node", F.col("node").alias("centre"))
    count = points.count()
    seed, older = 0, _Tables(spark)
    while count:
        seed += 1
        scratch, tables = _Tables(spark), _Tables(spark)
        leaves = _forest(centres, range(1), None, -seed, leaf_size, scratch)
        # points that no direction parts may be many: a ball is as good from any share of them
        part = F.pmod(F.xxhash64("node"), F.ceil(F.col("points") / BLOCK)).alias("part")
        moved = leaves.select("tree", "leaf", part, "node", "v", "radius").groupBy("tree", "leaf", "part").applyInPandas(
            lambda f: _gather(f, reach), "node binary, centre binary, bound double"
        )
        moved = scratch.written(moved, "balls-moved")
        radii = moved.groupBy("centre").agg(F.max("bound").alias("radius"))
        centres = centres.select("node", "v").join(radii.withColumnRenamed("centre", "node"), "node")
        centres = tables.written(centres.select("node", "v", "radius"), "balls-centres")
        step = moved.select(F.col("node").alias("centre"), F.col("centre").alias("next"))
        owners = owners.join(step, "centre").select("node", F.col("next").alias("centre"))
        owners = tables.written(owners, "balls-owners")
        scratch.remove()
        older.remove()
        older = tables
        before, count = count, centres.count()
        if count > 0.9 * before:
            break
    return owners.join(centres.select(F.col("node").alias("centre"), "radius"), "centre"), older


def _close(table: pa.Table, similarity: float) -> pa.Table:
    """Pairs of balls in a leaf, or of two blocks, that are linked as a whole (`sure`) or may have linked members."""
    x, radius, nodes = _rows(table["v"]), table["radius"].to_numpy(), table["node"].to_pylist()
    block = table["block"].to_numpy()
    limit = math.acos(similarity)
    # first by the widest balls there are, then pair by pair
    near = math.cos(min(limit + 2 * radius.max() + 1e-6, math.pi))
    i, j = np.nonzero(np.triu(x @ x.T >= near, 1))
    if block.min() != block.max():
        across = block[i] != block[j]
        i, j = i[across], j[across]
    starts = range(0, len(i), 1 << 14)
    found = [np.einsum("ij,ij->i", x[i[at : at + (1 << 14)]], x[j[at : at + (1 << 14)]]) for at in starts]
    found = np.concatenate(found) if found else np.zeros(0)
    angle, both = np.arccos(np.clip(found, -1, 1)), radius[i] + radius[j]
    sure = np.where(both == 0, found >= similarity, angle + both <= limit - _EPS)
    keep = sure | (both > 0) & (angle - both <= limit + _EPS)
    pairs = [sorted((nodes[p], nodes[q])) for p, q in zip(i[keep].tolist(), j[keep].tolist(), strict=True)]
    return pa.table(
        {
            "a": pa.array([p for p, _ in pairs], pa.binary()),
            "b": pa.array([q for _, q in pairs], pa.binary()),
            "sure": pa.array(sure[keep]),
        }
    )


def _tree_count(points: int, leaf_size: int) -> int:
    if points <= leaf_size:
        return 1
    depth = math.ceil(math.log2(points / leaf_size)) + 1
    return math.ceil(math.log(MISS) / math.log(1 - KEPT_PER_LEVEL**depth))


# --- how much the trees miss -----------------------------------------------------------------------------------------


def _probes(balls: DataFrame, count: int, similarity: float) -> DataFrame:
    """(node, v, radius): made-up partners at the threshold's angle, `node` their ball's centre and the member they belong to.

    A partner lies in a ball of its own, so it is moved on by the radius of its point's ball.
    """
    limit = math.acos(similarity)

    def aside(v: np.ndarray, angle: float, rng: np.random.Generator) -> np.ndarray:
        other = rng.standard_normal(len(v))
        other -= (other @ v) * v
        length = np.linalg.norm(other)
        return v * math.cos(angle) + other / length * math.sin(angle) if length > 1e-6 else v

    def partners(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for node, v, radius in zip(frame["node"], frame["v"], frame["radius"], strict=True):
                rng = np.random.Generator(np.random.PCG64(xxhash.xxh64_intdigest(bytes(node))))
                found.append(aside(aside(np.asarray(v), limit, rng), radius, rng).tolist())
            yield pd.DataFrame({"node": frame["node"], "v": found, "radius": -1.0})

    drawn = F.pmod(F.xxhash64("node", F.lit("probe")), F.lit(1 << 30)) < F.lit((PROBES << 30) // max(count, 1))
    own = balls.where(drawn).select(F.concat("centre", "node").alias("node"), "v", "radius")
    return own.mapInPandas(partners, "node binary, v array<double>, radius double")


def _met(leaves: DataFrame) -> DataFrame:
    """Nodes of the probes that share a leaf with their ball's centre."""
    probes = leaves.where("radius < 0").select("tree", "leaf", F.col("node").alias("probe"), F.expr("substring(node, 1, 16)").alias("node"))
    return leaves.where("radius >= 0").select("tree", "leaf", "node").join(probes, ["tree", "leaf", "node"]).select("probe").distinct()


def _compared(leaves: DataFrame, similarity: float, leaf_size: int) -> DataFrame:
    """(a, b, sure) of all leaves; those beyond a block's size, which only dense leaves are, block by block."""
    kinds = "a binary, b binary, sure boolean"
    most = max(leaf_size, BLOCK)
    blocks = F.ceil(F.col("points") / most).cast("int")
    dealt = leaves.withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("node", F.lit("block")), blocks)})
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"one": F.least("block", "other"), "two": F.greatest("block", "other")})
    dealt = dealt.select("tree", "leaf", "one", "two", "block", "node", "v", "radius")
    return dealt.groupBy("tree", "leaf", "one", "two").applyInArrow(lambda t: _close(t, similarity), kinds)


def _near_centres(
    balls: DataFrame, centres: DataFrame, similarity: float, leaf_size: int, trees: int | None, tables: _Tables
) -> DataFrame:
    """(a, b, sure): pairs of balls that are linked or may have linked members."""
    spark = centres.sparkSession
    count = centres.count()
    gap = 2 * math.sin(math.acos(similarity) / 2)  # of unit vectors at the threshold, on directions of unit variance
    wanted, grown = trees or _tree_count(count, leaf_size), 0
    measured = trees is None and count > leaf_size
    points, lost, whole, miss = centres, None, {}, 0.0
    if measured:
        probes = tables.written(_probes(balls, balls.count(), similarity), "forest-probes")
        points = centres.union(probes)
    pairs: DataFrame | None = None
    while grown < wanted:
        rounds, batch = _Tables(spark), _Tables(spark)
        numbers = range(grown, min(grown + BATCH, wanted))
        leaves = batch.written(_forest(points, numbers, gap, 1, leaf_size, rounds), "forest-leaves")
        rounds.remove()
        found = _compared(leaves.where("radius >= 0"), similarity, leaf_size)
        found = tables.written(found.groupBy("a", "b").agg(F.min("sure").alias("sure")), "forest-found")
        pairs = found if pairs is None else pairs.union(found)
        grown = numbers.stop
        if measured:
            if lost is None:
                # an eighth: the first three levels of the first tree
                eighth = F.floor((F.ascii(F.substring(F.substring_index("leaf", ":", -1), 1, 1)) - 48) / 8)
                region = leaves.where("radius < 0 and tree = 0").groupBy(F.col("node").alias("probe")).agg(F.min(eighth).alias("region"))
                lost = tables.written(region, "forest-regions")
                whole = {r["region"]: r["count"] for r in lost.groupBy("region").count().collect()}
            lost = tables.written(lost.join(_met(leaves), "probe", "left_anti"), "forest-lost")
            if grown == wanted:
                missed = {r["region"]: r["count"] for r in lost.groupBy("region").count().collect()}
                miss = max((missed.get(r, 0) / n for r, n in whole.items()), default=0.0)
                if miss > MISS:
                    wanted = math.ceil(grown * min(4.0, max(1.25, math.log(MISS) / math.log(min(miss, 0.99)))))
        batch.remove()
    return pairs


# --- the operator ----------------------------------------------------------------------------------------------------


def near_vectors(
    vectors: DataFrame,
    *,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    similarity: float = SIMILARITY,
    leaf_size: int = LEAF,
    trees: int | None = None,
) -> DataFrame:
    """(id, n_links, component_id, kept) of every vector; id is null where the table's is."""
    spark = vectors.sparkSession
    rows = vectors.select(
        F.coalesce(F.col(vec_id).cast("long"), F.lit(LAST_ID)).alias("id"), F.col(embedding).alias("e")
    )
    valid = _valid(F.col("e"))
    node = F.unhex(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(i), F.col("e"))), 16, "0") for i in (1, 2)]))
    rows = rows.select("id", F.when(valid, node).alias("node"), F.when(valid, F.col("e")).alias("e"))
    tables, kept = _Tables(spark), _Tables(spark)
    members = kept.written(rows.groupBy("id", "node").agg(F.count(F.lit(1)).alias("rows")), "forest-members")
    points = rows.where("node is not null").groupBy("node").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("e").alias("e")
    )
    points = tables.written(points.select("node", "id", "n", _unit(F.col("e")).alias("v")), "forest-nodes")

    limit = math.acos(similarity)
    balls, gathered = _balls(points, limit / 3 - _EPS, leaf_size)
    balls = tables.written(balls.join(points, "node"), "forest-balls")
    gathered.remove()
    mass = balls.groupBy("centre").agg(F.sum("n").alias("mass"))
    mass = tables.written(mass, "forest-mass")
    centres = balls.where("node = centre").select("node", "v", "radius")
    centres = tables.written(centres, "forest-centres")
    pairs = _near_centres(balls, centres, similarity, leaf_size, trees, tables)
    pairs = tables.written(pairs.groupBy("a", "b").agg(F.min("sure").alias("sure")), "forest-pairs")

    sure = pairs.where("sure").select("a", "b")
    ways = sure.union(sure.select("b", "a")).toDF("centre", "other")
    whole = ways.join(mass.withColumnRenamed("centre", "other"), "other").groupBy("centre").agg(F.sum("mass").alias("more"))

    # balls on the edge: member by member
    edge = pairs.where("not sure").select("a", "b")
    own = balls.select(F.col("centre").alias("a"), F.col("node").alias("x"), F.col("n").alias("n_x"), F.col("v").alias("v_x"))
    far = balls.select(F.col("centre").alias("b"), F.col("node").alias("y"), F.col("n").alias("n_y"), F.col("v").alias("v_y"))
    cosine = F.aggregate(F.zip_with("v_x", "v_y", lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    single = edge.join(own, "a").join(far, "b").where(cosine >= similarity).select("a", "b", "x", "y", "n_x", "n_y")
    single = tables.written(single, "forest-edge-links")
    singles = single.select(F.col("x").alias("node"), F.col("n_y").alias("n")).union(single.select("y", "n_x"))
    singles = singles.groupBy("node").agg(F.sum("n").alias("extra"))

    components = connected_components(sure.union(single.select("a", "b")))
    placed = balls.join(mass, "centre").join(whole, "centre", "left").join(singles, "node", "left")
    placed = placed.join(components.withColumnRenamed("node", "centre"), "centre", "left")
    links = F.col("mass") - 1 + F.coalesce("more", F.lit(0)) + F.coalesce("extra", F.lit(0))
    placed = placed.select("node", "id", links.alias("n_links"), F.coalesce("component", "centre").alias("component"))
    placed = tables.written(placed, "forest-placed")
    least = tables.written(placed.groupBy("component").agg(F.min("id").alias("component_id")), "forest-components")
    named = kept.written(placed.join(least, "component").select("node", "n_links", "component_id"), "forest-named")
    tables.remove()
    out = members.join(named, "node", "left").withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    component = F.coalesce("component_id", "id")
    return out.select(
        F.when(F.col("id") < LAST_ID, F.col("id")).alias("id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(component < LAST_ID, component).alias("component_id"),
        (component == F.col("id")).alias("kept"),
    )
