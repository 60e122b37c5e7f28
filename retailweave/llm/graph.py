"""Connected components of a link table, by alternating large and small stars.

Each round points every node at the smallest node among its neighbours: first its larger neighbours, then its smaller
ones. A hub only ever takes part in a minimum, which Spark combines before the shuffle, and in a join whose other side is
unique on the key. Rounds are logarithmic in the length of the longest path. Each round is a reliable checkpoint, so a
lost executor costs one round at most, and nothing of the graph comes to the driver but two sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has a link to another one; the component is its smallest node."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = cut_lineage(edges)
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = cut_lineage(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").union(
        edges.select("v", "v").distinct()
    )


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
    return tuple(row)
