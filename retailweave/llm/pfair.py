"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

Documents of a source are dealt into blocks of `block_rows`. The target gives each source a whole number of shares; a
period has as many slots as there are shares, one block each. Block j (from 0) of a source with w of Q shares is
released at floor(j * Q / w) and due at ceil((j + 1) * Q / w). One period is scheduled earliest deadline first among the
released blocks, and the periods repeat, since releases and deadlines do. As the weights add up to one, every block
meets its deadline: after any number of slots each source is less than one block from its target share, as long as
no source has run out. A source that has run out leaves its slots empty, so the others keep their own order and pace
and nothing is dropped.

Within a source documents follow md5(doc_id), a shuffled order that does not depend on the layout. Numbering them takes
no task that sees a whole source: rows are numbered inside hash buckets of a source and the buckets' counts summed up.

Defined cases: a null source is a source of its own; a source that the target does not name gets one share; repeated
rows follow each other; columns with the names of the results are replaced by them; null ids come last in their source; an empty table gives an empty one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import clear_of, free_prefix

BLOCK_ROWS = 8
PERIOD = 1000


def sqrt_shares(docs: DataFrame, *, source: str = "source", period: int = PERIOD) -> DataFrame:
    """(source, shares): target weights in proportion to the square root of a source's rows, one share at least."""
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.sqrt(F.count(F.lit(1)).cast("double")).alias("root"))
    total = F.sum("root").over(Window.partitionBy(F.lit(1)))
    shares = F.greatest(F.lit(1), F.floor(F.col("root") * period / total + 0.5)).cast("long")
    return sizes.select("source", shares.alias("shares"))


def period_slots(target: DataFrame) -> DataFrame:
    """(source, shares, turn, slot): the slot in a period of each source's block number `turn`, by earliest deadline.

    The target has a row for each source; it is one row of arrays here, as the schedule is.
    """
    rows = target.agg(F.sort_array(F.collect_list(F.struct(F.col("source").isNull().alias("none"), "source", "shares"))).alias("s"))
    rows = rows.where("size(s) > 0").select(
        "s", F.expr("aggregate(s, 0L, (a, x) -> a + x.shares)").alias("q"), F.expr("transform(s, x -> x.shares)").alias("w")
    )
    due = (
        "array_min(filter(transform(acc.done, (c, i) -> IF(c < w[i] AND (c * q) div w[i] <= t, "
        "struct(((c + 1) * q + w[i] - 1) div w[i] AS due, i AS i), NULL)), x -> x IS NOT NULL)).i"
    )
    schedule = (
        "aggregate(sequence(0L, q - 1), "
        "struct(transform(w, x -> 0L) AS done, cast(array() AS array<int>) AS turns), "
        f"(acc, t) -> named_struct('done', transform(acc.done, (c, i) -> IF(i = {due}, c + 1, c)), "
        f"'turns', concat(acc.turns, array({due}))), acc -> acc.turns)"
    )
    slots = rows.select("s", F.posexplode(F.expr(schedule)).alias("slot", "i"))
    in_source = Window.partitionBy("i").orderBy("slot")
    return slots.select(
        F.expr("s[i].source").alias("source"),
        F.expr("s[i].shares").alias("shares"),
        (F.row_number().over(in_source) - 1).cast("long").alias("turn"),
        F.col("slot").cast("long").alias("slot"),
        F.expr("aggregate(s, 0L, (a, x) -> a + x.shares)").alias("period"),
    )


def _null_safe(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def mix_sources(
    docs: DataFrame,
    target: DataFrame,
    *,
    source: str = "source",
    doc_id: str = "doc_id",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Adds `block` (of its source), `release`, `deadline`, `slot` and `place` (in the block) to every document.

    Sorted by (slot, place) the documents are the mixture.
    """
    spark = docs.sparkSession
    docs = clear_of(docs, "block", "release", "deadline", "slot", "place")
    name = free_prefix(docs)
    names = docs.select(F.col(source).alias("source")).distinct()
    target = (
        names.alias("n")
        .join(target.alias("t"), _null_safe("n.source", "t.source"), "left")
        .select("n.source", F.coalesce("t.shares", F.lit(1)).cast("long").alias("shares"))
    )
    # so many buckets that both a bucket's rows and a source's buckets grow with the root of the input
    digits = max(1, math.ceil(math.log(max(docs.count(), 1) ** 0.5, 16)))
    rows = docs.withColumn(f"{name}order", F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
    rows = rows.withColumn(f"{name}order", F.when(F.col(doc_id).isNull(), F.lit("g" * 32)).otherwise(F.col(f"{name}order")))
    rows = rows.withColumns({f"{name}bucket": F.substring(f"{name}order", 1, digits), f"{name}source": F.struct(F.col(source))})
    counts = docs.select(
        F.struct(F.col(source)).alias(f"{name}source"),
        F.when(F.col(doc_id).isNull(), F.lit("g" * digits))
        .otherwise(F.substring(F.md5(F.col(doc_id).cast("string")), 1, digits))
        .alias(f"{name}bucket"),
    )
    counts = counts.groupBy(f"{name}source", f"{name}bucket").agg(F.count(F.lit(1)).alias(f"{name}rows"))
    before = Window.partitionBy(f"{name}source").orderBy(f"{name}bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(f"{name}source", f"{name}bucket", F.coalesce(F.sum(f"{name}rows").over(before), F.lit(0)).alias(f"{name}offset"))

    inside = Window.partitionBy(f"{name}source", f"{name}bucket").orderBy(f"{name}order", doc_id)
    rows = rows.withColumn(f"{name}number", F.row_number().over(inside) - 1)
    rows = rows.join(offsets, [f"{name}source", f"{name}bucket"])
    number = F.col(f"{name}offset") + F.col(f"{name}number")
    rows = rows.withColumns(
        {"block": F.floor(number / block_rows).cast("long"), "place": F.pmod(number, F.lit(block_rows)).cast("long")}
    )

    plan = period_slots(target)
    plan = plan.groupBy("source").agg(
        F.first("shares").alias(f"{name}shares"), F.first("period").alias(f"{name}period"), F.array_sort(F.collect_list("slot")).alias(f"{name}slots")
    )
    plan = plan.select(F.struct(F.col("source").alias(source)).alias(f"{name}source"), f"{name}shares", f"{name}period", f"{name}slots")
    rows = rows.join(plan, f"{name}source")
    due = {
        "release": f"(block * {name}period) div {name}shares",
        "deadline": f"((block + 1) * {name}period + {name}shares - 1) div {name}shares",
        "slot": f"(block div {name}shares) * {name}period + {name}slots[cast(block % {name}shares AS int)]",
    }
    rows = rows.withColumns({k: F.expr(v) for k, v in due.items()})
    return rows.select(*docs.columns, "block", "release", "deadline", "slot", "place")
