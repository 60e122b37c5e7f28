"""Best candidates where the score has a part that steps with the gap between two prices.

A candidate's score is its text's similarity plus points for the gap of the competitor's price to the product's own:
a step function with few values. All products of a text have the same candidates, so the work is done on the text's
candidates once and each product then looks at bands of prices instead of at listings:

1. Products of one text and price have the same best candidates and are asked for once.
2. Prices fall into geometric bands; a band keeps its lowest and highest price and its best k for each value.
3. For a product's price a band's points are mostly constant. Then its k best for that value stand for the whole band.
4. A band that a step cuts through is opened only if the best it could hold comes before the k-th best of the constant
   bands, ties by query and url included: it is cut into `FAN` narrower bands, these are looked at alike, and after
   `LEVELS` levels the single prices, whose points are always constant.

The result equals scoring every product with every candidate. There are at most log(highest / lowest price) / log(BAND)
bands, and what is opened grows with `FAN` and the levels, so rows grow with products times bands, however many products
and listings share a text.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import measures as M
from ..session import shuffled, written
from ..sources.incremental import top_k_per

BAND, FAN, LEVELS = 1.05, 16, 3
_NO_PRICE = -float(1 << 40)
Steps = Sequence[tuple[float, int]]
_SITE = ["text_id", "competitor_id"]
_CELL = ["text_id", "source_price"]
_ASKED = [*_CELL, "competitor_id"]


def clamped(score: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), F.rint(score).cast("int")))


def price_points(candidate: Column | str, source: Column | str, far: Steps, near: Steps = ()) -> Column:
    """Points for the gap of two prices: `near` up to a gap, `far` from a gap on, 0 between and without prices."""
    gap = M.price_ratio(candidate, source)
    out = F.lit(0)
    for low, points in reversed(far):
        out = F.when(gap >= low, points).otherwise(out)
    for high, points in reversed(near):
        out = F.when(gap <= high, points).otherwise(out)
    return F.when(gap.isNull(), 0).otherwise(out)


def priced_score(similarity: Column, points: Column, year_points: Column) -> Column:
    return clamped(similarity + points + year_points)


def _order() -> list[Column]:
    return [F.col("score").desc(), F.col("position"), F.col("url")]


def _scored_by_value(rows: DataFrame, values: Sequence[int]) -> DataFrame:
    """Every row with the score it has at each value of the points."""
    spread = rows.withColumn("points", F.explode(F.array(*map(F.lit, values))))
    return spread.withColumn("score", priced_score(F.col("similarity"), F.col("points"), F.col("year_points")))


def _band(level: int) -> Column:
    """The band of a candidate: parts of a band lie in it, as `FAN` is a power of two; at the last level a price."""
    if level == LEVELS:
        return F.coalesce("c_price", F.lit(_NO_PRICE))
    return F.coalesce(F.floor(F.log("c_price") / math.log(BAND) * float(FAN**level)).cast("double"), F.lit(_NO_PRICE))


def _bands(rows: DataFrame, level: int, keys: list[str], values: Sequence[int], k: int) -> DataFrame:
    """(*keys, band, best, low, high): the bands of a level."""
    rows = rows.withColumn("band", _band(level))
    by_value = top_k_per(_scored_by_value(rows, values), [*keys, "band", "points"], _order(), k)
    entry = F.struct("points", "score", "position", "url", "matched_query")
    best = by_value.groupBy(*keys, "band").agg(F.collect_list(entry).alias("best"))  # k a value at most
    edges = rows.groupBy(*keys, "band").agg(F.min("c_price").alias("low"), F.max("c_price").alias("high"))
    return best.join(shuffled(edges), [*keys, "band"])


def best_priced(rows: DataFrame, products: DataFrame, far: Steps, near: Steps, k: int) -> DataFrame:
    """(id_product, competitor_id, url, position, matched_query, score): the best k per product and competitor.

    `rows` are the candidates of texts (text_id, competitor_id, url, position, matched_query, similarity, year_points,
    c_price), `products` (id_product, text_id, source_price). Ties go to earlier queries, then urls.
    """
    spark = rows.sparkSession
    values = sorted({0, *(points for _, points in (*far, *near))})
    rows = rows.withColumn("c_price", F.when(F.col("c_price") > 0, F.col("c_price").cast("double")))
    asked_price = F.when(F.col("source_price") > 0, F.col("source_price")).otherwise(0.0)  # others have no points
    priced = products.where("text_id is not null").select("id_product", "text_id", asked_price.alias("source_price"))

    x, low, high = F.col("source_price"), F.col("low"), F.col("high")
    at_low, at_high, nearest = (price_points(c, x, far, near) for c in (low, high, x))
    around = F.coalesce((low <= x) & (x <= high), F.lit(False))
    held = F.filter("best", lambda e: e["points"] == F.col("most"))
    place = lambda score, position, url: F.struct((-score).alias("score"), position.alias("position"), url.alias("url"))
    found = cut = None
    for level in range(LEVELS + 1):
        if level == 0:
            asked = priced.select(*_CELL).distinct().join(shuffled(_bands(rows, level, _SITE, values, k)), "text_id")
        else:
            opened = cut.select(*_SITE, F.col("band").alias("within")).distinct()
            rows = rows.withColumn("within", _band(level - 1)).join(shuffled(opened), [*_SITE, "within"], "left_semi")
            rows = written(spark, rows, "price-opened")
            inner = _bands(rows, level, [*_SITE, "within"], values, k)
            asked = cut.withColumnRenamed("band", "within").join(shuffled(inner), [*_SITE, "within"])
        asked = asked.withColumns(
            {
                "constant": (at_low == at_high) & (~around | (at_low == nearest)) | F.lit(level == LEVELS),
                "most": F.when(around, nearest).otherwise(F.greatest(at_low, at_high)),
            }
        )
        reach = F.array_min(F.transform(held, lambda e: place(e["score"], e["position"], e["url"])))
        asked = asked.select(*_ASKED, "band", "constant", F.when(F.col("constant"), held).alias("held"), reach.alias("reach"))
        asked = written(spark, asked, "price-asked")
        more = asked.where("constant").select(*_ASKED, F.explode("held").alias("e"))
        more = more.select(*_ASKED, "e.url", "e.position", "e.matched_query", "e.score")
        more = more if found is None else found.drop("rank").unionByName(more)
        found = written(spark, top_k_per(more, _ASKED, _order(), k), "price-found")
        if level == LEVELS:
            break
        bar = place(F.col("score"), F.col("position"), F.col("url"))
        bar = found.where(F.col("rank") == k).select(*_ASKED, bar.alias("bar"))
        cut = asked.where("NOT constant").select(*_ASKED, "band", "reach").join(shuffled(bar), _ASKED, "left")
        cut = cut.where(F.col("bar").isNull() | (F.col("reach") < F.col("bar"))).select(*_ASKED, "band")
        cut = written(spark, cut, "price-cut")
        if cut.isEmpty():
            break
    return priced.join(shuffled(found), _CELL).select("id_product", "competitor_id", "url", "position", "matched_query", "score")
