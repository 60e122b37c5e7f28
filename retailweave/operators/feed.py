"""Work lists and lookups over the product feed."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..session import cut_lineage, shuffled
from ..sources.incremental import latest_per_key
from .filters import like_pattern
from .gram_index import rows_with_parts, write_index

# Fixed values.
BATCH_MIN, BATCH_MAX, BATCH_DEFAULT = 1, 200, 50
SEARCH_MAX = 50
MODE_NEW, MODE_RETRY, MODE_PRICE = "new_url", "retry_url", "price"
PAIR = ["id_product", "competitor_id"]


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(high, value))


def eligible_feed(feed: DataFrame) -> DataFrame:
    return feed.where(L.eligible_reference("reference"))


def snapshot_columns() -> list[Column]:
    return [
        F.col("id_product"),
        L.nullable_trim("reference").alias("supplier_reference"),
        L.nullable_trim("ean13").alias("ean"),
        L.nullable_trim("manufacturer_name").alias("brand"),
        F.col("price_tax_incl").cast("double").alias("source_price"),
        L.product_label("product_name", "id_product").alias("name"),
    ]


def of_competitor(df: DataFrame, competitor_id: int) -> DataFrame:
    return df.where(F.col("competitor_id") == competitor_id)


def new_products(
    feed: DataFrame, finals: DataFrame, tests: DataFrame, competitor_id: int, after_id: int = 0, limit: int = BATCH_DEFAULT
) -> DataFrame:
    """Eligible products the competitor has neither a final url nor a test for, above the cursor."""
    return (
        eligible_feed(feed)
        .where(F.col("id_product") > after_id)
        .join(of_competitor(finals, competitor_id).select("id_product"), "id_product", "left_anti")
        .join(of_competitor(tests, competitor_id).select("id_product"), "id_product", "left_anti")
        .orderBy("id_product")
        .limit(clamp(limit, BATCH_MIN, BATCH_MAX))
        .select(*snapshot_columns())
    )


def retry_rows(feed: DataFrame, finals: DataFrame, tests: DataFrame) -> DataFrame:
    """Not found, not rejected, without a final url; for every competitor."""
    return (
        tests.where((F.col("result") == "not_found") & (F.col("validation_status") != "rejected"))
        .select(*PAIR, "last_tested_at")
        .join(finals.select(*PAIR), PAIR, "left_anti")
        .join(eligible_feed(feed), "id_product")
    )


def retry_products(
    feed: DataFrame, finals: DataFrame, tests: DataFrame, competitor_id: int, limit: int = BATCH_DEFAULT
) -> DataFrame:
    """Longest untested first. There is no cursor: a retried product moves to the end by itself."""
    return (
        retry_rows(feed, of_competitor(finals, competitor_id), of_competitor(tests, competitor_id))
        .orderBy("last_tested_at", "id_product")
        .limit(clamp(limit, BATCH_MIN, BATCH_MAX))
        .select(*snapshot_columns(), "last_tested_at")
    )


def last_observed(history: DataFrame) -> DataFrame:
    return history.groupBy("competitor_id", "id_product", "url").agg(F.max("observed_at").alias("last_scraped_at"))


def merge_last_observed(known: DataFrame, observations: DataFrame) -> DataFrame:
    """A kept `last_observed` table after new observations, without reading the history again."""
    new = last_observed(observations)
    return known.unionByName(new).groupBy("competitor_id", "id_product", "url").agg(
        F.max("last_scraped_at").alias("last_scraped_at")
    )


def price_worklist(
    finals: DataFrame,
    competitors: DataFrame,
    history: DataFrame,
    competitor_id: int,
    after_id: int = 0,
    limit: int = BATCH_DEFAULT,
    known: DataFrame | None = None,
) -> DataFrame:
    """Final urls to price again: never scraped first, then oldest; ids above the cursor, then wrapping round.

    With `known`, a kept `last_observed` table, the history is not read; else only that of final urls is aggregated.
    """
    keys = ["competitor_id", "id_product", "url"]
    if known is None:
        wanted = of_competitor(finals, competitor_id).select(*keys)
        seen = last_observed(of_competitor(history, competitor_id).join(wanted, keys, "left_semi"))
    else:
        seen = of_competitor(known, competitor_id)
    wrapped = F.col("id_product") <= after_id
    return (
        of_competitor(finals, competitor_id)
        .join(seen, ["competitor_id", "id_product", "url"], "left")
        .join(competitors.select(F.col("id").alias("competitor_id"), "name", "domain"), "competitor_id")
        .orderBy(wrapped, F.col("last_scraped_at").isNotNull(), "last_scraped_at", "id_product")
        .limit(clamp(limit, BATCH_MIN, BATCH_MAX))
        .select(
            "id_product",
            "competitor_id",
            F.col("name").alias("competitor_name"),
            F.col("domain").alias("competitor_domain"),
            "url",
            F.col("competitor_price").cast("double").alias("source_price"),
            "last_scraped_at",
        )
    )


def eligible_counts(feed: DataFrame, finals: DataFrame, tests: DataFrame, competitors: DataFrame) -> DataFrame:
    """Products still to try per competitor = eligible products minus those with a final or a test.

    Counting the complement avoids pairing every product with every competitor.
    """
    eligible = eligible_feed(feed)
    total = eligible.agg(F.count("*").alias("n")).scalar()
    done = (
        finals.select(*PAIR)
        .unionByName(tests.select(*PAIR))
        .distinct()
        .join(eligible.select("id_product"), "id_product", "left_semi")
        .groupBy("competitor_id")
        .agg(F.count("*").alias("done"))
    )
    return competitors.join(done, competitors["id"] == done["competitor_id"], "left").select(
        F.col("id").alias("competitor_id"), (total - F.coalesce("done", F.lit(0))).alias("eligible")
    )


def pending_work(feed: DataFrame, finals: DataFrame, tests: DataFrame, competitors: DataFrame) -> DataFrame:
    """Per competitor: is there new, retry or price work?"""
    fresh = eligible_counts(feed, finals, tests, competitors)
    retry = retry_rows(feed, finals, tests).select("competitor_id").distinct().withColumn("has_retry", F.lit(True))
    priced = finals.select("competitor_id").distinct().withColumn("has_finals", F.lit(True))
    return (
        fresh.join(retry, "competitor_id", "left")
        .join(priced, "competitor_id", "left")
        .select(
            "competitor_id",
            (F.col("eligible") > 0).alias("has_new"),
            F.coalesce("has_retry", F.lit(False)).alias("has_retry"),
            F.coalesce("has_finals", F.lit(False)).alias("has_finals"),
        )
    )


def normalize_mode(mode: str) -> str:
    cleaned = mode.strip().lower()
    return cleaned if cleaned in (MODE_NEW, MODE_RETRY) else MODE_NEW


def envelope(items: DataFrame, competitor_id: int, mode: str, after_id: int, limit: int) -> DataFrame:
    """Next cursor and whether the batch was full."""
    limit = clamp(limit, BATCH_MIN, BATCH_MAX)
    return items.agg(F.max("id_product").alias("m"), F.count("*").alias("n")).select(
        F.lit(competitor_id).alias("competitor_id"),
        F.lit(mode).alias("mode"),
        F.lit(limit).alias("limit"),
        F.col("n").alias("items"),
        F.greatest(F.lit(after_id).cast("bigint"), F.coalesce("m", F.lit(after_id).cast("bigint"))).alias("after_id"),
        (F.col("n") == limit).alias("has_more"),
    )


# --- categories and images ----------------------------------------------------------------------------


def category_paths(categories: DataFrame) -> DataFrame:
    """`root > … > leaf` of every category by walking the parents one level per step.

    Only unfinished walks take part in a step. A walk ends at the root, at a missing parent or where it would
    come back to a category it has seen; blank names are skipped. Lineage is cut at every step.
    """
    nodes = categories.select(
        F.col("id_category").alias("__id"),
        F.coalesce("id_parent", F.lit(0)).alias("__parent"),
        L.nullable_trim("name").alias("__name"),
    )
    walks = categories.select(
        "id_category",
        F.col("id_category").alias("at"),
        F.array().cast("array<bigint>").alias("seen"),
        F.array().cast("array<string>").alias("names"),
    )
    finished = None
    while True:
        step = walks.join(shuffled(nodes), F.col("at") == F.col("__id"), "left")
        step = cut_lineage(
            step.select(
                "id_category",
                F.coalesce("__parent", F.lit(0)).cast("bigint").alias("at"),
                F.array_append("seen", F.col("at")).alias("seen"),
                F.when(F.col("__name").isNotNull(), F.array_prepend("names", F.col("__name")))
                .otherwise(F.col("names"))
                .alias("names"),
            )
        )
        open_walk = (F.col("at") > 0) & ~F.array_contains("seen", F.col("at"))
        closed = step.where(~open_walk)
        finished = closed if finished is None else finished.unionByName(closed)
        walks = step.where(open_walk)
        if walks.isEmpty():
            break
    return finished.select("id_category", L.blank_to_null(F.array_join("names", " > ")).alias("category_path"))


def main_images(images: DataFrame, image_shop: DataFrame) -> DataFrame:
    """Cover of the shop first, else of the product; then position and id."""
    shop = image_shop.select("id_image", F.col("cover").alias("__shop_cover"))
    ranked = images.join(shuffled(shop), "id_image", "left").withColumn("__cover", F.coalesce("__shop_cover", "cover"))
    order = [F.col("__cover").desc(), F.col("position"), F.col("id_image")]
    return latest_per_key(ranked, ["id_product"], order).select("id_product", "id_image")


def image_url(base_url: str, id_image: str = "id_image") -> Column:
    return F.concat(
        F.lit(base_url.rstrip("/") + "/img/p/"),
        L.image_path(id_image),
        F.lit("/"),
        F.col(id_image).cast("string"),
        F.lit("-large_default.jpg"),
    )


def product_snapshots(
    feed: DataFrame, products: DataFrame, paths: DataFrame, images: DataFrame, base_url: str, ids: DataFrame | None = None
) -> DataFrame:
    """Feed row, category path and main image per product, for the given ids (all when None)."""
    rows = feed if ids is None else feed.join(ids.select("id_product"), "id_product", "left_semi")
    return (
        rows.where("id_product > 0")
        .join(shuffled(products.select("id_product", F.col("id_category_default").alias("id_category"))), "id_product", "left")
        .join(shuffled(paths), "id_category", "left")
        .join(shuffled(images), "id_product", "left")
        .select(*snapshot_columns(), "category_path", image_url(base_url).alias("source_image_url"))
    )


SEARCHED = ("reference", "ean13", "manufacturer_name", "product_name")


def write_search_index(feed: DataFrame, path: str) -> None:
    """Stores the parts of what `search_products` looks through."""
    write_index(feed, "id_product", SEARCHED, path)


def _from_index(feed: DataFrame, index: str, needle: str) -> DataFrame:
    """Rows that may match: those with all parts of the longest run between wildcards, and the row of that id."""
    run = max(re.split(r"[%_\\]", needle.lower()), key=len)
    keys = rows_with_parts(feed.sparkSession, index, run, feed.schema["id_product"].dataType.simpleString())
    if keys is None:
        return feed
    keys = keys.select(F.col("key").alias("id_product"))
    if re.fullmatch("[0-9]{1,18}", needle):
        own = feed.where(F.col("id_product") == int(needle)).select("id_product")
        keys = keys.unionByName(own)
    return feed.join(keys, "id_product", "left_semi")


def search_products(feed: DataFrame, query: str, limit: int = 20, index: str | None = None) -> DataFrame:
    """Products whose reference, code, brand or name holds the needle (case-insensitive, LIKE wildcards kept),
    or whose id it is; name hits first, newest first. With the folder of a `write_search_index` only rows that it
    points at are looked through."""
    needle = query.strip()
    if not needle:
        return feed.limit(0).select(*snapshot_columns())
    if index is not None:
        feed = _from_index(feed, index, needle)
    pattern = like_pattern(needle)
    hit = F.lit(False)
    for name in SEARCHED:
        hit = hit | F.coalesce(F.lower(F.trim(F.col(name))).like(pattern), F.lit(False))
    if re.fullmatch("[0-9]{1,18}", needle):
        hit = hit | (F.col("id_product") == int(needle))
    in_name = F.lower(F.coalesce("product_name", F.lit(""))).like(pattern)
    return (
        feed.where(hit)
        .orderBy(F.when(in_name, 0).otherwise(1), F.col("id_product").desc())
        .limit(clamp(limit, 1, SEARCH_MAX))
        .select(*snapshot_columns())
    )
