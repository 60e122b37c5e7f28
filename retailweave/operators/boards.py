"""Price boards: own price against competitor prices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L

# Fixed values of the boards.
SAME_BAND = 1.0
BOARD_MIN, BOARD_MAX, BOARD_DEFAULT = 10, 150, 60
GAP_MIN, GAP_MAX, GAP_DEFAULT = 10, 300, 100
THRESHOLD_MIN, THRESHOLD_MAX, THRESHOLD_DEFAULT = 5.0, 200.0, 30.0
HISTOGRAM_EDGE = 1000.0
BUCKETS = (  # key, low (inclusive), high (exclusive, but the last), label, tone
    ("lt-30", -1000.0, -30.0, "< -30%", "cheaper"),
    ("m30-m20", -30.0, -20.0, "-30%", "cheaper"),
    ("m20-m10", -20.0, -10.0, "-20%", "cheaper"),
    ("m10-m5", -10.0, -5.0, "-10%", "cheaper"),
    ("m5-m1", -5.0, -1.0, "-5%", "cheaper"),
    ("eq", -1.0, 1.0, "0%", "same"),
    ("p1-p5", 1.0, 5.0, "5%", "pricier"),
    ("p5-p10", 5.0, 10.0, "10%", "pricier"),
    ("p10-p20", 10.0, 20.0, "20%", "pricier"),
    ("p20-p30", 20.0, 30.0, "30%", "pricier"),
    ("gt-30", 30.0, 1000.0, "> 30%", "pricier"),
)


def delta_percent(own: Column, other: Column) -> Column:
    return (own - other) / other * F.lit(100.0)


def tone(delta: Column) -> Column:
    return F.when(delta < -SAME_BAND, "cheaper").when(delta > SAME_BAND, "pricier").otherwise("same")


def priced_products(feed: DataFrame) -> DataFrame:
    return feed.where("price_tax_incl > 0 AND id_product > 0").select(
        "id_product",
        L.product_label("product_name", "id_product").alias("name"),
        L.nullable_trim("manufacturer_name").alias("brand"),
        F.col("price_tax_incl").cast("double").alias("source_price"),
    )


def price_board(finals: DataFrame, competitors: DataFrame, feed: DataFrame) -> DataFrame:
    """Own price against the mean of the known competitors' final prices. The external reference seller keeps its
    prices in another table and so never enters the mean. Prices are merged per product before the join."""
    means = (
        finals.where(F.col("competitor_price").isNotNull())
        .join(competitors.select(F.col("id").alias("competitor_id")), "competitor_id", "left_semi")
        .groupBy("id_product")
        .agg(F.sum("competitor_price").alias("s"), F.count("*").alias("competitor_count"))
        .withColumn("avg_price", F.col("s").cast("double") / F.col("competitor_count"))
        .where("avg_price > 0")
    )
    own, mean = F.col("source_price"), F.col("avg_price")
    delta = delta_percent(own, mean)
    return priced_products(feed).join(means.drop("s"), "id_product").select(
        "id_product",
        "name",
        "brand",
        "source_price",
        "avg_price",
        (own / mean * F.lit(100.0)).alias("price_index"),
        delta.alias("delta_percent"),
        tone(delta).alias("tone"),
        "competitor_count",
    )


def board_rows(board: DataFrame, limit: int = BOARD_DEFAULT) -> DataFrame:
    """Largest gaps first."""
    rows = max(BOARD_MIN, min(BOARD_MAX, limit))
    return board.orderBy(F.abs("delta_percent").desc(), "id_product").limit(rows)


def price_cells(
    board: DataFrame,
    finals: DataFrame,
    sellers: Sequence[tuple[int, str]],
    reference_prices: DataFrame | None = None,
) -> DataFrame:
    """One cell per board product and seller (id, name); `empty` where the seller has no price.

    Each product's prices are gathered with one aggregate and the cells unfolded from the literal seller list,
    without pairing tables.
    """
    by_product = finals.where(F.col("competitor_price").isNotNull()).groupBy("id_product").agg(
        *[
            F.max(F.when(F.col("competitor_id") == key, F.struct(F.col("competitor_price").cast("double").alias("p"), "url"))).alias(
                f"s{key}"
            )
            for key, _ in sellers
        ]
    )
    rows = board.select("id_product", "source_price").join(by_product, "id_product")
    cells = [(str(key), name, F.col(f"s{key}")["p"], F.col(f"s{key}")["url"]) for key, name in sellers]
    if reference_prices is not None:
        external = reference_prices.select("id_product", F.col("price").cast("double").alias("__ref"))
        rows = rows.join(external, "id_product", "left")
        cells.append(("reference", "Reference", F.col("__ref"), F.lit(None).cast("string")))
    delta = lambda p: delta_percent(F.col("source_price"), p)
    unfolded = F.array(
        *[
            F.struct(
                F.lit(key).alias("seller"),
                F.lit(name).alias("seller_name"),
                price.alias("price"),
                delta(price).alias("delta_percent"),
                F.when(price.isNull(), "empty").otherwise(tone(delta(price))).alias("tone"),
                url.alias("url"),
            )
            for key, name, price, url in cells
        ]
    )
    return rows.select("id_product", F.inline(unfolded))


def board_totals(board: DataFrame) -> DataFrame:
    return board.agg(
        F.count("*").alias("products"),
        *[F.count_if(F.col("tone") == t).alias(t) for t in ("cheaper", "same", "pricier")],
        F.sum(F.col("delta_percent").cast("decimal(24,6)")).cast("double").alias("s"),
    ).select(
        "products",
        "cheaper",
        "same",
        "pricier",
        # summed as decimals: the mean does not depend on how rows are spread over tasks
        F.when(F.col("products") > 0, F.col("s") / F.col("products")).otherwise(0.0).alias("avg_delta"),
    )


def bucket_key(delta: Column | str) -> Column:
    """Histogram bucket of a delta, null beyond the outer edges."""
    value = F.col(delta) if isinstance(delta, str) else delta
    out = F.lit(None).cast("string")
    for key, low, high, _, _ in reversed(BUCKETS):
        inside = (value >= low) & ((value <= high) if high == HISTOGRAM_EDGE else (value < high))
        out = F.when(inside, F.lit(key)).otherwise(out)
    return out


def delta_histogram(board: DataFrame) -> DataFrame:
    """Eleven fixed buckets with zeros: one aggregate row unfolded, no range join."""
    counts = board.agg(
        *[F.count_if(bucket_key("delta_percent") == key).alias(f"b{i}") for i, (key, *_) in enumerate(BUCKETS)]
    )
    rows = [
        F.struct(
            F.lit(key).alias("key"),
            F.lit(label).alias("label"),
            F.lit(kind).alias("tone"),
            F.lit(low).alias("min"),
            F.lit(high).alias("max"),
            F.col(f"b{i}").alias("count"),
        )
        for i, (key, low, high, label, kind) in enumerate(BUCKETS)
    ]
    return counts.select(F.inline(F.array(*rows)))


def board_filter(board: DataFrame, bucket: str = "", competitor_finals: DataFrame | None = None) -> DataFrame:
    """Drill-down to one bucket and / or to products one competitor sells. An unknown bucket filters nothing."""
    out = board
    if bucket in {b[0] for b in BUCKETS}:
        out = out.where(bucket_key("delta_percent") == bucket)
    if competitor_finals is not None:
        sold = competitor_finals.where(F.col("competitor_price").isNotNull()).select("id_product")
        out = out.join(sold, "id_product", "left_semi")
    return out


# --- trusted gaps -------------------------------------------------------------------------------------


def gap_entries(
    finals: DataFrame,
    feed: DataFrame,
    trusted: Sequence[int],
    targets: Sequence[int],
    threshold: float = THRESHOLD_DEFAULT,
) -> DataFrame:
    """Products where a target seller strays from the trusted sellers' mean by more than the threshold."""
    limit = max(THRESHOLD_MIN, min(THRESHOLD_MAX, float(threshold)))
    seller, price = F.col("competitor_id"), F.col("competitor_price")
    is_trusted = seller.isin(*trusted)
    prices = (
        finals.where(price.isNotNull() & seller.isin(*trusted, *targets))
        .groupBy("id_product")
        .agg(
            F.sum(F.when(is_trusted, price)).cast("double").alias("s"),
            F.count(F.when(is_trusted, 1)).alias("n"),
            *[F.max(F.when(seller == t, price)).cast("double").alias(f"price_{t}") for t in targets],
        )
        .withColumn("trusted_avg", F.col("s") / F.when(F.col("n") > 0, F.col("n")))
        .where("trusted_avg > 0")
    )
    for t in targets:
        p = F.col(f"price_{t}")
        delta = F.when(p > 0, (p - F.col("trusted_avg")) / F.col("trusted_avg") * F.lit(100.0))
        prices = prices.withColumns(
            {
                f"price_{t}": F.when(p > 0, p),
                f"delta_{t}": delta,
                f"offender_{t}": F.coalesce(F.abs(delta) > limit, F.lit(False)),
                f"tone_{t}": F.when(delta.isNull(), "empty")
                .when(delta > 0, "pricier")
                .when(delta < 0, "cheaper")
                .otherwise("same"),
            }
        )
    any_offender = F.lit(False)
    for t in targets:
        any_offender = any_offender | F.col(f"offender_{t}")
    worst = F.greatest(F.lit(0.0), *[F.coalesce(F.abs(f"delta_{t}"), F.lit(0.0)) for t in targets])
    own = feed.where("id_product > 0").select(
        "id_product",
        L.product_label("product_name", "id_product").alias("name"),
        F.col("price_tax_incl").cast("double").alias("source_price"),
    )
    return prices.where(any_offender).withColumn("max_gap", worst).drop("s", "n").join(own, "id_product")


def gap_visible(targets: Sequence[int], show: dict[int, bool], show_both: bool = True) -> Column:
    """Rows with a single offender follow that target's flag, rows with several the `both` flag."""
    several = sum((F.col(f"offender_{t}").cast("int") for t in targets), F.lit(0)) > 1
    alone = F.lit(False)
    for t in targets:
        alone = alone | (F.col(f"offender_{t}") & F.lit(show.get(t, True)))
    return F.when(several, F.lit(show_both)).otherwise(alone)


def trusted_gaps(
    entries: DataFrame,
    targets: Sequence[int],
    show: dict[int, bool] | None = None,
    show_both: bool = True,
    limit: int | None = GAP_DEFAULT,
) -> DataFrame:
    """Widest gaps first."""
    rows = entries.where(gap_visible(targets, show or {}, show_both))
    if limit is None:
        return rows
    return rows.orderBy(F.col("max_gap").desc(), "id_product").limit(max(GAP_MIN, min(GAP_MAX, limit)))


def gap_totals(
    entries: DataFrame, targets: Sequence[int], show: dict[int, bool] | None = None, show_both: bool = True
) -> DataFrame:
    """Offenders are counted before the visibility flags, `products` after them."""
    both = F.lit(True)
    for t in targets:
        both = both & F.col(f"offender_{t}")
    return entries.agg(
        F.count_if(gap_visible(targets, show or {}, show_both)).alias("products"),
        *[F.count_if(F.col(f"offender_{t}")).alias(f"offenders_{t}") for t in targets],
        F.count_if(both).alias("both"),
    )
