"""Work batches: rows to process plus the envelope with the next cursor."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from ..operators import feed as W


class WorkBatch(NamedTuple):
    items: DataFrame
    envelope: DataFrame


def work_batch(
    feed: DataFrame,
    finals: DataFrame,
    tests: DataFrame,
    competitor_id: int,
    mode: str = W.MODE_NEW,
    after_id: int = 0,
    limit: int = W.BATCH_DEFAULT,
    snapshots: DataFrame | None = None,
) -> WorkBatch:
    """New or retry products (unknown modes mean new). `snapshots` adds category path and image."""
    mode = W.normalize_mode(mode)
    if mode == W.MODE_RETRY:
        items = W.retry_products(feed, finals, tests, competitor_id, limit).drop("last_tested_at")
    else:
        items = W.new_products(feed, finals, tests, competitor_id, after_id, limit)
    if snapshots is not None:
        items = items.join(snapshots.select("id_product", "category_path", "source_image_url"), "id_product", "left")
    return WorkBatch(items, W.envelope(items, competitor_id, mode, after_id, limit))


def price_batch(
    finals: DataFrame,
    competitors: DataFrame,
    history: DataFrame,
    competitor_id: int,
    after_id: int = 0,
    limit: int = W.BATCH_DEFAULT,
) -> WorkBatch:
    items = W.price_worklist(finals, competitors, history, competitor_id, after_id, limit)
    return WorkBatch(items, W.envelope(items, competitor_id, W.MODE_PRICE, after_id, limit))
