"""Streaming flows and the whole home report, checked against the same SQL as their batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators.aggregates import as_report
from ..plans.home_report import digest, home_report
from ..session import work_path
from ..sources import fact_store
from ..streaming import flows
from . import reporting  # noqa: F401  (their SQL is reused below)
from .competition import _HEALTH
from .competitor_sql import URL_EVENTS, with_ci
from .imports import NOW, _catalogue, _stamps_as_text
from .registry import SQL, query


def _stream(spark, sf, name, order):
    """The whole table as a stream of three micro-batches in the order of a column, each of as many files as cores."""
    rows, folder = fx.table(spark, sf, name), work_path(spark, f"{name}-files")
    number = F.unix_timestamp(order) if order == "ts" else F.col(order)
    low, high = rows.select(number.alias("v")).approxQuantile("v", [0.3, 0.7], 0.01)
    part = F.when(number <= low, 0).when(number <= high, 1).otherwise(2)
    files = spark.sparkContext.defaultParallelism
    for i in range(3):
        rows.where(part == i).repartition(files).write.mode("append").parquet(folder)
    return flows.read_stream(spark, folder, rows.schema, files)


def _folders(spark, label):
    return work_path(spark, label), work_path(spark, f"{label}-checkpoint")


@query(
    "w1_rolling_scrape_counts",
    with_ci(
        """SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, competitor_id, count(*) AS n FROM (
      SELECT competitor_id, date_trunc('hour', event_at) - INTERVAL (i) HOUR AS s FROM url_events, range(24) r(i)
      WHERE price IS NOT NULL) GROUP BY 1, 2""",
        URL_EVENTS,
    ),
)
def _(spark, sf):
    target, checkpoint = _folders(spark, "scrape-windows")
    seen = fx.url_events(spark, sf, _stream(spark, sf, "events", "ts")).where("price IS NOT NULL")
    flows.stream_recent_scrapes(seen.withColumnRenamed("event_at", "observed_at"), target, checkpoint)
    out = flows.latest_version(spark, target, ["window_start", "window_end", "competitor_id"])
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "competitor_id", "n")


@query(
    "w2_streamed_url_health",
    with_ci(
        """SELECT f.id_product, f.competitor_id, CAST(coalesce(s.price, f.competitor_price) AS DOUBLE) AS competitor_price,
      CAST(coalesce(s.run, f.consecutive_http_failures) AS INTEGER) AS consecutive_http_failures,
      coalesce(s.st, 0) AS last_http_status, coalesce(s.fails, 0) AS failures, coalesce(s.seen, 0) AS observations,
      coalesce(s.dead, false) AS removed, coalesce(s.err, '') AS last_http_error_message
      FROM finals f LEFT JOIN health h USING (id_product, competitor_id)""",
        URL_EVENTS,
        _HEALTH,
    ),
)
def _(spark, sf):
    target, checkpoint = _folders(spark, "url-health")
    finals = fx.finals(spark, sf)
    flows.stream_url_health(fx.url_events(spark, sf, _stream(spark, sf, "events", "event_id")), finals, target, checkpoint)
    out = as_report(flows.health_state(spark, finals, target))
    return out.drop("url", "last_http_error_at").fillna(0, ["last_http_status"]).fillna("", ["last_http_error_message"])


@query("w3_streamed_import", SQL["s6_incremental_import"].replace("AND line_id > 0", ""))
def _(spark, sf):
    target, checkpoint = _folders(spark, "stream-fact")
    lines = fx.invoice_lines(spark, sf, _stream(spark, sf, "lineitem", "l_orderkey"))
    flows.stream_import(lines, _catalogue(spark, sf), target, checkpoint, fx.AS_OF, NOW, version="line_version")
    return _stamps_as_text(fact_store.read_fact(spark, target).drop("invoice_month"))


@query(
    "w4_observation_feed",
    with_ci(
        """SELECT competitor_id, id_product, url, CAST(price AS DOUBLE) AS price, strftime(event_at, '%Y-%m-%d %H:%M:%S') AS observed_at
      FROM url_events WHERE price IS NOT NULL AND id_product > 0""",
        URL_EVENTS,
    ),
)
def _(spark, sf):
    target, checkpoint = _folders(spark, "observations")
    events = fx.url_events(spark, sf, _stream(spark, sf, "events", "event_id"))
    flows.stream_observations(
        events.select("competitor_id", "id_product", "url", "price", F.col("event_at").alias("observed_at")), target, checkpoint
    )
    return as_report(spark.read.parquet(target)).withColumn(
        "observed_at", F.date_format("observed_at", "yyyy-MM-dd HH:mm:ss")
    )


_PARTS = (
    ("cards", "c5_kpi_cards", "label", "current", "previous"),
    ("channels", "c8_channel_summaries", "channel_name", "current", "previous"),
    ("brands", "c12_brand_highlights", "brand_name", "current_global_total", "previous_global_total"),
    ("categories", "c13_category_highlights", "category_name", "current_global_total", "previous_global_total"),
    ("new_goods_channels", "c11_new_goods_channels", "channel_name", "current_total", "previous_total"),
    ("occasion_channels", "c10_occasion_channels", "channel_name", "current_total", "previous_total"),
    ("comparison", "c22_new_vs_occasion", "label", "current_total", "previous_total"),
    ("trend", "c18_aligned_daily_trend", "label", "current", "previous"),
)


@query(
    "c29_home_report",
    " UNION ALL ".join(
        f"SELECT '{section}' AS section, {label} AS label, {cur} AS current, {prev} AS previous FROM ({SQL[name]})"
        for section, name, label, cur, prev in _PARTS
    ),
)
def _(spark, sf):
    return digest(home_report(spark, fx.fact(spark, sf), reporting.STD, reporting.TARGET))
