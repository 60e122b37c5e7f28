"""The home report: every section for one filter set, on one shared base."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import aggregates as A
from ..operators import comparisons as C
from ..operators.filters import Filters, apply_filters
from ..session import work_path

BASE_COLUMNS = (
    "invoice_date", "invoice_number", "product_id", "product_code", "product_name", "rayon_name", "family_name",
    "subfamily_name", "brand_id", "brand_name", "supplier_reference", "channel_name", "quantity", "total_ht", "margin_ht",
)


class HomeReport(Mapping):
    """Sections by name over one base. A section's plan is built when it is first asked for."""

    def __init__(self, base: DataFrame, builders: dict[str, Callable[[], DataFrame]]):
        self.base = base
        self._builders = builders
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._builders[name]()
        return self._built[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)


def report_base(fact: DataFrame, filters: Filters) -> DataFrame:
    """The rows of all report periods that pass the filters, with the report's columns only."""
    return apply_filters(fact, filters, C.home_periods(filters)).select(*BASE_COLUMNS)


def home_report(
    spark: SparkSession, fact: DataFrame, filters: Filters, target: float = 0.0, materialize: bool = True
) -> HomeReport:
    """All sections. The fact is scanned once into the base, a narrow table in the shared folder that outlives lost
    executors; the number of scans of the base does not grow with periods, channels, brands or categories."""
    base = report_base(fact, filters)
    if materialize:
        path = work_path(spark, "home-base")
        base.write.parquet(path)
        base = spark.read.parquet(path)

    def chart(section: str, label: str) -> DataFrame:
        return C.summary_series(report[section], label, "current_global_total", report["summary"].select("total_ht"))

    builders = {
        "summary": lambda: A.period_summary(base, filters),
        "objective": lambda: C.objective_summary(base, filters, target),
        "cards": lambda: C.kpi_cards(base, filters, target),
        "new_goods": lambda: C.goods_summary(base, filters, occasion=False),
        "new_goods_channels": lambda: C.goods_channel_summaries(base, filters, occasion=False),
        "occasion": lambda: C.goods_summary(base, filters, occasion=True),
        "occasion_channels": lambda: C.goods_channel_summaries(base, filters, occasion=True),
        "comparison": lambda: C.goods_comparison(base, filters),
        "all_brands": lambda: C.brand_highlights(base, filters),
        "brands": lambda: C.exclude_brands(report["all_brands"]),
        "brand_channels": lambda: C.channel_breakdown(base, filters, {"brand_id": L.brand_key()}),
        "brand_chart": lambda: chart("brands", "brand_name"),
        "categories": lambda: C.category_highlights(base, filters),
        "category_channels": lambda: C.channel_breakdown(base, filters, {"category_name": L.category_path()}),
        "category_chart": lambda: chart("categories", "category_name"),
        "channels": lambda: C.channel_summaries(base, filters),
        "channel_shares": lambda: C.channel_shares(base, filters),
        "channel_brands": lambda: C.channel_highlights(base, filters),
        "trend": lambda: C.aligned_trend(base, filters, spark),
        "alerts": lambda: C.alerts(base, filters),
        "filter_options": lambda: A.filter_options(fact),
    }
    report = HomeReport(base, builders)
    return report


def digest(report: HomeReport) -> DataFrame:
    """The comparable figures of the main sections in one table: section, label, current, previous."""

    def part(section: str, label: str, current: str, previous: str) -> DataFrame:
        return report[section].select(
            F.lit(section).alias("section"),
            F.col(label).cast("string").alias("label"),
            F.col(current).cast("double").alias("current"),
            F.col(previous).cast("double").alias("previous"),
        )

    parts = [
        part("cards", "label", "current", "previous"),
        part("channels", "channel_name", "current", "previous"),
        part("brands", "brand_name", "current_global_total", "previous_global_total"),
        part("categories", "category_name", "current_global_total", "previous_global_total"),
        part("new_goods_channels", "channel_name", "current_total", "previous_total"),
        part("occasion_channels", "channel_name", "current_total", "previous_total"),
        part("comparison", "label", "current_total", "previous_total"),
        part("trend", "label", "current", "previous"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
