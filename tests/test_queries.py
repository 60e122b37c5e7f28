"""Every registered query against its reference SQL on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import check
from retailweave import fixtures as fx
from retailweave.operators import comparisons as C
from retailweave.operators import feed as W
from retailweave.operators.filters import Filters

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf, name):
    verdict = check.compare(spark, con, sf, name, QUERIES[name], SQL.get(name))
    assert verdict.startswith(("ok", "rows-only")), verdict
    assert "TYPES" not in verdict, verdict


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 5


def test_alerts_build_the_fact_once(spark):
    """The three lists read one written table of their periods, not the star tables again."""
    fact = fx.fact(spark, "/root/testdata/sf0.001")
    files = C.alerts(fact, Filters(fx.START, fx.END)).inputFiles()
    assert files and all("alert-base" in f for f in files)


def test_snapshots_send_no_growing_table_through_the_driver(spark):
    """Products, paths and images meet by key: the plan holds no broadcast."""
    rows = spark.range(1, 9).select(F.col("id").alias("id_product"))
    feed = rows.select("id_product", *[F.lit("x").alias(c) for c in ("reference", "ean13", "manufacturer_name", "product_name")], F.lit(1).alias("price_tax_incl"))
    products, images = rows.withColumn("id_category_default", F.col("id_product")), rows.withColumn("id_image", F.col("id_product"))
    paths = rows.select(F.col("id_product").alias("id_category"), F.lit("a").alias("category_path"))
    out = W.product_snapshots(feed, products, paths, images, "https://shop.example.com")
    assert out.count() == 8 and "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
