"""Incremental import: idempotence, cursor, limits, moved lines, streams."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from retailweave import fixtures as fx
from retailweave.checks.imports import _catalogue
from retailweave.functions import labels as L
from retailweave.operators import aggregates as A
from retailweave.operators.comparisons import report_periods
from retailweave.operators.detail import detail_rows, export_detail_csv, sort_detail
from retailweave.operators.filters import Filters, apply_filters
from retailweave.plans import import_job as job
from retailweave.sources import fact_store
from retailweave.sources.incremental import parse_since, upsert
from retailweave.streaming import flows

EARLY, LATE = dt.datetime(2001, 8, 1, 1), dt.datetime(2001, 8, 2, 2)
STD = Filters(fx.START, fx.END)


def run(spark, sf, target, now=EARLY, **kw):
    return job.import_invoice_lines(
        spark, fx.invoice_lines(spark, sf), _catalogue(spark, sf), str(target), fx.AS_OF, now, version="line_version", **kw
    )


def rows(spark, target):
    return {r["source_line_id"]: r.asDict() for r in fact_store.read_fact(spark, str(target)).collect()}


def test_import_twice_changes_only_the_stamp(spark, sf, tmp_path):
    target = tmp_path / "fact"
    first = run(spark, sf, target)
    before = rows(spark, target)
    assert first["inserted"] == len(before) > 4000
    assert run(spark, sf, target)["inserted"] == 0  # nothing above the cursor
    again = run(spark, sf, target, LATE, since="1990-01-01")
    after = rows(spark, target)
    assert again["inserted"] == len(before) and after.keys() == before.keys()
    for key, row in after.items():
        assert row.pop("updated_at") == LATE and before[key].pop("updated_at") == EARLY
        assert row == before[key]


def test_row_limit_counts_accepted_lines_and_resumes(spark, sf, tmp_path):
    target = tmp_path / "fact"
    lines = fx.invoice_lines(spark, sf).dropDuplicates(["IDLigneFac"]).drop("line_version")
    args = (_catalogue(spark, sf), str(target), fx.AS_OF, EARLY)
    assert job.import_invoice_lines(spark, lines, *args, max_rows=100)["inserted"] == 100
    top = max(rows(spark, target))
    assert job.import_invoice_lines(spark, lines, *args, max_rows=50)["inserted"] == 50
    assert min(k for k in rows(spark, target) if k > top) > top and len(rows(spark, target)) == 150


def test_since_must_be_a_day():
    assert parse_since("") is None
    with pytest.raises(ValueError):
        parse_since("2001-13-01")


def test_line_that_changes_month_leaves_no_copy(spark, tmp_path):
    target = str(tmp_path / "fact")
    empty = fact_store.empty_fact(spark)

    def line(key, day):
        values = {"source_line_id": key, "invoice_date": dt.date.fromisoformat(day), "imported_at": EARLY}
        return spark.createDataFrame([tuple(values.get(f.name) for f in empty.schema)], empty.schema)

    fact_store.upsert_fact(spark, target, line(1, "2001-01-05").union(line(2, "2001-02-05")))
    fact_store.upsert_fact(spark, target, line(1, "2001-02-07"))
    got = fact_store.read_fact(spark, target).select("source_line_id", "invoice_month").collect()
    assert sorted(map(tuple, got)) == [(1, "2001-02"), (2, "2001-02")]


def fact_line(spark, key, day, name="x"):
    empty = fact_store.empty_fact(spark)
    values = {"source_line_id": key, "invoice_date": dt.date.fromisoformat(day), "imported_at": EARLY, "product_name": name}
    return spark.createDataFrame([tuple(values.get(f.name) for f in empty.schema)], empty.schema)


def test_new_lines_leave_old_files_in_place(spark, tmp_path):
    target = tmp_path / "fact"
    fact_store.upsert_fact(spark, str(target), fact_line(spark, 1, "2001-01-05").union(fact_line(spark, 2, "2001-02-05")))
    before = {p: p.stat().st_mtime_ns for p in target.rglob("part-*") if "_cursor" not in str(p)}
    fact_store.upsert_fact(spark, str(target), fact_line(spark, 3, "2001-02-06").union(fact_line(spark, 4, "2001-03-06")))
    after = {p: p.stat().st_mtime_ns for p in target.rglob("part-*") if "_cursor" not in str(p)}
    assert before.items() <= after.items() and len(after) > len(before)
    assert sorted(rows(spark, target)) == [1, 2, 3, 4]


def test_run_lost_before_the_cursor_moved_is_repeated_without_copies(spark, tmp_path, monkeypatch):
    target = str(tmp_path / "fact")
    fact_store.upsert_fact(spark, target, fact_line(spark, 1, "2001-01-05"))
    with monkeypatch.context() as patch:
        patch.setattr(fact_store, "_advance_cursor", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            fact_store.upsert_fact(spark, target, fact_line(spark, 2, "2001-01-06"))
    assert fact_store.cursor(spark, target) == 1
    fact_store.upsert_fact(spark, target, fact_line(spark, 2, "2001-01-06", "y").union(fact_line(spark, 3, "2001-01-07")))
    got = fact_store.read_fact(spark, target).select("source_line_id", "product_name").collect()
    assert sorted(map(tuple, got)) == [(1, "x"), (2, "y"), (3, "x")]


def test_upsert_keeps_chosen_columns(spark):
    old = spark.createDataFrame([(1, "a", "t0"), (2, "b", "t0")], "k int, v string, at string")
    new = spark.createDataFrame([(2, "B", "t1"), (3, "C", "t1")], "k int, v string, at string")
    got = sorted(map(tuple, upsert(old, new, ["k"], ["at"]).collect()))
    assert got == [(1, "a", "t0"), (2, "B", "t0"), (3, "C", "t1")]


def test_stream_equals_batch(spark, sf, tmp_path):
    target, streamed = tmp_path / "batch", tmp_path / "stream"
    run(spark, sf, target)
    source = tmp_path / "lines"
    lineitem = fx.table(spark, sf, "lineitem")
    lineitem.repartitionByRange(3, "l_shipdate").sortWithinPartitions("l_shipdate").write.parquet(str(source))
    stream = flows.read_stream(spark, str(source), lineitem.schema)
    flows.stream_import(
        fx.invoice_lines(spark, sf, stream), _catalogue(spark, sf), str(streamed), str(tmp_path / "cp"), fx.AS_OF, EARLY, "line_version"
    )
    assert rows(spark, streamed) == rows(spark, target)


def test_mapped_fact_agrees_with_the_direct_adapter(spark, sf):
    mapped = job.fact_rows(fx.invoice_lines(spark, sf), _catalogue(spark, sf), fx.AS_OF, EARLY, version="line_version")
    keys = ["source_line_id", "invoice_number", "invoice_date", "product_code", "channel_name", "total_ht", "margin_ht", "quantity"]
    direct = fx.fact(spark, sf).select(*keys)
    assert mapped.select(*keys).exceptAll(direct).isEmpty() and direct.exceptAll(mapped.select(*keys)).isEmpty()


def test_lines_are_ranked_without_article_texts(spark, sf):
    mapped = job.fact_rows(fx.invoice_lines(spark, sf), _catalogue(spark, sf), fx.AS_OF, EARLY, version="line_version")
    plan = mapped._jdf.queryExecution().optimizedPlan().toString()
    assert "article_name" not in plan[plan.index("Window [") :].split("Relation")[0] and plan.index("Join LeftOuter") < plan.index("Window [")


def test_a_trade_in_neither_replaces_a_line_nor_counts(spark, sf):
    catalogue = _catalogue(spark, sf)
    both = fx.articles(spark, sf).groupBy().agg(
        F.min(F.when(F.col("REF_FOU").startswith("REPRISE"), F.col("IDART"))), F.min(F.when(F.col("REF_FOU").startswith("REF-"), F.col("IDART")))
    ).first()
    line = fx.invoice_lines(spark, sf).where("Q_FAC <> 0").limit(1)
    first = line.withColumns({"IDART": F.lit(both[1]), "v": F.lit(1)})
    later = line.withColumns({"IDART": F.lit(both[0]), "v": F.lit(2)})
    for max_rows in (None, 1):
        got = job.fact_rows(first.unionByName(later), catalogue, fx.AS_OF, EARLY, max_rows=max_rows, version="v").collect()
        assert [r["product_id"] for r in got] == [both[1]]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_merge_moves_its_batch_by_product_alone(spark, sf, tmp_path, monkeypatch):
    """The batch is narrow and lies by line id; whole rows are made where they are written."""
    target, seen = tmp_path / "fact", []
    run(spark, sf, target, since="2001-01-01")
    write, merge = fact_store._write, fact_store._merge
    monkeypatch.setattr(fact_store, "_write", lambda df, *a, **kw: (seen.append(plan_of(df)), write(df, *a, **kw)))
    monkeypatch.setattr(fact_store, "_merge", lambda spark, path, batch, *a: (seen.append(batch.columns), merge(spark, path, batch, *a)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        run(spark, sf, target, LATE, since="1990-01-01")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    columns, plan = seen
    assert not {"product_name", "rayon_name", "supplier_reference"} & set(columns)
    assert "Bucketed: true" in plan and "FullOuter" not in plan and "REPARTITION" not in plan
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(source_line_id" in line]
    assert len(moved) == 1  # the store's ids and stamps


def test_a_later_import_keeps_first_stamps_and_the_lines_it_does_not_hold(spark, sf, tmp_path):
    target = tmp_path / "fact"
    run(spark, sf, target)
    before = rows(spark, target)
    run(spark, sf, target, LATE, since="2001-07-15")  # half a month of lines
    after = rows(spark, target)
    assert after.keys() == before.keys()
    new = {k for k, row in after.items() if row["updated_at"] == LATE}
    assert new == {k for k, row in before.items() if row["invoice_date"] >= dt.date(2001, 7, 15)}
    assert any(row["invoice_month"] == "2001-07" and row["updated_at"] == EARLY for row in after.values())
    assert all({**row, "updated_at": EARLY} == before[key] for key, row in after.items())


def test_an_import_leaves_no_batch_table_and_no_setting(spark, sf, tmp_path):
    names = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.files.maxPartitionBytes")
    before = [spark.conf.get(n, None) for n in names]
    fact_store.upsert_fact(spark, str(tmp_path / "fact"), fact_line(spark, 1, "2001-01-05"))
    run(spark, sf, tmp_path / "other", since="2001-07-01")
    assert [spark.conf.get(n, None) for n in names] == before
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("fact_batch")]


def test_totals_agree_across_breakdowns(spark, sf):
    fact = fx.fact(spark, sf, report_periods(STD)).cache()
    total = A.period_summary(fact, STD).first()
    parts = [A.goods_totals(fact, STD, occ).first() for occ in (True, False)]
    assert sum(p["line_count"] for p in parts) == total["line_count"]
    assert sum(p["total_ht"] for p in parts) == pytest.approx(total["total_ht"])
    for table in (
        A.channel_totals(fact, STD),
        A.grouped_detail(fact, STD, "brand"),
        A.grouped_detail(fact, STD, "category"),
        A.daily_totals(fact, STD),
    ):
        assert table.agg(F.sum("total_ht")).first()[0] == pytest.approx(total["total_ht"])
    empty = A.period_summary(fact, Filters(dt.date(1980, 1, 1), dt.date(1980, 1, 2))).first()
    assert tuple(empty) == (0.0, 0.0, 0, 0, 0.0) or set(empty) == {0}
    fact.unpersist()


def test_sort_is_total_and_csv_is_written(spark, sf, tmp_path):
    fact = fx.fact(spark, sf)
    got = [(r["brand_name"], r["source_line_id"]) for r in sort_detail(detail_rows(apply_filters(fact, STD)), "brand_name", "asc").collect()]
    assert got == sorted(got)
    path = str(tmp_path / "csv")
    export_detail_csv(fact, STD, path, "total_ht", "desc")
    back = spark.read.csv(path, header=True)
    assert back.columns[:3] == ["Date", "Facture", "Canal"] and back.count() == len(got)
    assert {r[0] for r in back.select("Occasion").distinct().collect()} <= {"oui", "non"}


def test_distinct_invoices_are_counted_once_per_group(spark):
    day = dt.date(2001, 7, 2)
    row = dict(invoice_date=day, product_id=1, supplier_reference="", product_code="", product_name="", channel_name="Web", quantity=1)
    data = [
        {**row, "invoice_number": n, "total_ht": t, "margin_ht": 0.0, "brand_id": b, "brand_name": name}
        for n, t, b, name in [("1", 10.0, 5, ""), ("1", 20.0, 5, "Zed"), ("2", 1.0, 5, "Abc"), (None, 4.0, 5, None)]
    ]
    fact = spark.createDataFrame(data)
    got = A.brand_totals(fact, STD, occasion=False).first()
    assert (got["brand_name"], got["total_ht"], got["invoice_count"]) == ("Abc", 35.0, 2)
    assert fact.select(L.channel()).distinct().count() == 1
