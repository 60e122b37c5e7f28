"""The corpus pipeline, stage by stage, against brute force on the smallest tables."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text_operators import components_of, plain_leaks

import __spark_entry__ as entry
import corpus_pipeline
from llm_fixtures import odd_documents
from retailweave.llm import icws, pu_quality
from retailweave.llm.queries import LINES_SQL, MIX_SQL
from retailweave.llm.words import WordHashes, shingles, words


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """What each stage reads, as a folder, and what the last one returns."""
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.write.parquet(f"{folder}/0")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = spark.read.parquet(f"{folder}/{i}")
        stage(spark, docs, sf).write.parquet(f"{folder}/{i + 1}")
    return folder


def read(spark, stages, i):
    return spark.read.parquet(f"{stages}/{i}")


def texts(spark, stages, i):
    return {r["doc_id"]: r["text"] for r in read(spark, stages, i).select("doc_id", "text").collect()}


def by_sql(stages, i, sql):
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{stages}/{i}/*.parquet'")
        return con.execute(sql).fetchall()


def test_columns_and_names(spark, stages):
    columns = read(spark, stages, 0).columns
    assert all(read(spark, stages, i).columns == columns for i in range(1, 5))
    assert read(spark, stages, 5).columns == [*columns, "block", "release", "deadline", "slot", "place"]
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "line dedup", "MinHash near-dedup", "benchmark decontamination", "mixing sources to target weights",
    ]


def test_quality_stage(spark, stages, sf):
    docs, labels = read(spark, stages, 0), spark.read.parquet(f"{sf}/labels.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = pu_quality.train(docs, labels, usable=~held_out)
    rows = docs.select("doc_id", "text").collect()
    scores = model.score(np.array([pu_quality.features((r["text"] or "").encode()) for r in rows]))
    assert set(texts(spark, stages, 1)) == {r["doc_id"] for r, s in zip(rows, scores, strict=True) if s >= 0.5}
    quality = dict(labels.select("doc_id", "quality").collect())
    kept = texts(spark, stages, 1)
    right = [(doc in kept) == bool(q) for doc, q in quality.items()]
    assert np.mean(right) > 0.95


def test_line_stage(spark, stages):
    want = {r[0]: r[3] for r in by_sql(stages, 1, LINES_SQL) if r[4]}
    assert texts(spark, stages, 2) == want
    assert read(spark, stages, 2).where("n_chars <> length(text)").count() == 0


def test_near_stage(spark, stages):
    rows = sorted(texts(spark, stages, 2).items())
    hashes = WordHashes()
    sets = [np.unique(shingles(hashes.of(words((t or "").encode())), 5)) for _, t in rows]
    families = {int(s.min()): i for i, s in reversed(list(enumerate(sets))) if len(s)}
    sketch = np.zeros(icws.SKETCH_ROWS << icws.SKETCH_BITS)
    for i in families.values():
        for cells in icws._cells(sets[i]):
            np.add.at(sketch, cells, 1)
    idf = icws.Idf(sketch, len(families))
    weighted = [icws.weighted_set((t or "").encode(), hashes, idf) for _, t in rows]
    links = [
        (a, b)
        for a in range(len(rows))
        for b in range(a + 1, len(rows))
        if len(sets[a]) and icws.weighted_jaccard(weighted[a], weighted[b]) >= icws.SIMILARITY
    ]
    kept = {rows[i][0] for i in set(components_of(len(rows), links))}
    assert set(texts(spark, stages, 3)) == kept


def test_leak_stage(spark, stages, sf):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    before, after = texts(spark, stages, 3), texts(spark, stages, 4)
    hit = 0
    for doc, text in before.items():
        if plain_leaks(text, items)[1] == 0:
            assert after[doc] == text
        else:
            hit += 1
            assert doc not in after or plain_leaks(after[doc], items)[1] == 0
    assert set(after) <= set(before)


def test_mixing_stage(spark, stages):
    want = by_sql(stages, 4, f"SELECT doc_id, block, release, deadline, slot, place FROM ({MIX_SQL}) ORDER BY 1")
    got = read(spark, stages, 5).select("doc_id", "block", "release", "deadline", "slot", "place").orderBy("doc_id")
    assert [tuple(r) for r in got.collect()] == want


def test_run_gives_the_last_stage(spark, stages, sf):
    got = sorted(map(tuple, entry.queries()["pipeline"](spark, sf).select("doc_id", "slot", "place").collect()))
    assert got == sorted(map(tuple, read(spark, stages, 5).select("doc_id", "slot", "place").collect()))


def test_stages_take_odd_documents(spark, sf):
    docs = odd_documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf).count() == 0
