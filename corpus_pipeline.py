"""Corpus pipeline: the training-data operators one after the other over `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet to the shared folder and read
again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailweave.llm import icws, leaks, line_templates, pfair, pu_quality
from retailweave.session import work_path


def _with_text(docs: DataFrame, text) -> DataFrame:
    """The documents with another text, and `n_chars` to go with it."""
    changed = ~F.col("text").eqNullSafe(text)
    return docs.withColumns({"n_chars": F.when(changed, F.length(text).cast("long")).otherwise(F.col("n_chars")), "text": text})


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier scores 0.5 or more."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = pu_quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), usable=~held_out)
    return pu_quality.score(docs, model, result="__score").where("__score >= 0.5").drop("__score")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates stay in their first document only; documents of which too little is left go."""
    cut = line_templates.drop_recurring_lines(docs).where("line_dedup.kept")
    return _with_text(cut, F.col("line_dedup.text")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return icws.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; a document that is nothing else goes."""
    cut = leaks.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return cut.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its place in the mixture: sort by (slot, place)."""
    return pfair.mix_sources(docs, pfair.sqrt_shares(docs))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
]

#: A fitted model and consistent weighted sampling have no SQL form; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        path = work_path(spark, f"pipeline-{number}")
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
