"""Session helpers: shared working folders, lineage cuts and storage paths."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_own_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach: `spark.checkpoint.dir` of the session.

    Only a local run may leave it unset and gets a folder of its own.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = _own_roots.setdefault(context.applicationId, "") or tempfile.mkdtemp(prefix="retailweave-")
        _own_roots[context.applicationId] = root
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def work_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def hadoop_path(spark: SparkSession, path: str):
    """(path, file system) of a folder on whatever storage it lives."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop, fs = hadoop_path(spark, path)
    return bool(fs.exists(hadoop))


def remove_path(spark: SparkSession, path: str) -> None:
    hadoop, fs = hadoop_path(spark, path)
    fs.delete(hadoop, True)


def written(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder: worked out once, and again from disk if an executor is lost."""
    path = work_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


MAX_SCAN = 32 * 2**20


@contextmanager
def heavy_writes(spark: SparkSession) -> Iterator[None]:
    """Settings for jobs that move and write a large table several times.

    Shuffle files go when their query ends. Else they stay until the driver happens to collect the garbage of its plans, and
    the job holds the files of all its queries at once. A task scans at most 32 MB: written rows unfold tenfold, and a
    task that sorts them should not spill.
    """
    scan = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    settings = {
        "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
        "spark.sql.files.maxPartitionBytes": str(min(scan, MAX_SCAN)),
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


# Of tables that only this library reads again: ids are written as differences.
SCRATCH = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0"}


@contextmanager
def in_buckets(spark: SparkSession, df: DataFrame, label: str, key: str) -> Iterator[DataFrame]:
    """The rows as a written table in buckets of `key`, which joins on the key read in place instead of moving it.

    The table and its folder go at the end. Rows that lie by the key already give one file a bucket.
    """
    path = work_path(spark, label)
    name = f"spark_catalog.default.{path.rsplit('/', 1)[1].replace('-', '_')}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        df.write.options(**SCRATCH, path=path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove_path(spark, path)


def shuffled(df: DataFrame) -> DataFrame:
    """The rows as a side of a join that moves by key. Spark's size check takes the compressed bytes of a table for its
    size, so it would send rows many times larger than its limit through the driver."""
    return df.hint("merge")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt over all cores by key, for work that costs much a row: a small file comes in one task or a few."""
    return df.repartition(*keys)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)
