"""Streaming forms: observation feed, rolling counts, url health and line import.

Sinks are folders written once per micro-batch under the batch id, so a replayed batch overwrites itself. Keyed
results are read back as the latest version per key.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.reviews import GONE_AFTER, HEALTH_COLUMNS, url_health
from ..plans.import_job import Catalogue, merge_lines
from ..session import hadoop_path, path_exists, remove_path
from ..sources.incremental import ensure_columns, latest_per_key
from ..sources.observations import valid_observations

BATCH = "stream_batch"


def _versioned(stream: DataFrame, target: str, checkpoint: str, mode: str):
    """Writes each micro-batch to its own folder and runs what is available to the end."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target.rstrip('/')}/{BATCH}={batch_id}")

    query = (
        stream.writeStream.foreachBatch(write)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def latest_version(spark: SparkSession, target: str, keys: list[str]) -> DataFrame:
    rows = spark.read.parquet(target)
    return latest_per_key(rows, keys, [F.col(BATCH).desc()]).drop(BATCH)


# --- observation feed ---------------------------------------------------------------------------------


def stream_observations(observations: DataFrame, target: str, checkpoint: str) -> None:
    """Accepted price observations appended to the history folder, exactly once."""
    query = (
        valid_observations(observations)
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


# --- rolling counts -----------------------------------------------------------------------------------


def scrape_windows(history: DataFrame, hours: int = 24, slide_hours: int = 1) -> DataFrame:
    """Observations per competitor in sliding windows; the same plan in batch and stream."""
    window = F.window("observed_at", f"{hours} hours", f"{slide_hours} hours")
    return history.groupBy(window.alias("w"), "competitor_id").agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "competitor_id", "n"
    )


def stream_recent_scrapes(
    history: DataFrame, target: str, checkpoint: str, late: str = "2 days", hours: int = 24, slide_hours: int = 1
) -> None:
    """Window counts as they grow; observations later than `late` are dropped and closed windows forgotten."""
    stamped = history.withColumn("observed_at", F.col("observed_at").cast("timestamp"))  # what watermarks need
    counts = scrape_windows(stamped.withWatermark("observed_at", late), hours, slide_hours)
    _versioned(counts, target, checkpoint, "update")


# --- url health ---------------------------------------------------------------------------------------

PAIR = ["id_product", "competitor_id"]


HEALTH_BUCKETS = 64
_BUCKET = "bucket"


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(*PAIR), F.lit(buckets)).cast("int")


def _generations(spark: SparkSession, target: str) -> dict[int, list[int]]:
    """Micro-batches that have written each bucket, oldest first; at most a few entries a bucket."""
    if not path_exists(spark, target):
        return {}
    root, fs = hadoop_path(spark, target)
    found: dict[int, list[int]] = {}
    for folder in fs.listStatus(root):
        if folder.getPath().getName().startswith(f"{_BUCKET}="):
            number = int(folder.getPath().getName().split("=")[1])
            names = [x.getPath().getName() for x in fs.listStatus(folder.getPath())]
            found[number] = sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{BATCH}="))
    return found


def _folder(target: str, bucket: int, batch: int) -> str:
    return f"{target.rstrip('/')}/{_BUCKET}={bucket}/{BATCH}={batch}"


def health_state(
    spark: SparkSession,
    finals: DataFrame,
    target: str,
    before: int | None = None,
    only: list[int] | None = None,
    buckets: int = HEALTH_BUCKETS,
) -> DataFrame:
    """Current health of every final url: the newest state of its bucket (before a micro-batch), else the stored row."""
    columns = [*PAIR, *HEALTH_COLUMNS, "observations", "failures", "removed"]
    stored = ensure_columns(finals, {"last_http_error_at": "timestamp", "last_http_error_message": "string"})
    stored = stored.withColumns(
        {"observations": F.lit(0).cast("bigint"), "failures": F.lit(0).cast("bigint"), "removed": F.lit(False)}
    )
    newest = {
        b: max(g for g in known if before is None or g < before)
        for b, known in _generations(spark, target).items()
        if any(before is None or g < before for g in known)
    }
    own = _bucket(buckets)
    stored = stored.where(~own.isin(*newest)) if newest else stored
    stored = stored if only is None else stored.where(own.isin(*only))
    stored = stored.select(*columns)
    paths = [_folder(target, b, g) for b, g in newest.items() if only is None or b in only]
    return stored.unionByName(spark.read.schema(stored.schema).parquet(*paths)) if paths else stored


def stream_url_health(
    events: DataFrame,
    finals: DataFrame,
    target: str,
    checkpoint: str,
    threshold: int = GONE_AFTER,
    buckets: int = HEALTH_BUCKETS,
) -> None:
    """Consecutive-failure tracking. The state is kept in `buckets` by pair. Each micro-batch takes the state of the
    buckets it touches, runs the batch operator on it and writes their next generation; a removed pair finds nothing
    any more. Only the generation before is kept besides, for a micro-batch that is replayed.

    The batch operator's chunked scans order a pair's events by `seq` and split a busy pair over tasks, which a
    per-key state handler would fold in one.
    """
    finals = ensure_columns(
        finals, {"last_http_error_at": events.schema["event_at"].dataType.simpleString(), "last_http_error_message": "string"}
    )

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        touched = [r[0] for r in batch.select(_bucket(buckets)).distinct().collect()]  # a few numbers
        if not touched:
            return
        known = health_state(spark, finals, target, batch_id, touched, buckets)
        alive = known.where("NOT removed")
        new = url_health(alive.drop("observations", "failures", "removed"), batch, threshold)
        earlier = alive.select(*PAIR, F.col("observations").alias("o"), F.col("failures").alias("f"))
        new = new.join(earlier, PAIR).withColumns({"observations": F.col("observations") + F.col("o"), "failures": F.col("failures") + F.col("f")})
        new = new.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in known.schema])  # the state's own types
        out = new.unionByName(known.where("removed"))
        (
            out.withColumns({_BUCKET: _bucket(buckets), BATCH: F.lit(batch_id)})
            .repartition(_BUCKET)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(_BUCKET, BATCH)
            .parquet(target)
        )
        for bucket, known_batches in _generations(spark, target).items():
            older = [g for g in known_batches if g < batch_id]
            for stale in older[:-1]:
                remove_path(spark, _folder(target, bucket, stale))

    query = (
        events.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


# --- line import --------------------------------------------------------------------------------------


def stream_import(
    lines: DataFrame,
    catalogue: Catalogue,
    target: str,
    checkpoint: str,
    as_of: dt.date,
    imported_at: dt.datetime,
    version: str | None = None,
) -> None:
    """Incremental import: every micro-batch of raw lines is mapped and upserted by line id, so replays change
    nothing."""

    def load(batch: DataFrame, batch_id: int) -> None:
        merge_lines(batch.sparkSession, batch, catalogue, target, as_of, imported_at, version=version)

    query = (
        lines.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


__all__ = [
    "health_state",
    "latest_version",
    "read_stream",
    "scrape_windows",
    "stream_import",
    "stream_observations",
    "stream_recent_scrapes",
    "stream_url_health",
]
