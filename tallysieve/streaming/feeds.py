"""Streams over postings and events: change feed, digest, windows with late rows and event-time deduplication."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tallysieve.operators.sinks import digest
from tallysieve.schemas import ACTIONABLE

LOOKBACK = "6 hours"
OVERLAP = "60 seconds"


def stream_files(spark: SparkSession, path: str, schema: StructType | str, per_batch: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def timed(rows: DataFrame, column: str, delay: str) -> DataFrame:
    """A watermark on ``column``; a timestamp without zone is read as UTC."""
    return rows.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def deduplicated(rows: DataFrame, key: str, time: str, delay: str = LOOKBACK) -> DataFrame:
    """One row per key within the lookback; state older than that is let go."""
    return timed(rows, time, delay).dropDuplicatesWithinWatermark([key])


def change_feed(rows: DataFrame, time: str = "found_at") -> DataFrame:
    """New actionable search rows, each once although readers overlap."""
    site = ~F.col("id").startswith("gh:") & ~F.col("id").startswith("ats:")
    return deduplicated(rows.where(site & F.col("tier").isin(*ACTIONABLE)), "id", time, OVERLAP)


def windowed_counts(rows: DataFrame, time: str, key: str, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    return timed(rows, time, delay).groupBy(F.window(time, window), key).agg(F.count("*").alias("n"))


def window_sink(folder: str) -> Callable[[DataFrame, int], None]:
    """Each batch's changed windows, in a folder named by its number."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return write


def count_windows(rows: DataFrame, folder: str, time: str, key: str, window: str = "1 hour", delay: str = "10 minutes") -> tuple[int, int]:
    """Count what a stream has of each window and key, on from where it stopped; (rows that arrived, groups dropped as late).

    Windows are written as they change.  A row whose window has ended before the
    watermark is late: it changes nothing and is told by the difference between the
    rows that arrived and those in ``latest_windows``.
    """
    watched = rows.observe("arrivals", F.count(F.lit(1)).alias("rows"))
    query = run_available(windowed_counts(watched, time, key, window, delay), window_sink(f"{folder}/windows"), f"{folder}/offsets", "update")
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    arrived = late = 0
    for progress in query.recentProgress:
        arrived += (progress.observedMetrics["arrivals"]["rows"] or 0) if "arrivals" in progress.observedMetrics else 0
        late += sum(s.numRowsDroppedByWatermark for s in progress.stateOperators)
    return arrived, late


def latest_windows(spark: SparkSession, folder: str) -> DataFrame:
    """(window, key columns, n) of every window as last written."""
    found = spark.read.option("basePath", f"{folder}/windows").parquet(f"{folder}/windows")
    keys = [c for c in found.columns if c not in ("n", "batch")]
    return found.groupBy(*keys).agg(F.max_by("n", "batch").alias("n"))


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there through ``sink`` and stop; offsets are kept after the sink succeeded."""
    return stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def digest_sink(folder: str) -> Callable[[DataFrame, int], None]:
    """One digest per batch that has rows; a failed write is tried again with the same rows."""

    def write(batch: DataFrame, number: int) -> None:
        digest(batch).where("n > 0").write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return write


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder for a stream's own files, below the session's checkpoint folder."""
    context = spark.sparkContext
    base = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        base = tempfile.mkdtemp(prefix="stream-")
    return f"{base}/{uuid.uuid4().hex}"


def drained_dedup(spark: SparkSession, path: str) -> DataFrame:
    """Events of a stream that delivers the table twice, each once."""
    schema = spark.read.parquet(path).schema
    folder = shared_folder(spark)
    if _is_folder(spark, path):
        source = stream_files(spark, path, schema, 1000)
    else:
        source = spark.readStream.schema(schema).option("pathGlobFilter", os.path.basename(path)).parquet(os.path.dirname(path))
    twice = source.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    once = deduplicated(twice, "event_id", "ts")
    out = f"{folder}/out"
    query = once.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start()
    query.awaitTermination()
    done = spark.read.parquet(out)
    return done.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("n_ids"), F.sum("event_id").alias("sum_ids"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
