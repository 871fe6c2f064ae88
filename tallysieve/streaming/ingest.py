"""Ingest of listings whose cost follows the batch, not the store.

What the store holds is kept as keyed state: one mark for each id and one for each
norm_key.  The marks come from the store itself, read as a second stream: what one batch
has stored is marked before the next batch's arrivals are looked at.  So a row is new if
the store has neither its id nor its norm_key, exactly, and no batch reads what earlier
ones have written but for the last.

Each batch writes folders named by its number, so a batch that runs again replaces what it
wrote.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tallysieve.operators.dedup import greedy_dedup
from tallysieve.operators.sinks import notices
from tallysieve.streaming.outages import with_keyed_state

ID, KEY = "i:", "k:"


class StoredMarks(StatefulProcessor):
    """Lets arrivals of keys through that the store has not.

    A key's marks come before its arrivals count: rows are held until all of the key's
    rows of the batch are in, for an id; of a norm_key only whether it came is held.
    """

    def __init__(self, forget_after_ms: int | None):
        self.forget_after = forget_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stored = handle.getValueState("stored", "yes boolean", self.forget_after)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        stored, held = self.stored.exists(), []
        for row in rows:
            if row["payload"] is None and not row["arrived"]:
                self.stored.update((True,))
                stored = True
            elif not stored and (row["payload"] is not None or not held):
                held.append(row)
        if stored:
            if self.forget_after is not None:
                # Seen again: it is remembered for as long once more.
                self.stored.update((True,))
            return
        for row in held:
            yield Row(key=key[0], payload=row["payload"])

    def close(self) -> None:
        pass


def keyed_rows(arrivals: DataFrame) -> DataFrame:
    """A row for an arrival's id, with all of its columns, and one for its norm_key."""
    whole = F.struct(*arrivals.columns)
    none = F.lit(None).cast(arrivals.select(whole.alias("p")).schema["p"].dataType)
    by_id = F.struct(F.concat(F.lit(ID), "id").alias("key"), whole.alias("payload"))
    by_key = F.struct(F.concat(F.lit(KEY), "norm_key").alias("key"), none.alias("payload"))
    return arrivals.where("id IS NOT NULL").select(F.explode(F.filter(F.array(by_id, by_key), lambda x: x["key"].isNotNull())).alias("x")).select("x.*", F.lit(True).alias("arrived"))


def stored_rows(stored: DataFrame, like: DataFrame) -> DataFrame:
    """The marks of stored rows (id, norm_key)."""
    keys = F.array(F.concat(F.lit(ID), "id"), F.concat(F.lit(KEY), "norm_key"))
    return stored.select(F.explode(F.array_compact(keys)).alias("key"), F.lit(None).cast(like.schema["payload"].dataType).alias("payload"), F.lit(False).alias("arrived"))


def new_rows(passed: DataFrame) -> DataFrame:
    """Arrivals both of whose keys passed; a null norm_key passes."""
    rows = passed.where("payload IS NOT NULL").select("payload.*")
    keys = passed.where(F.col("key").startswith(KEY)).select(F.substring("key", 3, 1 << 30).alias("norm_key")).distinct()
    return rows.join(keys, "norm_key", "left_semi").select(rows.columns).unionByName(rows.where("norm_key IS NULL"))


def _sink(store: str, outbox: str, order: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        # A batch of marks alone must not give the store a file, which would be one more batch.
        if batch.where("payload IS NOT NULL").count():
            folder = f"{store}/batch={number}"
            fresh = greedy_dedup(new_rows(batch), order)
            fresh.write.mode("overwrite").parquet(folder)
            stored = batch.sparkSession.read.schema(fresh.schema).parquet(folder)
            notices(stored).write.mode("overwrite").parquet(f"{outbox}/batch={number}")
        batch.unpersist()

    return write


def made(spark: SparkSession, folder: str) -> str:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    return folder


def ingest(arrivals: DataFrame, store: str, outbox: str, checkpoint: str, *, order: str = "seq", forget_after: int | None = None) -> StreamingQuery:
    """Start a stream that stores arrivals the store lacks, first come first kept, and then writes their notices.

    ``arrivals`` has id, norm_key and ``order``; within a batch rows are taken in that
    order (``greedy_dedup``).  ``forget_after`` seconds after a key was last seen, its
    mark may go, which bounds the state; without it the store is remembered for good.
    Each batch's number of arrivals is in the query's progress as ``arrivals``.
    ``processAllAvailable`` brings the stream to rest, but not with ``forget_after``, which
    keeps it looking for marks to forget.
    """
    spark = arrivals.sparkSession
    with_keyed_state(spark)
    keyed = keyed_rows(arrivals.observe("arrivals", F.count(F.lit(1)).alias("total_raw")))
    stored = spark.readStream.schema("id string, norm_key string, batch int").parquet(made(spark, store))
    marks = StoredMarks(None if forget_after is None else forget_after * 1000)
    mode = "None" if forget_after is None else "ProcessingTime"
    out = f"key string, payload {keyed.schema['payload'].dataType.simpleString()}"
    passed = keyed.unionByName(stored_rows(stored, keyed)).groupBy("key").transformWithState(marks, out, "append", mode)
    return passed.writeStream.outputMode("append").foreachBatch(_sink(store, outbox, order)).option("checkpointLocation", checkpoint).start()
