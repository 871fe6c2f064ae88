"""Outage alerts as keyed state: one alert in so many hours, one notice of the end."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ALERT_HOURS = 6
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_NOTICE = "tenant string, at timestamp, notice string, kind string, n long"


def with_keyed_state(spark: SparkSession) -> None:
    """The state store that keyed state of any kind needs; its cost follows a batch's keys, not all keys."""
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _ms(at) -> int:
    return round(at.replace(tzinfo=at.tzinfo or timezone.utc).timestamp() * 1000)


class OutageNotices(StatefulProcessor):
    """Runs of one tenant in, notices out.

    ``announced`` is when the outage was last told, until its end is told.  ``quiet``
    keeps further alerts back; a timer lets it go after the throttle.  ``last`` is the
    newest run seen: a run that is not newer has been delivered before.
    """

    def __init__(self, hours: int = ALERT_HOURS):
        self.throttle = hours * 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.announced = handle.getValueState("announced", "at long")
        self.quiet = handle.getValueState("quiet", "until long")
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last = self.last.get()[0] if self.last.exists() else None
        for run in sorted(rows, key=lambda r: r["ms"]):
            if last is not None and run["ms"] <= last:
                continue
            last = run["ms"]
            self.last.update((last,))
            if run["promoted"] and self.announced.exists():
                self.announced.clear()
                self._let_go()
                yield Row(tenant=key[0], at=run["at"], notice="recovery", kind=None, n=run["promoted"])
            hard = run["billing"] + run["auth"]
            if not hard or (self.quiet.exists() and last < self.quiet.get()[0]):
                continue
            self._let_go()
            self.announced.update((last,))
            self.quiet.update((last + self.throttle,))
            self.handle.registerTimer(last + self.throttle)
            yield Row(tenant=key[0], at=run["at"], notice="alert", kind="billing" if run["billing"] else "auth", n=hard)

    def _let_go(self) -> None:
        if self.quiet.exists():
            self.handle.deleteTimer(self.quiet.get()[0])
            self.quiet.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.quiet.clear()
        yield from ()

    def close(self) -> None:
        pass


def outage_notices(runs: DataFrame, delay: str = "1 hour", hours: int = ALERT_HOURS) -> DataFrame:
    """Notices (tenant, at, notice, kind, n) of a stream of runs (tenant, at, billing, auth, promoted).

    billing and auth are how many rows a run parked for those causes; other causes pass
    by themselves and are no outage.  An outage is told once in ``hours``; when rows get
    through, its end is told if it had been told.  A run that comes again, or later than
    ``delay``, changes nothing.  Null counts are none.
    """
    with_keyed_state(runs.sparkSession)
    counts = (F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("billing", "auth", "promoted"))
    timed = runs.where("tenant IS NOT NULL").select("tenant", F.col("at").cast("timestamp").alias("at"), *counts).withWatermark("at", delay)
    timed = timed.withColumn("ms", F.unix_millis("at"))
    return timed.groupBy("tenant").transformWithState(OutageNotices(hours), _NOTICE, "append", "EventTime")
