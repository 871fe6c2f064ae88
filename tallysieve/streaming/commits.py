"""Newest commits of lists as keyed state: a list is told when its commit changes, once."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tallysieve.sources.lists import latest_commit
from tallysieve.streaming.outages import with_keyed_state

LANDED = "source_name string, feed string, landing int"
_COMMIT = "source_name string, commit string, previous string"


class NewCommits(StatefulProcessor):
    """Landed commits of one list in, its newest out if it is not the one told last."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.told = handle.getValueState("told", "commit string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        commit = max(rows, key=lambda r: r["landing"])["commit"]
        previous = self.told.get()[0] if self.told.exists() else None
        if commit != previous:
            self.told.update((commit,))
            yield Row(source_name=key[0], commit=commit, previous=previous)

    def close(self) -> None:
        pass


def new_commits(landed: DataFrame) -> DataFrame:
    """(source_name, commit, previous) of a stream of feeds (source_name, feed, landing) whose newest commit is new.

    ``landing`` numbers a list's landings in order; of several in one batch the last
    counts.  A feed without a commit changes nothing.
    """
    with_keyed_state(landed.sparkSession)
    now = landed.select("source_name", latest_commit(F.col("feed")).alias("commit"), "landing").where("source_name IS NOT NULL AND commit IS NOT NULL")
    return now.groupBy("source_name").transformWithState(NewCommits(), _COMMIT, "append", "None")
