"""The watch and digest jobs as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.watch import first_and_last

SIGHTING = "watch_topic_id string, paper_id string, rank_score double, seen_at timestamp"
DISCOVERY = "watch_topic_id string, paper_id string, first_seen_at timestamp, last_seen_at timestamp, rank_score double, is_new boolean"


class Discoveries(StatefulProcessor):
    """First and last sighting and best rank of a key; each batch's change is emitted, ``is_new`` once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("seen", "first_seen_at timestamp, last_seen_at timestamp, rank_score double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self.state.get() if self.state.exists() else None
        first, last, rank = known if known else (None, None, None)
        for batch in rows:
            seen, ranks = batch["seen_at"], batch["rank_score"]
            first = seen.min() if first is None else min(pd.Timestamp(first), seen.min())
            last = seen.max() if last is None else max(pd.Timestamp(last), seen.max())
            rank = float(ranks.max() if rank is None else max(rank, ranks.max()))
        self.state.update((pd.Timestamp(first).to_pydatetime(), pd.Timestamp(last).to_pydatetime(), rank))
        yield pd.DataFrame({"watch_topic_id": [key[0]], "paper_id": [key[1]], "first_seen_at": [first], "last_seen_at": [last], "rank_score": [rank], "is_new": [known is None]})

    def close(self) -> None:
        pass


def new_discoveries(sightings: DataFrame) -> DataFrame:
    """A stream of changes by key with ``is_new``; needs the RocksDB state store. Rows with no finite rank are left out."""
    finite = F.col("rank_score").isNotNull() & ~F.isnan("rank_score") & (F.abs("rank_score") != float("inf"))
    return sightings.where(finite).groupBy("watch_topic_id", "paper_id").transformWithStateInPandas(Discoveries(), outputStructType=DISCOVERY, outputMode="Update", timeMode="None")


def run_tracking(sightings: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> None:
    """All available sightings into keyed state; each batch's updated keys go to ``sink``, at least once."""
    finite = F.col("rank_score").isNotNull() & ~F.isnan("rank_score")
    query = first_and_last(sightings.where(finite)).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()


def latest(updates: DataFrame) -> DataFrame:
    """The state of each key after all its updates: states only grow, so the widest is the last."""
    return updates.groupBy("watch_topic_id", "paper_id").agg(F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"), F.max("rank_score").alias("rank_score"))


def daily_stream(first_seen: DataFrame, window: str = "1 day", lateness: str = "7 days") -> DataFrame:
    """First sightings by tumbling window, each window emitted when its lateness is over."""
    rows = first_seen.withWatermark("first_seen_at", lateness).groupBy(F.window("first_seen_at", window).alias("w"), "watch_topic_id").agg(F.count("*").alias("items"), F.max("rank_score").alias("highest_rank"))
    return rows.select(F.col("w.start").alias("period_start"), "watch_topic_id", "items", "highest_rank")
