"""First sightings as a stream of their own, which feeds the daily digests' stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .watch import daily_stream

FIRST = "watch_topic_id string, paper_id string, first_us bigint, rank_score double"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups that keys are dealt to by a hash. A group's keys are one table of the state, so that a batch costs a few calls a group, not some for each key.
GROUPS = 1024
KEY = ["watch_topic_id", "paper_id"]


def _table(raw: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(raw).read_pandas()


def _raw(table: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    rows = pa.Table.from_pandas(table, preserve_index=False)
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


class FirstSightings(StatefulProcessor):
    """Each key's first sighting, told once, when the watermark says that no earlier one can come; times are microseconds.

    The state is the table of a group's keys (KEY, first_us, rank_score, told), and a timer at the first of them that isn't told.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("keys", "rows binary, due bigint")

    def _keep(self, held: pd.DataFrame, before: int | None) -> None:
        """``due``: the timer that is set, in milliseconds."""
        open_ = held.loc[~held["told"], "first_us"]
        due = None if open_.empty else int(open_.min()) // 1000 + 1
        if due != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if due is not None:
                self.handle.registerTimer(due)
        self.state.update((_raw(held), due))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        parts, due = [], None
        if self.state.exists():
            raw, due = self.state.get()
            parts.append(_table(raw))
        for batch in rows:
            parts.append(pd.DataFrame({**{c: batch[c] for c in KEY}, "first_us": batch["seen_us"].astype("int64"), "rank_score": batch["rank_score"].astype("float64"), "told": False}))
        # what is told stays as it is; else the earliest counts, and of those the best
        both = pd.concat(parts, ignore_index=True).sort_values(["told", "first_us", "rank_score"], ascending=[False, True, False], kind="stable")
        self._keep(both.drop_duplicates(KEY), due)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        raw, due = self.state.get()
        held, now = _table(raw), expiredTimerInfo.getExpiryTimeInMs()
        at = held["first_us"] // 1000 + 1
        tell = ~held["told"] & ((at <= now) | (at < timerValues.getCurrentWatermarkInMs()))
        out = held.loc[tell, [*KEY, "first_us", "rank_score"]].reset_index(drop=True)
        held.loc[tell, "told"] = True
        self._keep(held, None if due == now else due)
        if len(out):
            yield out

    def close(self) -> None:
        pass


def first_sightings(sightings: DataFrame, lateness: str) -> DataFrame:
    """A stream with one row for each (topic, paper): its first sighting and the best rank there, whatever batches its sightings came in.

    Rows that are later than ``lateness`` are left out, as are those without a finite rank. Needs the RocksDB state store.
    """
    finite = F.col("rank_score").isNotNull() & ~F.isnan("rank_score") & (F.abs("rank_score") != float("inf"))
    rows = sightings.where(finite & F.col("seen_at").isNotNull()).withColumn("seen_us", F.unix_micros("seen_at")).withWatermark("seen_at", lateness)
    rows = rows.withColumn("group", F.pmod(F.xxhash64(*KEY), F.lit(GROUPS)))
    return rows.groupBy("group").transformWithStateInPandas(FirstSightings(), outputStructType=FIRST, outputMode="Append", timeMode="EventTime")


def run_daily(sightings: DataFrame, folder: str, lateness: str, end: str, window: str = "1 day") -> DataFrame:
    """(period_start, topic, items, highest_rank) of all available sightings, by two chained streams; ``folder`` holds their states and tables.

    The first stream's rows become files, batch by batch; a batch that is run again writes the same ones again. They come in the order of
    first sightings, so the second one, with windows in append mode, needs no lateness. ``end`` is a time beyond all
    windows: a last row of no topic at it closes them.
    """
    spark = sightings.sparkSession
    with_rocks(spark)
    first = first_sightings(sightings, lateness).writeStream.outputMode("append").option("checkpointLocation", f"{folder}/first-state").trigger(availableNow=True)
    first.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/first/batch={n}")).start().awaitTermination()
    last = spark.range(1).select(F.lit("").alias("watch_topic_id"), F.lit("").alias("paper_id"), F.unix_micros(F.lit(end).cast("timestamp")).alias("first_us"), F.lit(0.0).alias("rank_score"))
    last.write.mode("overwrite").parquet(f"{folder}/first/batch=last")
    rows = spark.readStream.schema(FIRST).option("recursiveFileLookup", "true").parquet(f"{folder}/first").withColumn("first_seen_at", F.timestamp_micros("first_us"))
    daily = daily_stream(rows, window, "0 seconds").writeStream.outputMode("append").option("checkpointLocation", f"{folder}/daily-state").trigger(availableNow=True)
    daily.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/daily/batch={n}")).start().awaitTermination()
    out = spark.read.schema("period_start timestamp, watch_topic_id string, items bigint, highest_rank double").option("recursiveFileLookup", "true").parquet(f"{folder}/daily")
    return out.where("watch_topic_id <> ''")


def with_rocks(spark: SparkSession) -> None:
    """The state store that keyed state with timers needs."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKS:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
