"""Notifications as a stream: each batch is delivered and marked once, however often it is run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.components import cut_lineage
from ..operators.watch import mark_notified, pending_notifications, track_discoveries, valid_sightings
from ..sources.memory import TABLES

DISCOVERIES = TABLES["watch_papers"]


def prepare(spark: SparkSession, folder: str) -> None:
    """An empty snapshot and its commit, unless they are there."""
    spark.createDataFrame([], DISCOVERIES).write.mode("ignore").parquet(f"{folder}/discoveries/v=-1")
    spark.range(-1, 0).select(F.col("id").alias("version")).write.mode("ignore").parquet(f"{folder}/commits/at=-1")


def committed(spark: SparkSession, folder: str) -> int:
    """The last batch that was delivered and marked; -1 before the first."""
    return spark.read.schema("version bigint").parquet(f"{folder}/commits").agg(F.max("version")).first()[0]


def discoveries(spark: SparkSession, folder: str) -> DataFrame:
    """The discoveries as of the last committed batch."""
    return spark.read.schema(DISCOVERIES).parquet(f"{folder}/discoveries/v={committed(spark, folder)}")


def to_log(folder: str) -> Callable[[DataFrame, int], None]:
    """A sink that is a table: a batch that comes again replaces what it wrote before."""
    return lambda rows, batch: rows.write.mode("overwrite").parquet(f"{folder}/delivered/batch={batch}")


def run_delivery(sightings: DataFrame, folder: str, now: Column, deliver: Callable[[DataFrame, int], None] | None = None, cap: int = 3, least: float | None = 0.35) -> None:
    """All available sightings, batch by batch: discoveries go on, the best ones that nobody was told of go to ``deliver`` and are marked.

    A batch reads the snapshot of the one before, gives (delivery_id, topic, paper, rank) rows to ``deliver``, writes the next snapshot
    with what was delivered marked, and is committed last. A job that stops in between runs the same batch again on the same
    snapshot, with the same rows and ids: a sink that keys its log by batch or by delivery_id has each once. A committed batch
    that comes again does nothing. If ``deliver`` fails nothing is marked.
    """
    deliver = deliver or to_log(folder)
    prepare(sightings.sparkSession, folder)

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = committed(spark, folder)
        if before >= number:
            return
        base = spark.read.schema(DISCOVERIES).parquet(f"{folder}/discoveries/v={before}")
        after = cut_lineage(track_discoveries(base, valid_sightings(batch)[0]).drop("is_new"))
        rows = pending_notifications(after, cap, least)
        named = rows.select(F.sha2(F.concat_ws("\x1f", F.lit(str(number)), "watch_topic_id", "paper_id"), 256).alias("delivery_id"), "watch_topic_id", "nth", "paper_id", "rank_score")
        deliver(named, number)
        marked = mark_notified(after, rows, now).drop("marked")
        marked.select(*(c.split(" ")[0] for c in DISCOVERIES.split(", "))).write.mode("overwrite").parquet(f"{folder}/discoveries/v={number}")
        spark.range(number, number + 1).select(F.col("id").alias("version")).write.mode("overwrite").parquet(f"{folder}/commits/at={number}")

    query = sightings.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(one).start()
    query.awaitTermination()
