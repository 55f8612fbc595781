"""Connected components of an edge table, in DataFrame rounds."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only on one machine (master ``local``), where that is unset, an own one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and read it back."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def sized(df: DataFrame, rows: int, each: int = 100_000) -> DataFrame:
    """As few partitions as ``rows`` of small records need; never more than there are."""
    return df.coalesce(max(4, -(-rows // each)))


#: Bytes up to which a table is broadcast; a larger one is shuffled.
BROADCAST_BYTES = 32 << 20


def few(df: DataFrame, more: Column | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast only behind a count of its bytes: 16 for each row, 8 for each column and what ``more`` says of the rest."""
    size = F.lit(16 + 8 * len(df.columns)) if more is None else F.lit(16 + 8 * len(df.columns)) + F.coalesce(more, F.lit(0))
    held = df.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0)).alias("bytes")).first()["bytes"]
    return F.broadcast(df) if held <= limit else df


def in_order(rows: DataFrame, *order: Column, name: str = "nth") -> DataFrame:
    """``rows`` with a column ``name``: the place of each in the order, from 0; range partitions, their counts summed up, and the place inside one."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = cut_lineage(placed.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__at")))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # over one row for each partition
    offsets = placed.groupBy("__part").agg(F.count("*").alias("n")).select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    return placed.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable from each node that has an edge.

    Alternates the large-star and small-star steps of Kiveris et al. (2014), so the
    rounds grow with the logarithm of a component's size even for long chains. A
    neighbourhood is only ever aggregated (min), never gathered. Loops, repeated
    edges and null ends are ignored. An empty edge table gives an empty result.
    """
    # every undirected edge once, as (larger, smaller)
    now = cut_lineage(
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    n = now.count()
    small_parts = lambda df: sized(df, 2 * n)  # noqa: E731  no round has more edges than the first
    now, before = small_parts(now), None
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = small_parts(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = small_parts(now.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v")))
        large = small_parts(large.where(F.col("u") != F.col("v")).distinct())
        least = small_parts(large.groupBy("u").agg(F.min("v").alias("m")))
        joined = small_parts(large.join(least, "u"))
        small = (
            joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(joined.select("u", F.col("m").alias("v")))
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        now = cut_lineage(small_parts(small))
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (mark["n"], mark["h"]) == before:
            break
        before = (mark["n"], mark["h"])
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = small_parts(now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
