"""Sharding: contiguous shards of near equal bytes, from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..operators.components import cut_lineage


def byte_shards(
    docs: DataFrame, shards: int = 40, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None
) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot for every row of ``docs``.

    The rows are put in the order of doc_id (null first; equal ids as scanned) by
    range partitions. The partitions' totals, one row each, are summed up to their
    offsets; a running sum inside each partition does the rest. A row goes to the
    shard whose equal share of all bytes holds the row's middle, so a shard differs
    from the target by one row at most at either end, and shards are contiguous in
    the order. ``slot`` counts a shard's rows from 0. Size is the text's UTF-8 bytes
    (null: none) plus ``overhead``. With fewer rows than shards, or one huge row,
    some shards stay empty. No rows give no rows. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("seq"),
    )
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, "doc_id", "seq").sortWithinPartitions("doc_id", "seq")
    # the checkpoint fixes the sampled ranges: totals and rows see the same ones
    placed = cut_lineage(placed.select("doc_id", "size", "text_crc32", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))

    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # over one row for each partition
    totals = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(W.partitionBy(F.lit(1))).alias("all_bytes"),
    )
    inside = W.partitionBy("part").orderBy("at")
    summed = placed.select(
        "*", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)).alias("upto"), F.row_number().over(inside).alias("nth")
    ).join(offsets, "part")
    # twice the middle of the row over twice the total, in exact integers
    middle = (2 * (F.col("bytes_before") + F.col("upto")) - F.col("size")).cast("decimal(38,0)")
    shard = F.least(F.floor(middle * shards / (2 * F.col("all_bytes")).cast("decimal(38,0)")), F.lit(shards - 1))
    cut = summed.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), (F.col("rows_before") + F.col("nth") - 1).alias("place"))
    first = cut.groupBy("shard").agg(F.min("place").alias("first"))  # one row for each shard
    return cut.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot")
    )
