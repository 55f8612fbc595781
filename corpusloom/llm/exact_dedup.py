"""Exact dedup: a tree merge of sorted digest runs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.components import cut_lineage, few
from .rows import without

#: Partitions that exchange runs in a round: two, so rounds are those of a binomial tree. More take fewer rounds.
FAN_IN = 2
#: Rows of a run at the leaves, about.
RUN_ROWS = 20_000
KEY = ["digest", "n_bytes", "proof"]


def normalised(text: Column) -> Column:
    """White-space runs (space, \\t to \\r) become one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: rid (the row), doc_id, and of its text the SHA-256 digest, the bytes and a second hash as proof."""
    text = normalised(F.col(text_col).cast("string"))
    return docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.xxhash64(text).alias("proof"),
    )


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each key of a partition sorted by it: the first one's identifier, and the counts summed up."""
    held: pa.RecordBatch | None = None
    at = lambda b, c: b.schema.get_field_index(c)

    def counted(b: pa.RecordBatch, n: np.ndarray) -> pa.RecordBatch:
        return b.set_column(at(b, "n"), "n", pa.array(n))

    for batch in batches:
        if not batch.num_rows:
            continue
        batch = pa.RecordBatch.from_arrays(batch.columns, batch.schema.names)  # one schema, whatever may be null
        both = pa.Table.from_batches([x for x in (held, batch) if x is not None]).combine_chunks().to_batches()[0]
        new = np.zeros(both.num_rows, bool)
        new[0] = True
        for c in KEY:
            col = both.column(at(both, c))
            values = col.to_numpy(zero_copy_only=False)
            new[1:] |= values[1:] != values[:-1]
        first = np.flatnonzero(new)
        n = np.add.reduceat(both.column(at(both, "n")).to_numpy(), first)
        out = counted(both.take(pa.array(first)), n)
        held = out.slice(out.num_rows - 1)
        if out.num_rows > 1:
            yield out.slice(0, out.num_rows - 1)
    if held is not None:
        yield held


def tree_merge(runs: DataFrame, fan_in: int = FAN_IN, leaves: int | None = None) -> DataFrame:
    """(digest, n_bytes, proof, doc_id, rid, n): the smallest identifier and the size of each group of equal digests.

    The rows lie in ``leaves`` partitions, each sorted and merged into a run. Partitions are
    numbered in base ``fan_in``. In round r those that differ in digit r only exchange runs: a row
    goes to the partition whose digit r is the digest's, by its number and not by a hash of the key. There the
    ``fan_in`` runs are merged, and of each digest one row stays: the smallest identifier and the count. After the last round all digits are the
    digest's. Equal digests count as equal if byte length and a second, independent hash agree too, at
    every level. However many copies there are, a partition never gets more than ``fan_in`` rows of one digest.
    """
    leaves = leaves or min(runs.rdd.getNumPartitions(), max(1, math.ceil(runs.count() / RUN_ROWS)))
    rounds = math.ceil(math.log(leaves, fan_in) - 1e-9) if leaves > 1 else 0
    schema = "slot long, digest binary, n_bytes long, proof long, doc_id long, rid long, n long"
    merge = lambda df: df.sortWithinPartitions(*KEY, F.col("doc_id").isNull(), "doc_id", "rid").mapInArrow(_merged, schema)
    rows = runs.coalesce(leaves).select(F.spark_partition_id().cast("long").alias("slot"), *KEY, "doc_id", "rid", F.lit(1).cast("long").alias("n"))
    held = merge(rows)
    own = F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long")
    for r in range(rounds):
        unit = fan_in**r
        digit = F.floor(own / F.lit(unit)) % fan_in
        left = F.floor(F.col("slot") / F.lit(unit * fan_in)) * (unit * fan_in) + F.col("slot") % unit
        held = held.withColumn("slot", (left + digit * unit).cast("long"))
        held = merge(held.repartitionById(fan_in**rounds, F.col("slot").cast("int")))
    return held.select(*KEY, "doc_id", "rid", "n")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rid, doc_id, keep_id, group_size, kept, digest, n_bytes for every row of ``docs``.

    Texts are equal when they are the same after ``normalised``. Of a group the
    smallest id stays; a null id counts as the largest. Of rows with equal id and
    text the first as scanned stays. Null and empty texts form one group. No rows
    give no rows. Other columns are ignored, whatever their names.
    """
    rows = cut_lineage(digest_runs(docs, id_col, text_col))
    best = cut_lineage(tree_merge(rows).where("n > 1")).select(*KEY, F.col("doc_id").alias("k_doc"), F.col("rid").alias("k_rid"), "n")
    alone = F.col("n").isNull()
    return rows.join(few(best, F.lit(48)), KEY, "left").select(
        "rid", "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("k_doc")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("rid") == F.col("k_rid"))).alias("kept"), "digest", "n_bytes",
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_duplicates`` keeps, with their columns.

    ``docs`` has to be a stored table: its rows are numbered as scanned, twice.
    """
    return without(docs, exact_duplicates(docs, id_col, text_col).where(~F.col("kept")))
