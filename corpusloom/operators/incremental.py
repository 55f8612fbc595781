"""Stored papers kept up batch by batch: only what a batch touches is solved, merged and shuffled again.

The memory is two tables: the papers, and ``keys`` (key, paper_id) with every key that any record of a paper ever had. A batch meets ``keys``,
the papers that it touches are merged with it, and the changes replace rows of both tables by key.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from .components import connected_components, cut_lineage, few
from .resolve import canonical_keys, incoming_keys, merge_metadata, stored_keys

#: What a stored paper has besides its id and its folded title.
COLUMNS = [
    "canonical_key", "title", "abstract", "authors", "publication_year", "venue", "doi", "url", "citation_count", "primary_source", "first_discovered_at", "created_at", "updated_at",
]


class Changes(NamedTuple):
    """What one batch does: the merged ``papers``, the ``keys`` that are new or belong to another paper now, and ``moved`` (old_id, new_id) papers."""

    papers: DataFrame
    keys: DataFrame
    moved: DataFrame


def grow_components(stored: DataFrame, links: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): the rows of a stored (node, component) table that ``links`` change, new nodes among them.

    Components keep the smallest node as their name, so the table after any batches is the one that ``connected_components`` gives for all links.
    Solved is a graph no larger than the batch: its nodes, each component that it meets standing as one. While the batch's nodes and the
    renamed components are few (counted in bytes), the stored rows are read twice and never shuffled. Loops and null ends are ignored.
    """
    new = cut_lineage(links.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src <> dst").distinct())
    nodes = cut_lineage(new.select(F.col("src").alias("node")).union(new.select("dst")).distinct())
    met = cut_lineage(stored.join(few(nodes, F.octet_length(F.col("node").cast("string"))), "node").select("node", "component"))
    at = lambda rows, end: rows.join(met.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
    solved = cut_lineage(connected_components(at(at(new, "src"), "dst")))
    renamed = cut_lineage(solved.where("node <> component").select(F.col("node").alias("was"), F.col("component").alias("now")))
    of_old = stored.withColumnRenamed("component", "was").join(few(renamed, F.octet_length(F.col("was").cast("string")) * 2), "was").select("node", F.col("now").alias("component"))
    fresh = nodes.join(met, "node", "left_anti")
    return of_old.unionByName(fresh.join(solved, "node", "left").select("node", F.coalesce("component", "node").alias("component")))


def replaced(base: DataFrame, changes: DataFrame, keys: list[str], removed: DataFrame | None = None) -> DataFrame:
    """``base`` with the rows of ``changes`` in place of those of equal keys, and without ``removed`` ones.

    While the changed keys are few (counted in bytes) the other rows go from file to file without a shuffle.
    """
    gone = changes.select(*keys) if removed is None else changes.select(*keys).unionByName(removed.select(*keys))
    gone = cut_lineage(gone.distinct())
    return base.join(few(gone, sum((F.octet_length(F.col(k).cast("string")) for k in keys), F.lit(0))), keys, "left_anti").unionByName(changes.select(*base.columns))


def _absorb(papers: DataFrame | None, keys: DataFrame | None, rows: DataFrame, row_keys: DataFrame) -> Changes:
    """``rows`` have rid, stored (an id, or null), made (the id otherwise), new and a paper's columns; ``row_keys`` are (rid, key)."""
    spark = rows.sparkSession
    if papers is None or keys is None:
        papers, keys = rows.select(F.lit("").alias("id"), *COLUMNS).limit(0), spark.createDataFrame([], "key string, paper_id string")
    rows, row_keys = cut_lineage(rows), cut_lineage(row_keys.distinct())
    met = cut_lineage(keys.join(few(row_keys.select("key").distinct(), F.octet_length("key")), "key").select("key", "paper_id"))
    touched_ids = met.select(F.col("paper_id").alias("id")).distinct()
    touched = papers.join(few(touched_ids, F.octet_length("id")), "id", "left_semi").select(
        F.concat(F.lit("m:"), "id").alias("rid"), F.col("id").alias("stored"), F.lit(None).cast("string").alias("made"), F.lit(False).alias("new"), *COLUMNS
    )
    everyone = cut_lineage(touched.unionByName(rows.select("rid", "stored", "made", "new", *COLUMNS)))
    holders = row_keys.unionByName(met.select(F.concat(F.lit("m:"), "paper_id").alias("rid"), "key"))
    first = holders.groupBy("key").agg(F.min("rid").alias("dst"))
    groups = connected_components(holders.join(first, "key").where("rid <> dst").select(F.col("rid").alias("src"), "dst"))
    placed = everyone.join(groups.withColumnRenamed("node", "rid"), "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    oldest = F.min_by("stored", F.when(F.col("stored").isNotNull(), F.struct("created_at", "stored")))
    target = placed.groupBy("component").agg(F.coalesce(oldest, F.min("made")).alias("paper_id"))
    settled = cut_lineage(placed.select("rid", "component").join(target, "component").select("rid", "paper_id"))
    aged = everyone.join(settled, "rid").withColumn("age", F.struct("new", "created_at", "rid"))
    # records of one canonical key are one paper, so the best key is nobody else's
    merged = merge_metadata(aged, "paper_id", "age").withColumn("canonical_key", F.col("best_key")).withColumnRenamed("paper_id", "id").drop("best_key")
    moved = cut_lineage(everyone.where("stored IS NOT NULL").join(settled, "rid").where("stored <> paper_id").select(F.col("stored").alias("old_id"), F.col("paper_id").alias("new_id")))
    followed = keys.withColumnRenamed("paper_id", "old_id").join(few(moved, F.octet_length("old_id") * 2), "old_id").select("key", F.col("new_id").alias("paper_id"))
    now = row_keys.join(settled, "rid").select("key", "paper_id")
    known = met.withColumnRenamed("paper_id", "was")
    given = now.distinct().join(known, "key", "left").where("was IS NULL OR was <> paper_id").select("key", "paper_id")
    return Changes(cut_lineage(merged.select("id", *COLUMNS, "normalized_title")), cut_lineage(given.union(followed).distinct()), moved)


def start_memory(memory: DataFrame, sources: DataFrame) -> Changes:
    """The first state, of papers as they are stored and their sources: papers that share a key are one from now on."""
    own = F.concat(F.lit("m:"), "id")
    rows = memory.select(own.alias("rid"), F.col("id").alias("stored"), F.lit(None).cast("string").alias("made"), F.lit(False).alias("new"), *COLUMNS)
    known = stored_keys(memory, sources).join(memory.select("id"), "id", "left_semi")
    return _absorb(None, None, rows, known.select(own.alias("rid"), "key"))


def upsert_batch(papers: DataFrame, keys: DataFrame, incoming: DataFrame, now: Column) -> Changes:
    """What a batch of feed records changes: as ``resolve.upsert_papers`` over all papers, but only those are read into it that the batch touches.

    ``papers`` and ``keys`` have to be stored tables, as both are scanned twice; while the batch's keys are few (counted in bytes) neither is
    shuffled. As every key stays known, a record also meets papers by what earlier records of theirs were called, which the merged paper
    doesn't tell any more. A batch that is given again changes no more than ``updated_at``. Ids of records have to be unique in the batch.
    """
    new = F.concat(F.lit("i:"), "id")
    rows = incoming.join(canonical_keys(incoming), "id").select(
        new.alias("rid"), F.lit(None).cast("string").alias("stored"), F.substring(F.sha2("canonical_key", 256), 1, 32).alias("made"), F.lit(True).alias("new"), "canonical_key", "title", "abstract", "authors",
        "publication_year", "venue", T.norm_doi_stored(F.col("doi")).alias("doi"), "url", "citation_count", F.col("source").alias("primary_source"),
        now.alias("first_discovered_at"), now.alias("created_at"), now.alias("updated_at"),
    )
    return _absorb(papers, keys, rows, incoming_keys(incoming).select(new.alias("rid"), "key"))


def next_state(papers: DataFrame, keys: DataFrame, changes: Changes) -> tuple[DataFrame, DataFrame]:
    """Both tables after ``changes``; to be written to a new place before the old one goes."""
    return replaced(papers, changes.papers, ["id"], changes.moved.select(F.col("old_id").alias("id"))), replaced(keys, changes.keys, ["key"])
