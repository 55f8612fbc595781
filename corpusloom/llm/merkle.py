"""Merkle manifest: a content-addressed store of digest-to-children records, and proofs by descent from the root."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..operators.components import cut_lineage, few
from .similar import groups

#: Consecutive nodes that become one, and the levels that a task builds of a run of neighbours at once.
FAN = 3
LEVELS = 6
#: Bytes of a digest. Children stand in one binary value, one after the other.
BYTES = 32
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def field(x: Column) -> Column:
    """A value as its UTF-8 byte count, a colon and itself; null as a dash."""
    x = x.cast("string")
    return F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, fields)).cast("binary"), 256))


def as_text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def in_order(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``nth``, the place of each in the order: range partitions, their counts summed up, and the place inside one."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = cut_lineage(placed.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # over one row for each partition
    offsets = placed.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return placed.join(F.broadcast(offsets), "part").withColumn("nth", F.col("before") + F.col("at")).drop("part", "at", "before")


def height(total: int, fan: int) -> int:
    """Levels above the leaves of a tree until one node is left."""
    levels = 0
    while total > 1:
        total, levels = -(-total // fan), levels + 1
    return levels


def node_digest(children: bytes) -> bytes:
    return sha256(children.hex().encode()).digest()


def _level_round(nodes: DataFrame, level: int, fan: int, levels: int) -> DataFrame:
    """(tree, level, idx, digest, children): up to ``levels`` levels above the nodes of one level, run by run of fan ** levels neighbours."""
    schema = pa.schema([("tree", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.binary()), ("children", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for table in groups(batches, 2):
            tree, idx, left = (table.column(c)[0].as_py() for c in ("tree", "idx", "left"))
            now = table.column("digest").to_pylist()
            for k in range(1, min(levels, left) + 1):
                idx //= fan
                kids = [b"".join(now[i : i + fan]) for i in range(0, len(now), fan)]
                now = [node_digest(c) for c in kids]
                out += [(tree, level + k, idx + i, d, c) for i, (d, c) in enumerate(zip(now, kids, strict=True))]
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    rows = nodes.select("tree", F.floor(F.col("idx") / F.lit(fan**levels)).alias("run"), "idx", "left", "digest")
    rows = rows.repartition("tree", "run").sortWithinPartitions("tree", "run", "idx")
    return rows.mapInArrow(run, "tree long, level int, idx long, digest binary, children binary")


def build(leaves: DataFrame, trees: DataFrame, fan: int = FAN, levels: int = LEVELS) -> tuple[DataFrame, DataFrame, int]:
    """The store (level, digest, children), the tops (tree, digest, height) and the greatest height.

    ``leaves`` has tree, idx (gapless from 0) and digest; ``trees`` has tree and height.
    Every ``fan`` consecutive nodes become one until one is left; a lone leaf is its tree's top itself. The store holds each
    digest once, whatever holds it: equal digests have equal children.
    """
    most = trees.agg(F.max("height")).first()[0] or 0
    nodes = leaves.join(few(trees), "tree").select("tree", "idx", "digest", F.col("height").alias("left"))
    tops = nodes.where("left = 0").select("tree", "digest", F.lit(0).alias("height"))
    made = []
    for level in range(0, most, levels):
        done = cut_lineage(_level_round(nodes.where("left > 0"), level, fan, levels))
        made.append(done)
        held = done.join(few(trees), "tree")
        tops = tops.unionByName(held.where("level = height").select("tree", "digest", "height"))
        nodes = held.where((F.col("level") == level + levels) & (F.col("height") > F.col("level"))).select("tree", "idx", "digest", (F.col("height") - F.col("level")).alias("left"))
    empty = leaves.sparkSession.createDataFrame([], "level int, digest binary, children binary")
    rows = reduce(DataFrame.unionByName, (d.select("level", "digest", "children") for d in made)) if made else empty
    return cut_lineage(rows.groupBy("level", "digest").agg(F.first("children").alias("children"))), cut_lineage(tops), most


def descend(requests: DataFrame, tops: DataFrame, store: DataFrame, most: int, fan: int = FAN) -> DataFrame:
    """``requests`` (tree, idx and more) with ``path`` and ``found``: what stands left and right of each node from the top down, and the leaf that was reached.

    ``tops`` has tree, digest, height and path (what stands above them). Requests descend together as long as their
    digits, from the highest on, are the same: one row for each node that is met, so a level's joins move as many rows as it
    has nodes, each key once, and the rows of all levels but the last are fewer than half of the leaves. Each level looks its nodes up in
    the store by digest, takes each digit's child and collects the others. Trees of different heights start so that all
    end in the same round; in the last one each request takes its child of its run.
    """
    kid = lambda pos: F.substring("children", pos * BYTES + 1, F.lit(BYTES))
    beside = lambda pos: F.array_append("path", F.struct(F.substring("children", F.lit(1), pos * BYTES).alias("l"), F.substring("children", (pos + 1) * BYTES + 1, F.lit(BYTES * fan)).alias("r")))
    frontier = tops.where("false").select("tree", F.lit(0).cast("long").alias("idx"), "digest", "path")
    runs = None
    for level in range(most, 0, -1):
        entering = tops.where(F.col("height") == level).select("tree", F.lit(0).cast("long").alias("idx"), "digest", "path")
        records = store.where(F.col("level") == level).select("digest", "children")
        met = frontier.unionByName(entering).join(records, "digest")
        if level == 1:
            runs = met.select("tree", F.col("idx").alias("run"), "children", "path")
            break
        met = met.withColumn("pos", F.explode(F.sequence(F.lit(0), (F.octet_length("children") / BYTES).cast("int") - 1)))
        frontier = met.select("tree", (F.col("idx") * fan + F.col("pos")).alias("idx"), kid(F.col("pos")).alias("digest"), beside(F.col("pos")).alias("path"))
    alone = tops.where("height = 0").select("tree", F.col("digest").alias("found"), "path")
    lone = requests.join(few(alone, F.size("path") * 3 * BYTES + BYTES), "tree")
    if runs is None:
        return lone
    pos = (F.col("idx") % fan).cast("int")
    asked = requests.withColumn("run", F.floor(F.col("idx") / F.lit(fan)))
    deep = asked.join(runs, ["tree", "run"]).withColumns({"found": kid(pos), "path": beside(pos)}).drop("run", "children")
    return deep.unionByName(lone)


def folded(leaf: Column, path: Column) -> Column:
    """The root as hex text that a leaf's digest and its path, from the top down, give."""
    return F.aggregate(F.reverse(path), as_text(leaf), lambda up, s: F.sha2(F.concat(as_text(s["l"]), up, as_text(s["r"])), 256))


def siblings(path: Column) -> Column:
    """The siblings' digests as hex text, level by level from the leaf up, left to right."""
    return F.array_join(F.transform(F.reverse(path), lambda s: F.concat(as_text(s["l"]), as_text(s["r"]))), "")


def manifest(docs: DataFrame, received: dict[str, Column] | None = None, id_col: str = "doc_id", group_col: str = "source", fields: list[str] = FIELDS, fan: int = FAN, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """One row for each row of ``docs`` with its proof, and the store of digest-to-children records.

    rid, doc_id, leaf, other (the leaf as received), subroot, root (digests) and path (from the root down). A leaf is the digest of the
    ``fields``, each with its byte count. Of each group of ``group_col`` (null is one of its own, the first) the leaves in order of
    the id, null first, make a tree; the groups' tops in order of the group, by bytes, make the tree above them. Both are built by
    ``build``, and each leaf's request descends from the root. ``received`` names columns whose values as received differ, so that
    ``folded(other, path)`` shows what was changed.

    A null value is a dash in its leaf. Rows with equal id are in order of their digests, so repeated rows, which have the
    same, are leaves each. Very long texts are hashed whole. One group only has its top as root; no rows give no
    rows. Other columns are ignored, whatever their names.
    """
    received = received or {}
    group = F.col(group_col).cast("string")
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), group.alias("grp"), leaf_digest([F.col(c) for c in fields]).alias("leaf"),
        leaf_digest([received.get(c, F.col(c)) for c in fields]).alias("other"),
    )
    rows = in_order(cut_lineage(rows), F.asc_nulls_first("grp"), F.asc_nulls_first("doc_id"), F.asc("leaf"), F.asc("rid"))
    found = rows.groupBy("grp").agg(F.min("nth").alias("first"), F.count("*").alias("total"))
    levels_of = F.expr("CAST(0 AS INT)")
    power = 1
    while power < 1 << 62:  # the least height whose power holds the total
        levels_of = levels_of + F.when(F.col("total") > power, 1).otherwise(0)
        power *= fan
    found = cut_lineage(in_order(found.withColumn("height", levels_of), F.asc("first")).withColumnRenamed("nth", "tree"))
    named = found.select(F.coalesce(F.concat(F.lit("="), "grp"), F.lit("")).alias("name"), "tree", "first")
    rows = rows.withColumn("name", F.coalesce(F.concat(F.lit("="), "grp"), F.lit(""))).join(few(named, F.octet_length("name")), "name")
    rows = cut_lineage(rows.select("tree", (F.col("nth") - F.col("first")).alias("idx"), "rid", "doc_id", "leaf", "other"))

    store, tops, most = build(rows.select("tree", "idx", F.col("leaf").alias("digest")), found.select("tree", "height"), fan, levels)
    above = tops.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), "digest")
    count = above.count()
    one = docs.sparkSession.range(1 if count else 0).select(F.col("id").alias("tree"), F.lit(height(count, fan)).alias("height"))
    upper, root, upper_most = build(above, one, fan, levels)
    root = root.withColumn("path", F.array().cast("array<struct<l: binary, r: binary>>"))
    named = descend(above, root, upper, upper_most, fan).select(F.col("idx").alias("tree"), "digest", "path")
    top = root.first()
    tops = cut_lineage(tops.select("tree", "height").join(named, "tree").withColumn("root", F.lit(bytes(top["digest"]) if top else None).cast("binary")))
    proofs = descend(rows, tops.select("tree", "digest", "height", "path"), store, most, fan)
    ends = few(tops.select("tree", F.col("digest").alias("subroot"), "root"), F.lit(2 * BYTES))
    store = store.withColumn("kind", F.lit("leaves")).unionByName(upper.withColumn("kind", F.lit("groups")))
    return proofs.join(ends, "tree").select("rid", "doc_id", "leaf", "other", "subroot", "root", "path"), store
