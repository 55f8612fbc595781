"""N-gram Jaccard join by chosen paths (cf. Christiani, Pagh, Sivertsen 2018)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.components import connected_components, cut_lineage, sized
from .rows import without
from .similar import few, links_to_pivots, links_within, only, signature, sketch
from .words import HASHES, grams, mix, split_words, texts

SHINGLE = 5
SIMILARITY = 0.8
TARGET_RECALL = 0.995
#: A bucket of more sets is split again, DEPTH times in all; what is still large is compared by blocks.
SMALL = 256
DEPTH = 3
#: Sets this near the pivot of a large bucket need no further picks there.
SETTLED = 0.75


def runs_for(target: float, t: float, depth: int) -> int:
    """Runs after which a pair at the threshold has met with the target's odds, even if its buckets are split ``depth`` times.

    A set picks each token with probability 1 / (t * size), and what the larger set picks
    the smaller one picks too. So a pair of similarity t shares (tokens in common) / (t * larger size) picks
    on average: 1 at least, where one set holds the other. They survive as a branching process.
    """
    mean, p = 1.0, 1.0
    for _ in range(depth):
        p = 1 - math.exp(-mean * p)
    return math.ceil(math.log(1 - target) / math.log(1 - p))


def shingles(text: bytes | None, n: int = SHINGLE) -> np.ndarray:
    """The sorted set of hashes of n consecutive words; of all words if there are fewer; of none if none."""
    h = HASHES.of(split_words(text))
    return np.unique(grams(h, min(n, len(h)))) if len(h) else np.empty(0, np.uint64)


def chosen_paths(s: np.ndarray, runs: int, depth: int, t: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level the chosen (parent, path) hashes. Whether a token is picked depends on the parent path and the token alone."""
    share = 1 / (t * max(1, len(s)))
    limit = np.uint64(min(2**64 - 1, int(share * 2**64)))
    parents = mix(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    out = []
    step = max(1, (1 << 22) // max(1, len(s)))
    for _ in range(depth):
        found = []
        for a in range(0, len(parents), step):
            p = parents[a : a + step]
            x = (s[None, :] ^ p[:, None]) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(32)
            x *= np.uint64(0x94D049BB133111EB)
            i, j = np.nonzero(x <= limit)
            found.append((p[i], mix(p[i] * np.uint64(0x9E3779B97F4A7C15) + s[j])))
        out.append((np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (np.empty(0, np.uint64),) * 2)
        parents = out[-1][1]
    return out


def _described(docs: DataFrame, id_col: str, text_col: str, n: int, t: float, runs: int, depth: int) -> DataFrame:
    """rid, doc_id, sig, size, sketch, and nodes_1 ... nodes_depth of every row."""
    node = pa.struct([("parent", pa.int64()), ("path", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(a, 1000) for a in range(0, whole.num_rows, 1000)):
                sigs, sizes, sketches = [], [], []
                levels: list[list] = [[] for _ in range(depth)]
                for text in texts(batch.column(2)):
                    s = shingles(text, n)
                    sigs.append(signature(s))
                    sizes.append(len(s))
                    sketches.append(sketch(s))
                    for level, got in zip(levels, chosen_paths(s, runs, depth, t), strict=True):
                        level.append(got)
                arrays = [batch.column(0), batch.column(1), pa.array(sigs, pa.int64()), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary())]
                for level in levels:
                    ends = np.cumsum([0, *(len(x[0]) for x in level)]).astype(np.int32)
                    parts = [pa.array(np.concatenate([x[k] for x in level]).view(np.int64)) for k in (0, 1)]
                    arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(parts, fields=list(node))))
                yield pa.RecordBatch.from_arrays(arrays, ["rid", "doc_id", "sig", "size", "sketch", *(f"nodes_{d + 1}" for d in range(depth))])

    nodes = ", ".join(f"nodes_{d + 1} array<struct<parent:bigint,path:bigint>>" for d in range(depth))
    return docs.select(F.monotonically_increasing_id(), F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
        run, f"rid long, doc_id long, sig long, size int, sketch binary, {nodes}"
    )


def _likely_links(rows: DataFrame, reps: DataFrame, t: float, depth: int, small: int) -> DataFrame:
    """(src, dst): sets that are alike by their sketches, as links to one set of each group in each bucket.

    Buckets of up to ``small`` sets are compared in full. In a larger one all sets meet
    its pivot; those that aren't settled by this pick again, below the same path.
    """
    # one row for each set: the copies' picks are the same
    copies = rows.join(few(reps.where("copies > 1").select("sig")), "sig", "left_semi").select("rid", "sig").join(reps.select("sig", F.col("rid").alias("first_rid")), "sig").where("rid <> first_rid")
    rows = rows.join(few(copies.select("rid")), "rid", "left_anti")
    leaves, links, still = None, None, None
    for d in range(1, depth + 1):
        picks = rows.where("size > 0")
        if still is None:
            nodes = picks.select("sig", F.explode(f"nodes_{d}.path").alias("bucket"))
        else:
            # one row for each set says in which buckets it picks again
            again = still.groupBy("sig").agg(F.collect_set("bucket").alias("parents"))
            picks = picks.join(few(cut_lineage(again), 8 * F.size("parents")), "sig", "left").select("sig", "parents", F.explode(f"nodes_{d}").alias("n"))
            nodes = picks.where(F.coalesce(F.array_contains("parents", F.col("n.parent")), F.lit(False))).select("sig", F.col("n.path").alias("bucket"))
        counts = nodes.groupBy("bucket").agg(F.count("*").alias("n"), F.min("sig").alias("pivot")).where("n > 1")
        held = cut_lineage(nodes.join(counts, "bucket"))
        done = held.where(F.col("n") <= small).select("bucket", "sig")
        large = held.where(F.col("n") > small).select("bucket", "sig", "pivot")
        if not large.isEmpty():
            met = cut_lineage(links_to_pivots(large, reps, t, SETTLED))
            found = met.where("linked AND sig <> pivot").select(F.col("sig").alias("src"), F.col("pivot").alias("dst"))
            links = found if links is None else links.union(found)
            still = met.where("NOT settled").select("bucket", "sig")
            done = done.union(still) if d == depth else done
        leaves = done if leaves is None else leaves.union(done)
        if large.isEmpty() or still.isEmpty():
            break
    leaves = cut_lineage(leaves)
    kept = only(reps, leaves, "sig")
    inside = links_within(leaves, kept, kept.select("sig", "sketch"), t, exact=False).where("sig <> root").select(F.col("sig").alias("src"), F.col("root").alias("dst"))
    return inside if links is None else inside.union(links)


def _sets(docs: DataFrame, wanted: DataFrame, text_col: str, n: int) -> DataFrame:
    """(sig, shingles) of the wanted (rid, sig) rows; texts are read again, so that no shingles are stored for the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(a, 500) for a in range(0, whole.num_rows, 500)):
                packed = [shingles(text, n).astype("<u8").tobytes() for text in texts(batch.column(1))]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["sig", "shingles"])

    numbered = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(text_col).cast("string").alias("text"))
    return numbered.join(few(wanted), "rid").select("sig", "text").mapInArrow(run, "sig long, shingles binary")


def near_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, t: float = SIMILARITY,
    target: float = TARGET_RECALL, small: int = SMALL, depth: int = DEPTH,
) -> DataFrame:
    """rid, doc_id, class_id, n_links, class_rid and n_shingles for every row of ``docs``.

    Two rows are linked when the Jaccard similarity of their sets of n-word shingles
    is t or more; ``n_links`` counts a row's partners, copies included, and a class is
    what links connect. ``class_id`` is the class's smallest doc_id (null ids
    count as the largest), ``class_rid`` its row. Rows with equal sets are one
    set until the end. Each set picks a few of its shingles in each of several runs,
    and sets that picked the same one share a bucket. Small buckets are compared in
    full, by sketches; in a large one all meet a pivot, and what isn't near it picks
    again. What these likely links connect is then compared exactly, all with all and
    once only, by pairs of blocks where it is thousands of near copies. Links are
    exact; a pair at the threshold is missed with a probability of 1 - ``target``
    at most. Texts of fewer than n words are one shingle; those
    without words have no links and are classes of their own. No rows give no rows.
    Other columns are ignored. ``docs`` has to be a stored table: it is read twice.
    """
    runs = runs_for(target, t, depth)
    rows = cut_lineage(_described(docs, id_col, text_col, n, t, runs, depth))
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")
    reps = cut_lineage(rows.where("size > 0").groupBy("sig", "size", "sketch").agg(F.count("*").alias("copies"), F.min("rid").alias("rid"), F.min(first).alias("first")))
    likely = connected_components(_likely_links(rows, reps.select("sig", "size", "copies", "sketch", "rid"), t, depth, small))
    groups = cut_lineage(likely.select(F.col("component").alias("bucket"), F.col("node").alias("sig")))
    linked_reps = cut_lineage(only(reps.select("sig", "size", "copies", "rid", "first"), groups, "sig"))
    linked_reps = sized(linked_reps, linked_reps.count())
    links = cut_lineage(links_within(groups, linked_reps, _sets(docs, linked_reps.select("sig", "rid"), text_col, n), t, exact=True))
    links = sized(links, links.count())
    component = connected_components(links.select(F.col("sig").alias("src"), F.col("root").alias("dst")))
    counts = links.groupBy("sig").agg(F.sum("links").alias("links"))
    linked = cut_lineage(counts.join(component.withColumnRenamed("node", "sig"), "sig").join(linked_reps.select("sig", "first"), "sig"))
    heads = linked.groupBy("component").agg(F.min("first").alias("head"))
    named = linked.join(heads, "component").select("sig", "links", "head")
    by_set = reps.join(named, "sig", "left").select(
        "sig", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("head", "first").alias("head")
    )
    with_words = rows.where("size > 0").select("rid", "doc_id", "sig", "size").join(by_set, "sig").select(
        "rid", "doc_id", F.col("head.doc_id").alias("class_id"), "n_links", F.col("head.rid").alias("class_rid"), F.col("size").alias("n_shingles")
    )
    without = rows.where("size = 0").select("rid", "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("rid").alias("class_rid"), F.col("size").alias("n_shingles"))
    return with_words.unionByName(without)


def drop_near_duplicates(docs: DataFrame, **names) -> DataFrame:
    """The first row of each class, with its columns."""
    return without(docs, near_classes(docs, **names).where(F.col("rid") != F.col("class_rid")))
