"""Exact set similarity inside buckets of candidate sets.

Used by the joins that find their candidates by buckets. A set is known by ``sig``.
No pairs leave a task: a bucket gives one row for each linked set, with a link to
its group's root and its number of links there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.components import few, sized

from .words import mix

#: The least hashes of a set that go with it as its sketch.
SKETCH = 32
#: Sets compared in one task at once; a larger bucket is dealt out by pairs of blocks.
BLOCK = 256
#: Shingles that the sets of a block hold together.
BLOCK_TOKENS = 1 << 20
COLUMNS = 1 << 14


def only(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The rows of the keys, before anything wide is shuffled."""
    return df.join(few(keys.select(on).distinct()), on, "left_semi")


def signatures(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set of hashes; the sets stand one after the other, each from its start."""
    sizes = np.diff(starts, append=len(values)).astype(np.uint64)
    return mix(np.add.reduceat(mix(values ^ np.uint64(0xA5A5A5A5)), starts) + sizes)


def signature(shingles: np.ndarray) -> int:
    return int(signatures(shingles, np.zeros(1, np.int64)).view(np.int64)[0]) if len(shingles) else 0


def sketch(shingles: np.ndarray) -> bytes:
    """The upper halves of the least hashes of a sorted set."""
    return (shingles[:SKETCH] >> np.uint64(32)).astype("<u4").tobytes()


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows that agree in the first ``keys`` columns; the input is sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def common(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections. The work is in matrix products over the values that two sets share."""
    n = len(sets)
    if n == 2:
        c = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), c], [c, len(sets[1])]], np.float32)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    flat = np.concatenate(sets) if n else np.empty(0)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    start = np.r_[True, flat[1:] != flat[:-1]] if len(flat) else np.empty(0, bool)
    col = np.cumsum(start) - 1
    shared = np.bincount(col)[col] > 1 if len(col) else np.empty(0, bool)
    row, col = row[shared], col[shared]
    out = np.zeros((n, n), np.float32)
    if len(col):
        col = np.unique(col, return_inverse=True)[1]
        for first in range(0, int(col[-1]) + 1, COLUMNS):
            a, b = np.searchsorted(col, [first, first + COLUMNS])
            dense = np.zeros((n, min(COLUMNS, int(col[-1]) + 1 - first)), np.float32)
            dense[row[a:b], col[a:b] - first] = 1
            out += dense @ dense.T
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def _near_sizes(sides: np.ndarray, sizes: np.ndarray, t: float) -> np.ndarray:
    """Pairs (i < j) whose sizes allow a similarity of t; of different sides where two blocks meet."""
    both = np.minimum.outer(sizes, sizes) >= t * np.maximum.outer(sizes, sizes) - 1e-9
    if (sides >= 0).any():
        both &= sides[:, None] != sides[None, :]
    return np.triu(both, 1)


def _may_be_similar(c: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray, t: float) -> np.ndarray:
    """By ``c`` values that two sketches share: false for pairs at or above t with odds under one in a million only.

    Of the SKETCH least hashes of a union a share of about t lies in both sets; five
    standard deviations are allowed. Sets that fit in their sketches are exact.
    """
    need = t * SKETCH - 5 * (t * (1 - t) * SKETCH) ** 0.5
    return np.where(np.maximum(sizes_a, sizes_b) <= SKETCH, c >= t * (sizes_a + sizes_b - c) - 1e-6, c >= need)


def _at_pivot(c: np.ndarray, a: np.ndarray, b: np.ndarray, t: float, settled: float) -> tuple[np.ndarray, np.ndarray]:
    """(linked, settled) of sets of sizes ``a`` whose sketches share ``c`` values with their pivots' of sizes ``b``.

    A settled set x shares ``settled`` of its sketch with the pivot's, and what is alike to x
    shares as much of x's sketch as _may_be_similar asks for. Both parts lie in x's sketch, so they overlap, in the
    pivot's sketch too, by what they are more than it together. Sizes differ by t twice at
    most. All that pass these two bounds are linked: no partner of a settled set is lost here.
    """
    low, high, small = np.minimum(a, b), np.maximum(a, b), np.maximum(a, b) <= SKETCH
    near = np.where(small, c >= settled * (a + b - c) - 1e-6, c >= settled * SKETCH) & (low >= t * high - 1e-9)
    need = settled * SKETCH - 5 * (t * (1 - t) * SKETCH) ** 0.5 + t * SKETCH - SKETCH
    linked = (c >= need) | (small & (c >= (settled + t - 1) * (a + b - c) - 1e-6))
    return linked & (low >= t * t * high - 1e-9), near


def _roots(similar: np.ndarray) -> np.ndarray:
    """The first member of each one's group, by a walk over the links of a symmetric matrix."""
    root = np.arange(len(similar))
    for i in range(len(similar)):
        if root[i] != i or not similar[i].any():
            continue
        todo = [i]
        while todo:
            near = np.flatnonzero(similar[todo.pop()])
            near = near[(root[near] == near) & (near > i)]
            root[near] = i
            todo += near.tolist()
    return root


def _linker(t: float, exact: bool):
    """sig, root and links of each linked member of each run of rows with the same group and pair of blocks."""
    held, kind = ("shingles", "<u8") if exact else ("sketch", "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list[int]] = [[], [], []]

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["sig", "root", "links"])
            for x in out:
                x.clear()
            return made

        for table in groups(batches, 2):
            if table.num_rows < 2:
                continue
            sig, copies = table.column("sig").to_numpy(), table.column("copies").to_numpy()
            sizes = table.column("size").to_numpy().astype(np.float64)
            todo = _near_sizes(table.column("side").to_numpy(), sizes, t)
            if not todo.any():
                continue
            c = common([np.frombuffer(x, kind) for x in table.column(held).to_pylist()])
            a, b = sizes[:, None], sizes[None, :]
            similar = todo & (c >= t * (a + b - c) - 1e-6 if exact else _may_be_similar(c, a, b, t))
            if not similar.any():
                continue
            similar |= similar.T
            count, root = similar @ copies, _roots(similar)
            linked = np.flatnonzero(count > 0)
            for x, values in zip(out, (sig[linked], sig[root[linked]], count[linked]), strict=True):
                x += values.tolist()
            if len(out[0]) > 10_000:
                yield batch_of()
        yield batch_of()

    return run


def links_within(members: DataFrame, reps: DataFrame, held: DataFrame, t: float, exact: bool) -> DataFrame:
    """sig, root, links: the sets with a partner in their bucket, the first of their group there and the partners' copies.

    ``members`` has (bucket, sig), of buckets with two sets at least; ``reps`` has
    (sig, size, copies); ``held`` has sig and, as sorted little-endian bytes, shingles
    if ``exact`` or else sketch, by which links are likely only. Buckets of more than BLOCK sets, or of many shingles,
    are dealt out by pairs of blocks, so no task gathers a whole large bucket.
    """
    n = members.count()
    stats = sized(members.join(reps.select("sig", "size"), "sig"), n).groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("tokens"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("tokens") / BLOCK_TOKENS)) if exact else F.ceil(F.col("n") / BLOCK)
    large = stats.select("bucket", blocks.cast("int").alias("blocks")).where("blocks > 1")
    rows = sized(members.join(reps.select("sig", "size", "copies"), "sig"), n).join(large, "bucket", "left")
    # block a meets every block b in the pair (min, max); its own pairs are (a, a)
    a = F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int")
    other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("a", F.coalesce(a, F.lit(0))).join(held, "sig").withColumn("b", other)
    rows = rows.select(
        "bucket", (F.least("a", "b").cast("long") * F.lit(1 << 31) + F.greatest("a", "b")).alias("pair"),
        F.when(F.col("a") == F.col("b"), -1).when(F.col("a") < F.col("b"), 0).otherwise(1).alias("side"),
        "sig", "size", "copies", "shingles" if exact else "sketch",
    )
    return rows.repartition("bucket", "pair").sortWithinPartitions("bucket", "pair").mapInArrow(_linker(t, exact), "sig long, root long, links long")


def links_to_pivots(members: DataFrame, reps: DataFrame, t: float, settled: float) -> DataFrame:
    """bucket, sig, pivot, linked and settled: each member of a large bucket against one of them, its pivot, by sketches.

    In a bucket of near copies this links all of them in linear work. ``settled``
    are those so near the pivot that whatever is alike to them is linked to it too, by bounds that are looser than likeness.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column
            x, y = (batch.schema.get_field_index(n) for n in ("size", "p_size"))
            a, b = col(x).to_numpy().astype(float), col(y).to_numpy().astype(float)
            pairs = zip(*(col(batch.schema.get_field_index(n)).to_pylist() for n in ("sketch", "p_sketch")), strict=True)
            c = np.array([len(np.intersect1d(np.frombuffer(u, "<u4"), np.frombuffer(v, "<u4"), assume_unique=True)) for u, v in pairs], float)
            linked, near = _at_pivot(c, a, b, t, settled)
            yield pa.RecordBatch.from_arrays([*(col(i) for i in range(3)), pa.array(linked), pa.array(near)], ["bucket", "sig", "pivot", "linked", "settled"])

    light = only(reps.select("sig", "size", "sketch"), members, "sig")
    pivots = members.select(F.col("pivot").alias("sig")).distinct().join(light, "sig").select(F.col("sig").alias("pivot"), F.col("size").alias("p_size"), F.col("sketch").alias("p_sketch"))
    rows = sized(members.join(light, "sig"), members.count()).join(few(pivots), "pivot")
    return rows.select("bucket", "sig", "pivot", "size", "p_size", "sketch", "p_sketch").mapInArrow(run, "bucket long, sig long, pivot long, linked boolean, settled boolean")
