"""Embedding whitening: the covariance of distinct fixed-point vectors by weighted centred products, each of them whitened once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.components import cut_lineage, few

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Entries beyond this count as it, so that no entry leaves a long's range.
LARGEST = float(1 << 62)
_SAFE = 1 << 62


def finite(v: Column) -> Column:
    """Not null, and neither null nor infinite nor no number in any entry."""
    return v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))


def fixed_point(v: Column, scale: int = SCALE, offset: int = OFFSET) -> Column:
    wide = lambda c: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), c.cast("double") * F.lit(float(scale))))
    return F.transform(v, lambda c: F.floor(wide(c)).cast("long") + F.lit(offset).cast("long"))


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    """The batch's x as rows; all are of one length."""
    x = batch.column(batch.schema.get_field_index("x"))
    flat = x.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1).astype(np.int64, copy=False)


def exact_sums(x: np.ndarray, w: np.ndarray) -> list[int]:
    """Weighted sums by dimension, in whole numbers without overflow."""
    if int(np.abs(x).max(initial=0)) * int(w.sum()) < _SAFE:
        return (x * w[:, None]).sum(0).tolist()
    return (x.astype(object) * w.astype(object)[:, None]).sum(0).tolist()


def scaled_deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S in whole numbers, as 64-bit ones where all fit."""
    largest = int(np.abs(x).max(initial=0)) * n + max(map(abs, sums), default=0)
    if largest < _SAFE:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def squares(m: np.ndarray) -> list[int | None]:
    """The sum of squares of each row, exact; null beyond a long's range."""
    largest = int(np.abs(m).max(initial=0)) if m.size else 0
    if largest * largest * max(1, m.shape[1]) < _SAFE:
        return (m * m).sum(1).tolist()
    return [s if s < 1 << 63 else None for s in (m.astype(object) ** 2).sum(1).tolist()]


def _reduced(df: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], merge: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray | None:
    """One array for each task, merged up a tree of tasks; arrays are as large as the dimensions say, however many rows there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                total = part(batch) if total is None else merge(total, part(batch))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f8").tobytes()], pa.binary())], ["a"])

    either = lambda a, b: b if a is None else a if b is None else merge(a, b)
    return df.mapInArrow(run, "a binary").rdd.map(lambda r: np.frombuffer(bytes(r[0]), "<f8")).treeAggregate(None, either, either)


def _moments(c: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weight, means and centred products, as one array."""
    n = w.sum()
    mean = (c * w[:, None]).sum(0) / n
    centred = c - mean
    return np.concatenate([[n], mean, ((centred * w[:, None]).T @ centred).ravel()])


def _with_moments(k: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = a[0] + b[0]
        apart = b[1 : k + 1] - a[1 : k + 1]
        products = a[k + 1 :] + b[k + 1 :] + np.outer(apart, apart).ravel() * (a[0] * b[0] / n)
        return np.concatenate([[n], a[1 : k + 1] + apart * (b[0] / n), products])

    return merge


def whiten(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, weights: str = "one", scale: int = SCALE, offset: int = OFFSET
) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable vector and component.

    Entries become whole numbers x; equal x vectors are grouped, and each distinct one counts once (``weights='one'``) or as often as
    it occurs (``'count'``). Sums and n are exact. The covariance is made of n * x - S, divided by n in double precision and multiplied
    only then: a matrix for each task, added up a tree of tasks. Its eigenvectors are
    found once. Each distinct vector is whitened once and its values are joined to the rows that have it; Spark deals a
    hot vector's rows out, as the other side has one row for it.

    Null vectors and those with null or non-finite entries give no rows, and neither do vectors whose length isn't the commonest
    one (of several, the greatest). Components without variance (eigenvalues that are rounding errors only) are left out, so a
    single distinct vector, equal vectors or no rows at all give no rows. A null id stays, repeated rows give rows each, and entries beyond 2**62 / ``scale``
    count as that. A deviation beyond a long is null. Other columns are ignored, whatever their names.
    """
    if weights not in ("one", "count"):
        raise ValueError("weights are 'one' or 'count'")
    vector = F.col(vector_col)
    usable = rows.where(finite(vector)).select(F.col(id_col).cast("long").alias("vec_id"), fixed_point(vector, scale, offset).alias("x"))
    lengths = usable.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"))
    d = lengths.agg(F.max_by("d", F.struct("n", "d"))).first()[0]
    nothing = rows.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    if not d:
        return nothing
    usable = usable.where(F.size("x") == d)
    weight = F.count("*") if weights == "count" else F.lit(1).cast("long")
    fit = cut_lineage(usable.groupBy("x").agg(F.count("*").alias("copies")).select("x", (F.col("copies") if weights == "count" else F.lit(1).cast("long")).alias("w")))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for batch in batches:
            if batch.num_rows:
                w = batch.column(1).to_numpy()
                n += int(w.sum())
                total = [a + b for a, b in zip(total, exact_sums(_vectors(batch), w), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), pa.array([str(v) for v in (n, *total)])], ["i", "v"])

    parts = fit.select("x", "w").mapInArrow(sums, "i int, v string")
    totals = {r["i"]: int(r["v"]) for r in parts.groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()}
    n, s = totals[-1], [totals[i] for i in range(d)]

    def centred(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        m = scaled_deviations(_vectors(batch), n, s)
        return m, m.astype(np.float64) / n

    def products(batch: pa.RecordBatch) -> np.ndarray:
        _, c = centred(batch)
        return ((c * batch.column(1).to_numpy()[:, None]).T @ c).ravel()

    v = _reduced(fit.select("x", "w"), products, np.add).reshape(d, d) / n
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > max(values.max(), 0) * d * np.finfo(float).eps]
    e, u = values[order], vectors[:, order]
    if not len(e):
        return nothing
    u = u * np.where(u[np.abs(u).argmax(0), np.arange(len(e))] < 0, -1.0, 1.0)
    to_white, k = u / np.sqrt(e), len(e)

    def white(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, c = centred(batch)
            flat = pa.array((c @ to_white).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (batch.num_rows + 1) * k, k, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(squares(m), pa.int64()), lists], ["x", "w", "deviation", "white"])

    done = cut_lineage(fit.select("x", "w").mapInArrow(white, "x array<bigint>, w bigint, deviation bigint, white array<double>"))

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        return _moments(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, k), batch.column(1).to_numpy().astype(np.float64))

    m = _reduced(done.select("white", "w"), moments, _with_moments(k))
    error = float(np.abs(m[k + 1 :].reshape(k, k) / m[0] - np.eye(k)).max())
    shares = F.array(*(F.lit(float(x)) for x in e / np.trace(v)))
    joined = usable.join(few(done.drop("w"), F.lit(8 * (d + k))), "x")
    out = joined.select("vec_id", "deviation", F.posexplode("white").alias("pos", "whitened"))
    return out.select(
        "vec_id", (F.col("pos") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.element_at(shares, F.col("pos") + 1).alias("explained"), F.lit(error).alias("identity_error")
    )
