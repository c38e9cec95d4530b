"""Embedding whitening by cyclic Jacobi.

Vectors become whole numbers. Over the distinct ones, tasks sum the products of entries centred at the rounded mean,
and the rest of the mean is taken off in whole numbers too: the covariance is the exact one, rounded once, whatever the
order of the rows. The driver, which gets d*(d+1)/2 sums for d dimensions, applies symmetric rotations, cyclically over
all pairs in rounds of disjoint ones, until every off-diagonal entry is lost beside its two diagonal ones; that criterion
keeps small eigenvalues accurate. The sorted whitening matrix is broadcast (components*d numbers) to project all rows.

Cases: rows go whose vector is null or holds a null or non-finite entry; where lengths differ, the commonest length
stays (of several the longest) and rows of others go; empty vectors have no component; repeated vectors are fitted
once, and all their rows are returned; a null vec_id stays null; a component without variance (an eigenvalue of at
most 1e-13 of the trace, as with one vector) has whitened null and does not count in identity_error, which is 0 where none
is left; without any variance explained is 0; entries beyond 2**62 / 256 are cut there; a deviation beyond 64 bits is null; other columns are
never looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.session import remove, ship, written

GRID = 256
COMPONENTS = 4
MOST = float(1 << 62)
EXACT = 1 << 53
NO_VARIANCE = 1e-13


def sound(vector: Column) -> Column:
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def whole(vector: Column) -> Column:
    """floor(GRID*c) of each entry as a long."""
    return F.transform(vector, lambda c: F.floor(F.least(F.greatest(c.cast("double") * GRID, F.lit(-MOST)), F.lit(MOST))))


def _matrix(column: pa.Array) -> np.ndarray:
    """A batch's vectors, all of one length, as an array of longs."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _product(x: np.ndarray) -> np.ndarray:
    """x'x in whole numbers: by floating point where all sums are exact in it."""
    top = int(np.abs(x).max(initial=0)) if x.dtype != object else max((abs(v) for v in x.flat), default=0)
    if top * top * len(x) < EXACT:
        f = x.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    y = x.astype(object)
    return y.T.dot(y)


def _scatter(centre: list[int]):
    """Sums of products of centred entries, as rows (i, j, s) with i <= j."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                x = _matrix(batch.column(0))
                small = np.abs(x).max(initial=0) < 1 << 61 and max(map(abs, centre)) < 1 << 61
                part = _product(x - np.array(centre, np.int64 if small else object))
                total = part if total is None else total + part
        if total is not None:
            i, j = np.triu_indices(len(centre))
            yield pa.record_batch([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array([str(v) for v in total[i, j]])], ["i", "j", "s"])

    return run


def jacobi(a: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of a symmetric matrix, by falling eigenvalue."""
    a, d = np.array(a, np.float64), len(a)
    v = np.eye(d)
    order = np.arange(d + d % 2)  # round robin: each round pairs all indices, d - 1 rounds pair every two once
    eps = np.finfo(float).eps / 4
    for _ in range(sweeps):
        turned = False
        for _ in range(len(order) - 1):
            p, q = order[: len(order) // 2], order[len(order) // 2 :][::-1]
            p, q = np.minimum(p, q), np.maximum(p, q)
            real = q < d
            p, q = p[real], q[real]
            off = a[p, q]
            do = np.abs(off) > eps * np.sqrt(np.abs(a[p, p] * a[q, q]))
            p, q, off = p[do], q[do], off[do]
            if len(p):
                turned = True
                with np.errstate(over="ignore"):
                    theta = (a[q, q] - a[p, p]) / (2 * off)
                    t = np.where(theta < 0, -1.0, 1.0) / (np.abs(theta) + np.hypot(theta, 1))
                c = 1 / np.hypot(t, 1)
                s = c * t
                for m in (a.T, a, v.T):  # columns of a, its rows, and columns of v
                    x, y = m[p], m[q]
                    m[p], m[q] = c[:, None] * x - s[:, None] * y, s[:, None] * x + c[:, None] * y
                a[p, q] = a[q, p] = 0.0
            order = np.concatenate([order[:1], order[-1:], order[1:-1]])
        if not turned:
            break
    e = np.diag(a).copy()
    by = np.argsort(-e, kind="stable")
    return e[by], v[:, by]


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors with sums by dimension; of each component its eigenvalue, its share of the trace and the vector by which centred entries are multiplied (null without variance)."""

    n: int
    sums: list[int]
    values: list[float]
    explained: list[float]
    vectors: np.ndarray


def covariance(n: int, sums: list[int], centre: list[int], products: dict[tuple[int, int], int]) -> np.ndarray:
    """The covariance with divisor n from sums of products centred at whole numbers, exact but for one rounding."""
    d = [s - n * m for s, m in zip(sums, centre, strict=True)]
    out = np.empty((len(d), len(d)))
    for (i, j), p in products.items():
        out[i, j] = out[j, i] = (n * p - d[i] * d[j]) / (n * n)
    return out


def fit(spark: SparkSession, distinct: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of distinct vectors x, longs of one length; None without any, or without a dimension."""
    ship(spark)
    sums = distinct.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("s"), F.count("*").alias("n")).orderBy("i").collect()
    if not sums:
        return None
    n, s = sums[0].n, [int(r.s) for r in sums]
    centre = [(2 * v + n) // (2 * n) for v in s]
    parts = distinct.select("x").mapInArrow(_scatter(centre), "i int, j int, s string")
    rows = parts.groupBy("i", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    v = covariance(n, s, centre, {(r.i, r.j): int(r.s) for r in rows})
    e, u = jacobi(v)
    trace = float(np.trace(v))
    e, u = e[:components], u[:, :components]
    some = e > NO_VARIANCE * trace
    scale = np.where(some, 1 / np.sqrt(np.where(some, e, 1)), np.nan)
    return Whitening(n, s, [float(x) for x in e], [float(x) / trace if trace else 0.0 for x in e], u * scale)


def _centred(x: np.ndarray, w: Whitening) -> np.ndarray:
    """x - S/n to double precision, the whole part of the mean taken off first."""
    floors = np.array([s // w.n for s in w.sums], np.int64)
    return (x - floors).astype(np.float64) - np.array([s % w.n / w.n for s in w.sums])


def _moments(w: Whitening):
    """Of whitened vectors the count, sums and sums of products, as rows (i, j, s)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                y = np.column_stack([_centred(_matrix(batch.column(0)), w) @ w.vectors, np.ones(len(batch))])
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.record_batch([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "s"])

    return run


def identity_error(distinct: DataFrame, w: Whitening) -> float:
    """The largest absolute entry of the measured covariance of the whitened distinct vectors minus the identity."""
    k = w.vectors.shape[1]
    rows = distinct.select("x").mapInArrow(_moments(w), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    m = np.zeros((k + 1, k + 1))
    for r in rows:
        m[r.i, r.j] = m[r.j, r.i] = r.s
    mean = m[:k, k] / m[k, k]
    off = np.abs(m[:k, :k] / m[k, k] - np.outer(mean, mean) - np.eye(k))
    return float(np.nanmax(np.where(np.isnan(off), 0, off), initial=0))


def _project(w: Whitening):
    """(id, x) with the whitened components and the exact deviation."""
    sums = w.sums
    top = max(map(abs, sums))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1)) if len(batch) else np.empty((0, len(sums)), np.int64)
            most = w.n * int(np.abs(x).max(initial=0)) + top
            kind = np.int64 if most * most * len(sums) < 1 << 63 else object
            d = x.astype(kind) * w.n - np.array(sums, kind)
            deviation = [v if v < 1 << 63 else None for v in (d * d).sum(1).tolist()]
            y = _centred(x, w) @ w.vectors
            flat = pa.array(y.ravel(), mask=np.isnan(y.ravel()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]), flat)
            yield pa.record_batch([batch.column(0), pa.array(deviation, pa.int64()), lists], ["id", "deviation", "y"])

    return run


def whiten(spark: SparkSession, rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each row kept and component."""
    ship(spark)
    kept = rows.filter(sound(F.col(vector_col))).select(F.col(id_col).alias("id"), whole(F.col(vector_col)).alias("x"))
    kept = written(spark, kept, "vectors")
    lengths = kept.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("d")).limit(1).collect()
    if lengths:
        kept = kept.filter(F.size("x") == lengths[0].d)
    distinct = written(spark, kept.select("x").distinct(), "distinct")
    w = fit(spark, distinct, components)
    kind = rows.schema[id_col].dataType.simpleString()
    columns = f"{id_col} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if w is None:
        return spark.createDataFrame([], columns)
    error = identity_error(distinct, w)
    remove(spark, distinct)
    told = kept.mapInArrow(_project(w), f"id {kind}, deviation long, y array<double>").select("id", "deviation", F.posexplode("y").alias("k", "whitened"))
    explained = F.element_at(F.array(*[F.lit(x) for x in w.explained]), F.col("k") + 1)
    return told.select(F.col("id").alias(id_col), (F.col("k") + 1).alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))
