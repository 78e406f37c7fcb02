"""Embedding whitening by spectrum slicing.

Counts, sums and centred products over all distinct vectors come from Spark as
exact integers, so the covariance doesn't depend on the partitioning. Of this
dimension x dimension matrix (all that the driver holds) the leading
eigenpairs are found by slicing the spectrum: the inertia of an LDLᵀ
factorization of V - sI counts the eigenvalues below s, bisection isolates one
eigenvalue after the other, Rayleigh quotient iteration converges from there,
and counts on both sides of the result certify its number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tessera.llm.common import materialize

COMPONENTS = 4
SCALE = 256
_SAFE = 1 << 53  # integers that doubles hold exactly


# ---------------------------------------------------------------- spectrum slicing

def eigenvalues_below(a: np.ndarray, shift: float) -> int:
    """Eigenvalues of the symmetric ``a`` below ``shift``: negative pivots of LDLᵀ with 1 x 1 and 2 x 2 pivots (Bunch-Parlett)."""
    m = a - shift * np.eye(len(a))
    alpha, below = (1 + math.sqrt(17)) / 8, 0
    while len(m):
        diagonal = np.abs(np.diag(m))
        p = int(np.argmax(diagonal))
        off = np.abs(m - np.diag(np.diag(m)))
        r, s = np.unravel_index(int(np.argmax(off)), off.shape)
        if diagonal[p] == 0 and off[r, s] == 0:
            break  # what is left is zero: eigenvalues equal to the shift
        if diagonal[p] >= alpha * off[r, s]:
            rest = np.delete(np.arange(len(m)), p)
            pivot, column = m[p, p], m[rest, p]
            m = m[np.ix_(rest, rest)] - np.outer(column, column / pivot)
            below += pivot < 0
        else:
            rest = np.delete(np.arange(len(m)), [r, s])
            pivot, column = m[np.ix_([r, s], [r, s])], m[np.ix_(rest, [r, s])]
            m = m[np.ix_(rest, rest)] - column @ np.linalg.solve(pivot, column.T)
            m = (m + m.T) / 2
            below += 1  # such a pivot has one negative and one positive eigenvalue
    return int(below)


def _solve(a: np.ndarray, shift: float, b: np.ndarray, tiny: float) -> np.ndarray:
    for _ in range(3):
        try:
            x = np.linalg.solve(a - shift * np.eye(len(a)), b)
            if np.isfinite(x).all() and np.any(x):
                return x / np.linalg.norm(x)
        except np.linalg.LinAlgError:
            pass
        shift += tiny
    return b


def _apart(x: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for v in found:
            x = x - (v @ x) * v
    return x / np.linalg.norm(x)


def leading_pairs(v: np.ndarray, count: int) -> list[tuple[float, np.ndarray]]:
    """The ``count`` largest eigenvalues above rounding, falling, with unit eigenvectors (their largest entry positive).

    Each number is certified by inertia counts; equal eigenvalues share a
    slice and get any orthonormal vectors of their space. Eigenvalues that are
    zero but for rounding have no pair.
    """
    d = len(v)
    norm = float(np.abs(v).sum(axis=1).max()) if d else 0.0
    tiny = max(norm, 1e-300) * np.finfo(float).eps
    out: list[tuple[float, np.ndarray]] = []

    def above(s: float) -> int:
        """Eigenvalues at or above ``s``."""
        return d - eigenvalues_below(v, s)

    low_end = 4 * d * tiny
    for number in range(1, min(count, d) + 1):
        if not norm or above(low_end) < number:
            break
        low, high = low_end, norm * (1 + 1e-12) + tiny  # above(low) >= number > above(high)
        found = [vec for _, vec in out]
        start = _apart(np.cos(np.arange(1, d + 1) * (1.0 + number)), found)
        while True:
            # isolate: one eigenvalue in [low, high), or a slice as narrow as rounding
            while high - low > 8 * tiny and above(low) - above(high) > 1:
                mid = (low + high) / 2
                low, high = (mid, high) if above(mid) >= number else (low, mid)
            narrow = high - low <= 8 * tiny
            x, value = start, (low + high) / 2
            for _ in range(3):  # inverse iteration picks the slice's vector
                x = _apart(_solve(v, value, x, tiny), found)
            value = float(x @ v @ x)
            for _ in range(8):  # Rayleigh quotient iteration
                if np.linalg.norm(v @ x - value * x) <= 2 * tiny:
                    break
                x = _apart(_solve(v, value, x, tiny), found)
                value = float(x @ v @ x)
            slack = 4 * d * tiny
            certified = low - slack <= value <= high + slack and above(value + slack) < number <= above(value - slack)
            if certified or narrow:
                break
            mid = (low + high) / 2
            low, high = (mid, high) if above(mid) >= number else (low, mid)
        x = x * (1 if x[int(np.argmax(np.abs(x)))] > 0 else -1)
        out.append((value, x))
    return out


# ---------------------------------------------------------------- statistics

def _vectors(batch: pa.RecordBatch, at: int, d: int) -> np.ndarray:
    column = batch.column(at)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def _integers(rows: np.ndarray, bound: int) -> np.ndarray:
    """``rows`` in a type in which sums up to ``bound`` are exact."""
    return rows if bound < 1 << 62 else rows.astype(object)


def _partial(names: list[str], cells: dict) -> pa.RecordBatch:
    """Exact totals as decimal rows."""
    keys = list(zip(*cells)) if cells else [()] * (len(names) - 1)
    return pa.RecordBatch.from_arrays([*(pa.array(k, pa.int32()) for k in keys), pa.array(list(map(str, cells.values())), pa.string())], names=names)


def _totals(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Rows and sums by dimension, exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * d, 0
        for batch in batches:
            if batch.num_rows:
                x = _vectors(batch, 0, d)
                most = max(abs(int(x.max())), abs(int(x.min())))
                total = [a + int(b) for a, b in zip(total, _integers(x, most * len(x)).sum(axis=0))]
                n += len(x)
        yield _partial(["i", "v"], {(i,): t for i, t in enumerate([*total, n]) if n})

    rows = fit.mapInArrow(run, "i int, v string").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).cast("string").alias("v")).collect()
    got = {r["i"]: int(r["v"]) for r in rows}  # one row for each dimension
    return got.get(d, 0), [got.get(i, 0) for i in range(d)]


def _covariance(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Covariance with divisor n; rows are centred at the rounded mean before multiplying, and the remainder is taken off exactly."""
    d = len(sums)
    centre = [round(s / n) for s in sums]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d), object)
        seen = False
        for batch in batches:
            if not batch.num_rows:
                continue
            seen = True
            y = _vectors(batch, 0, d) - np.array(centre, np.int64)
            most = max(1, abs(int(y.max())), abs(int(y.min())))
            step = _SAFE // (most * most)
            if step:  # products of so many rows are exact in doubles
                f = y.astype(np.float64)
                for k in range(0, len(f), step):
                    part = f[k:k + step]
                    total += (part.T @ part).astype(np.int64).astype(object)
            else:
                o = y.astype(object)
                total += o.T @ o
        yield _partial(["i", "j", "v"], {(i, j): total[i, j] for i in range(d) for j in range(i + 1)} if seen else {})

    rows = fit.mapInArrow(run, "i int, j int, v string").groupBy("i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).cast("string").alias("v")).collect()
    rest = [s - n * c for s, c in zip(sums, centre)]
    v = np.zeros((d, d))
    for r in rows:  # dimension x dimension
        i, j = r["i"], r["j"]
        v[i, j] = v[j, i] = (n * int(r["v"]) - rest[i] * rest[j]) / (n * n)
    return v


def _usable(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id and x of the rows whose vector is there and finite."""
    infinite = float("inf")
    ok = F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < infinite))
    rows = vectors.select(vectors[id_col].alias("id"), vectors[vector_col].cast("array<double>").alias("v")).filter(ok & (F.size("v") > 0))
    return rows.select("id", F.transform("v", lambda c: F.floor(c * float(scale))).alias("x"))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """Whitened leading components of every row, fitted on each distinct vector once.

    Entries become floor(scale * c). Returns for each row and component (1, 2,
    ... by falling eigenvalue): ``id_col``, component, n (distinct vectors),
    deviation (squared distance from the mean, times n squared, exact),
    whitened, explained (share of the variance) and identity_error (largest
    entry of the whitened distinct vectors' covariance minus the identity, the
    same in all rows).

    Rows whose vector is null, empty or holds null or non-finite entries take
    no part, nor do vectors of another length than the most frequent (the
    smaller of equals). Repeated rows and null ids are rows like any other.
    Components without variance (one distinct vector, fewer dimensions) are
    left out; an empty table gives no rows; other columns are ignored. A
    deviation beyond 64 bits is an error.
    """
    spark = vectors.sparkSession
    out = StructType([StructField(id_col, vectors.schema[id_col].dataType, True)] + StructType.fromDDL(
        "component int, n long, deviation long, whitened double, explained double, identity_error double").fields)
    rows = _usable(vectors, id_col, vector_col, scale)
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], out)
    d = sizes[0]["d"]
    rows = rows.filter(F.size("x") == d)
    fit = materialize(rows.select("x").distinct(), "whitening-fit")
    n, sums = _totals(fit, d)
    v = _covariance(fit, n, sums)
    pairs = leading_pairs(v, components)
    if not pairs:
        return spark.createDataFrame([], out)
    k, trace = len(pairs), float(np.trace(v))
    project = np.stack([vec / math.sqrt(e) for e, vec in pairs], axis=1)
    explained = [e / trace for e, _ in pairs]

    def spread(x: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        most = max(abs(int(x.max())), abs(int(x.min())))
        bound = n * most + max(map(abs, sums))
        return _integers(x, bound) * n - (np.array(sums, np.int64) if bound < 1 << 62 else np.array(sums, object))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                w = (spread(_vectors(batch, 0, d)).astype(np.float64) / n) @ project
                total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k, dtype=np.int32), k)), pa.array(np.tile(np.arange(k, dtype=np.int32), k)), pa.array(total.ravel())],
                                         names=["i", "j", "v"])

    sums_w = fit.mapInArrow(products, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    error = max(abs(r["v"] / n - (r["i"] == r["j"])) for r in sums_w)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            apart = spread(_vectors(batch, 1, d))
            most = max(abs(int(apart.max())), abs(int(apart.min())))
            exact = _integers(apart, most * most * d)
            deviation = (exact * exact).sum(axis=1)
            w = (apart.astype(np.float64) / n) @ project
            if any(int(t) >= 1 << 63 for t in ([deviation.max()] if m else [])):
                raise OverflowError("the deviation of a vector doesn't fit 64 bits")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)),
                 pa.array(np.repeat(deviation.astype(np.int64), k)), pa.array(w.ravel()), pa.array(np.tile(np.array(explained), m)), pa.array(np.full(m * k, error))],
                names=out.names)

    return rows.select("id", "x").mapInArrow(each, out)
