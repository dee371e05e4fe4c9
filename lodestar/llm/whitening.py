"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Entries are put on a grid of whole numbers, so sums are exact. Two passes over the vectors gather the sums and then the
scatter about the mean, both added up within tasks first; what reaches the driver is one matrix of dimension times
dimension numbers, however many vectors there are. With P'VP = LL' for the covariance V, rotations of pairs of columns
of L make these orthogonal without ever forming a product again: the squared norms of the rotated columns are the
eigenvalues of V, and the normalised columns, with the rows put back in place, are its unit eigenvectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import fsum

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage

#: Entries from here on leave the range of whole numbers that a long holds on the grid.
LARGEST = 2.0**51
ROWS = 4096
EPS = np.finfo(float).eps


@dataclass(frozen=True)
class Whitening:
    """A fitted transform: whitened = (x - centre - rest) @ basis / sqrt(values), x on the grid; centre + rest is the mean."""

    n: int
    centre: np.ndarray
    rest: np.ndarray
    basis: np.ndarray
    values: np.ndarray
    trace: float

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows; NaN along components of no variance."""
        rows = np.full((len(x), len(self.values)), np.nan)
        some = self.values > 0
        rows[:, some] = ((x - self.centre).astype(float) - self.rest) @ (self.basis[:, some] / np.sqrt(self.values[some]))
        return rows

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sum of (n*x - S)**2 of each row, exact: with z = x - centre and s = S - n*centre it is a quadratic in n of whole sums."""
        z = x - self.centre
        s = np.round(self.rest * self.n).astype(np.int64)
        most = int(np.abs(z).max(initial=0))
        if most * max(self.n, most) >= 2**62 // z.shape[1]:
            z, s = z.astype(object), s.astype(object)
        squares, crossed, rest = (z * z).sum(axis=1).tolist(), (z * s).sum(axis=1).tolist(), sum(int(v) ** 2 for v in s)
        return [self.n**2 * int(a) - 2 * self.n * int(b) + rest for a, b in zip(squares, crossed, strict=True)]


def pivoted_cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order) with v[order][:, order] = L @ L.T, as many columns as v has rank; the largest diagonal that is left comes next."""
    v, d = v.copy(), len(v)
    order, low, floor = np.arange(d), np.zeros((d, d)), d * EPS * max(v.diagonal().max(), 0.0)
    for k in range(d):
        p = k + int(np.argmax(v.diagonal()[k:]))
        if not v[p, p] > floor:
            return low[:, :k], order
        for m in (v, low):
            m[[k, p]] = m[[p, k]]
        v[:, [k, p]] = v[:, [p, k]]
        order[[k, p]] = order[[p, k]]
        low[k, k] = np.sqrt(v[k, k])
        low[k + 1 :, k] = v[k + 1 :, k] / low[k, k]
        v[k + 1 :, k + 1 :] -= np.outer(low[k + 1 :, k], low[k + 1 :, k])
    return low, order


def one_sided_jacobi(a: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """a with its columns rotated in pairs until all are orthogonal; each round of a sweep takes disjoint pairs together."""
    a = a.T.copy()
    n = len(a) + len(a) % 2
    seats = np.arange(n)
    for _ in range(sweeps):
        still = True
        for _ in range(n - 1):
            p, q = np.minimum(seats[: n // 2], seats[: n // 2 - 1 : -1]), np.maximum(seats[: n // 2], seats[: n // 2 - 1 : -1])
            p, q = p[q < len(a)], q[q < len(a)]
            x, y = a[p], a[q]
            alpha, beta, gamma = (x * x).sum(axis=1), (y * y).sum(axis=1), (x * y).sum(axis=1)
            turn = np.abs(gamma) > 4 * EPS * np.sqrt(alpha * beta)
            if turn.any():
                still = False
                p, q, x, y = p[turn], q[turn], x[turn], y[turn]
                zeta = (beta[turn] - alpha[turn]) / (2 * gamma[turn])
                t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                c = 1 / np.hypot(1.0, t)
                s = c * t
                a[p], a[q] = c[:, None] * x - s[:, None] * y, s[:, None] * x + c[:, None] * y
            seats = np.concatenate((seats[:1], seats[-1:], seats[1:-1]))
        if still:
            break
    return a.T


def principal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a covariance, falling, and unit eigenvectors in columns, the largest entry of each positive. Values of 0 have columns of 0."""
    low, order = pivoted_cholesky(v)
    turned = one_sided_jacobi(low)
    norms = np.sqrt((turned**2).sum(axis=0))
    by = np.argsort(-norms, kind="stable")
    values, basis = np.zeros(len(v)), np.zeros_like(v)
    values[: len(by)] = norms[by] ** 2
    basis[order, : len(by)] = turned[:, by] / norms[by]
    largest = np.abs(basis).argmax(axis=0)
    return values, basis * np.where(basis[largest, np.arange(len(v))] < 0, -1.0, 1.0)


def _grids(frames: Iterator[pd.DataFrame], scale: float, shift: int) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for frame in frames:
        for at in range(0, len(frame), ROWS):
            part = frame.iloc[at : at + ROWS]
            yield part, np.floor(scale * np.array(part["embedding"].tolist(), float)).astype(np.int64) + shift


def _sums(length: int, scale: float, shift: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, high, low = 0, np.zeros(length, np.int64), np.zeros(length, np.int64)
        for _, x in _grids(frames, scale, shift):
            n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        yield pd.DataFrame({"i": np.arange(length), "n": n, "high": high, "low": low})

    return run


def _scatter(length: int, centre: np.ndarray, rest: np.ndarray, scale: float, shift: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((length, length))
        for _, x in _grids(frames, scale, shift):
            y = (x - centre).astype(float) - rest
            total += y.T @ y
        yield pd.DataFrame({"i": np.arange(length), "row": list(total)})

    return run


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    """One row of the matrix, added up over all tasks; fsum rounds once, so the order of the tasks doesn't matter."""
    return pd.DataFrame({"i": rows["i"].iloc[:1], "row": [[fsum(c) for c in zip(*rows["row"], strict=True)]]})


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    rows = vectors.select(F.col(id_col).cast("string").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    return rows.where(f"size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < {LARGEST!r}D)")


def fit(vectors: DataFrame, components: int = 8, scale: float = 1024.0, shift: int = 100_000, id_col: str = "vec_id", vector_col: str = "embedding") -> Whitening | None:
    """The transform to the first components of the vectors' covariance; None if there is no usable vector."""
    rows = _usable(vectors, id_col, vector_col)
    most = rows.groupBy(F.size("embedding").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    if most is None:
        return None
    length, rows = most["length"], rows.where(F.size("embedding") == most["length"])
    big = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    sums = rows.mapInPandas(_sums(length, scale, shift), "i int, n long, high long, low long").groupBy("i").agg(big("n"), big("high"), big("low")).orderBy("i").collect()
    n, total = int(sums[0]["n"]), [(int(r["high"]) << 32) + int(r["low"]) for r in sums]
    centre, rest = np.array([s // n for s in total], np.int64), np.array([s % n / n for s in total])
    parts = rows.mapInPandas(_scatter(length, centre, rest, scale, shift), "i int, row array<double>")
    scatter = parts.groupBy("i").applyInPandas(_added, "i int, row array<double>").orderBy("i").collect()
    v = np.array([r["row"] for r in scatter]) / n
    values, basis = principal((v + v.T) / 2)
    k = min(components, length)
    return Whitening(n, centre, rest, basis[:, :k], values[:k], float(np.trace(v)))


def _whitened(model: Whitening, scale: float, shift: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, x in _grids(frames, scale, shift):
            exact = [d if d < 2**63 else None for d in model.deviations(x)]
            yield pd.DataFrame({"vec_id": part["vec_id"], "deviation": pd.array(exact, "Int64"), "whitened": list(model.project(x))})

    return run


def _products(k: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k + 1, k))  # the last row: sums
        for frame in frames:
            w = np.array(frame["whitened"].tolist(), float).reshape(-1, k)
            total += np.concatenate((w.T @ w, w.sum(axis=0)[None]))
        i, j = np.indices(total.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": total.ravel()})

    return run


def identity_error(whitened: DataFrame, model: Whitening) -> float | None:
    """The largest entry of the whitened vectors' covariance minus the identity, over components that have variance; None if none has."""
    k = len(model.values)
    c = np.zeros((k + 1, k))
    for r in whitened.select("whitened").mapInPandas(_products(k), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        c[r["i"], r["j"]] = r["v"] / model.n
    some = model.values > 0
    off = np.abs(c[:-1] - np.outer(c[-1], c[-1]) - np.eye(k))[np.ix_(some, some)]
    return float(off.max()) if some.any() else None


def whiten(vectors: DataFrame, components: int = 8, scale: float = 1024.0, shift: int = 100_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Whitens vectors along their first principal components, fitted on all of them.

    An entry c counts as the whole number x = floor(scale * c) + shift. Returns one row per usable vector: vec_id long, n
    long (vectors fitted on), deviation long (the sum of (n*x - S)**2 over the dimensions, S being the sums of x; null
    where it is beyond a long), whitened array<double> (up to ``components`` entries, by falling variance), explained
    array<double> (each component's share of the variance; null if there is no variance), identity_error double.

    Vectors that are null or empty, hold a null, a NaN or an infinite entry, or one of 2**51 or more, are left out; so are
    those of another length than most (ties: the longer one), as they have no covariance with the rest. A component
    without variance, as beyond the rank of a few or equal vectors, has null in ``whitened`` and 0 in ``explained``, and
    identity_error passes over it (null if no component has variance). Null and repeated ids are rows like others; other
    columns are ignored. A table without usable vectors gives no rows.
    """
    spark = vectors.sparkSession
    model = fit(vectors, components, scale, shift, id_col, vector_col)
    if model is None:
        return spark.createDataFrame([], "vec_id long, n long, deviation long, whitened array<double>, explained array<double>, identity_error double")
    rows = _usable(vectors, id_col, vector_col).where(F.size("embedding") == len(model.centre))
    found = Stage(spark, "whitening")(rows.mapInPandas(_whitened(model, scale, shift), "vec_id string, deviation long, whitened array<double>"))
    error = identity_error(found, model)
    explained = [F.lit(float(e) / model.trace if model.trace > 0 else None).cast("double") for e in model.values]
    return found.select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.array(*explained).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
