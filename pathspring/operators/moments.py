"""Moments of complete cases: what nearly every estimator needs of the data.

Small sets of columns become one Catalyst aggregate; wide ones are reduced to
partial cross-products by NumPy, batch by batch. Either way each task sends one
small row. Products are taken around a shift (the means), against cancellation.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDE = 16
"""Columns from which the products are taken by NumPy."""


@dataclass(frozen=True)
class Moments:
    """names, cases n, sum of weights, means and centred cross-products."""

    names: tuple[str, ...]
    n: int
    weight: float
    mean: np.ndarray
    cross: np.ndarray

    def cov(self, ddof: int = 1) -> np.ndarray:
        return self.cross / (self.weight - ddof)

    def sd(self) -> np.ndarray:
        return np.sqrt(np.diag(self.cov()))

    def corr(self) -> np.ndarray:
        d = np.sqrt(np.diag(self.cross))
        if (d <= 0).any():
            raise ValueError(f"constant columns: {[n for n, x in zip(self.names, d) if x <= 0]}")
        r = self.cross / np.outer(d, d)
        np.fill_diagonal(r, 1.0)
        return r

    def of(self, names: Sequence[str]) -> Moments:
        i = [self.names.index(x) for x in names]
        return Moments(tuple(names), self.n, self.weight, self.mean[i], self.cross[np.ix_(i, i)])

    def minus(self, other: Moments) -> Moments:
        """Without the cases of the other: training moments of a fold, or all but one case."""
        w = self.weight - other.weight
        mean = (self.mean * self.weight - other.mean * other.weight) / w
        d = other.mean - mean
        whole = self.mean - mean
        cross = self.cross + self.weight * np.outer(whole, whole) - other.cross - other.weight * np.outer(d, d)
        return Moments(self.names, self.n - other.n, w, mean, cross)


def _complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=[*columns])


def shift_of(df: DataFrame, columns: Sequence[str]) -> list[float]:
    m = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return [0.0 if x is None else float(x) for x in m]


def moments_by(df: DataFrame, columns: Sequence[str], keys: Sequence[str], weight: str | None = None, shift: Sequence[float] | None = None) -> DataFrame:
    """keys, n, w, sums, products: raw sums around a shift by key (products in upper-triangle order)."""
    df = _complete(df, columns)
    shift = shift_of(df, columns) if shift is None else shift
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    x = [F.col(c).cast("double") - F.lit(float(s)) for c, s in zip(columns, shift)]
    p = len(columns)
    sums = [F.sum(w * a).alias(f"s{i}") for i, a in enumerate(x)]
    products = [F.sum(w * x[i] * x[j]).alias(f"p{i}_{j}") for i in range(p) for j in range(i, p)]
    t = df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(w).alias("w"), *sums, *products)
    return t.select(*keys, "n", "w", F.array(*[f"s{i}" for i in range(p)]).alias("sums"), F.array(*[f"p{i}_{j}" for i in range(p) for j in range(i, p)]).alias("products"))


def unpack(names: Sequence[str], n: int, w: float, sums, products, shift) -> Moments:
    p = len(names)
    s = np.asarray(sums, dtype=float)
    m = np.zeros((p, p))
    m[np.triu_indices(p)] = np.asarray(products, dtype=float)
    m = np.triu(m) + np.triu(m, 1).T
    return Moments(tuple(names), int(n), float(w), s / w + np.asarray(shift), m - np.outer(s, s) / w)


def moments(df: DataFrame, columns: Sequence[str], weight: str | None = None) -> Moments:
    """The moments of the complete cases of the columns."""
    if len(columns) <= WIDE:
        full = _complete(df, columns)
        shift = shift_of(full, columns)
        r = moments_by(full, columns, [], weight, shift).first()
        if not r["n"]:
            raise ValueError("no complete case")
        return unpack(columns, r["n"], r["w"], r["sums"], r["products"], shift)
    p = len(columns)

    def partial(batches):
        n, w, mean, cross = 0, 0.0, np.zeros(p), np.zeros((p, p))
        for batch in batches:
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(p)])
            v = batch.column(p).to_numpy(zero_copy_only=False)
            full = ~np.isnan(x).any(axis=1)  # here and not in a filter: one of many columns makes the optimizer slow
            x, v = x[full], v[full]
            if not len(v):
                continue
            m = v @ x / v.sum()
            c = (x - m).T @ ((x - m) * v[:, None])
            both = w + v.sum()
            d = m - mean
            cross += c + np.outer(d, d) * (w * v.sum() / both)
            mean = mean + d * (v.sum() / both)
            n, w = n + len(v), both
        yield pa.RecordBatch.from_pydict({"n": [n], "w": [w], "mean": [mean.tolist()], "cross": [cross.ravel().tobytes()]})

    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    t = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)], w.alias("v"))
    total: Moments | None = None
    for r in t.mapInArrow(partial, "n long, w double, mean array<double>, cross binary").filter("n > 0").toLocalIterator():
        part = Moments(tuple(columns), r["n"], r["w"], np.array(r["mean"]), np.frombuffer(r["cross"]).reshape(p, p))
        if total is None:
            total = part
            continue
        both, d = total.weight + part.weight, part.mean - total.mean
        cross = total.cross + part.cross + np.outer(d, d) * (total.weight * part.weight / both)
        total = Moments(total.names, total.n + part.n, both, total.mean + d * (part.weight / both), cross)
    if total is None:
        raise ValueError("no complete case")
    return total


def covariances(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, int]:
    """The covariance matrix of the complete cases and their number, for few columns.

    Spark's running covariances need no shift, so the frame is computed once and not
    twice as by ``moments``.
    """
    x = [F.col(c).cast("double") for c in columns]
    rows, cols = np.triu_indices(len(columns))
    r = _complete(df, columns).agg(F.count("*").alias("n"), *[F.covar_samp(x[i], x[j]).alias(f"c{i}_{j}") for i, j in zip(rows, cols)]).first()
    if not r["n"]:
        raise ValueError("no complete case")
    m = np.zeros((len(columns),) * 2)
    m[rows, cols] = m[cols, rows] = np.array(r[1:], dtype=float)
    return m, r["n"]
