"""Partial least squares path modelling on moments.

Scores are linear in the indicators, so the iteration of Wold and Lohmöller runs on
the indicators' covariance matrix alone: one distributed aggregate, then a small
dense problem. Consistent PLS (Dijkstra and Henseler) corrects the scores'
correlations for attenuation. Scores themselves are one projection of the frame.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathspring.operators.moments import Moments, moments
from pathspring.plans.model import ModelError, PathModel

TOLERANCE = 1e-7
MOST_ITERATIONS = 3000


@dataclass(frozen=True)
class Fit:
    """Weights (p x K), score correlations, loadings (p x K), path coefficients b[i, j] from i to j, and more."""

    model: PathModel
    moments: Moments
    s: np.ndarray
    weights: np.ndarray
    scores: np.ndarray
    loadings: np.ndarray
    paths: np.ndarray
    r2: np.ndarray
    iterations: int
    rho_a: np.ndarray | None = None

    def total(self) -> np.ndarray:
        return total_effects(self.paths)


def total_effects(b: np.ndarray) -> np.ndarray:
    """b + b^2 + ... for paths without a cycle."""
    return np.linalg.inv(np.eye(len(b)) - b) - np.eye(len(b))


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    values = np.linalg.eigvalsh(a)
    if values[0] <= values[-1] * len(a) * np.finfo(float).eps * 100:
        raise ModelError("predictors or indicators are linearly dependent")
    return np.linalg.solve(a, b)


def structural(model: PathModel, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares paths and R2 by construct, from score correlations."""
    k, a = len(c), model.adjacency()
    b, r2 = np.zeros((k, k)), np.full(k, np.nan)
    for j in range(k):
        x = np.flatnonzero(a[:, j])
        if len(x):
            b[x, j] = _solve(c[np.ix_(x, x)], c[x, j])
            r2[j] = c[x, j] @ b[x, j]
    return b, r2


def _oriented(w: np.ndarray) -> np.ndarray:
    first = np.flatnonzero(np.abs(w) > 1e-12)
    return -w if len(first) and w[first[0]] < 0 else w


def outer_weights(model: PathModel, s: np.ndarray, scheme: str = "path", start: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """Weights (p x K) of unit-variance scores, and iterations. Schemes: path, factor, pca."""
    names, k = model.names, len(model.constructs)
    blocks = [model.block(n) for n in names]
    w = np.zeros((len(s), k))
    for j, block in enumerate(blocks):
        sub = s[np.ix_(block, block)]
        if scheme == "pca":
            v = np.linalg.eigh(sub)[1][:, -1]
            v = v if v @ sub @ np.ones(len(block)) >= 0 else -v
        else:
            v = np.ones(len(block)) if start is None else start[block, j]
        w[block, j] = v / np.sqrt(v @ sub @ v)
    if scheme == "pca":
        return w, 1
    a = model.adjacency()
    for iteration in range(1, MOST_ITERATIONS + 1):
        c = w.T @ s @ w
        e = np.zeros((k, k))
        for j in range(k):
            before, after = np.flatnonzero(a[:, j]), np.flatnonzero(a[j])
            if not len(before) and not len(after):
                e[j, j] = 1
            elif scheme == "factor":
                both = np.union1d(before, after)
                e[both, j] = c[both, j]
            else:
                e[after, j] = c[after, j]
                if len(before):
                    e[before, j] = _solve(c[np.ix_(before, before)], c[before, j])
            size = e[:, j] @ c @ e[:, j]
            if size <= 0:
                raise ModelError(f"construct {names[j]} has no association with its neighbours")
            e[:, j] /= np.sqrt(size)
        z = s @ w @ e
        new = np.zeros_like(w)
        for j, block in enumerate(blocks):
            sub = s[np.ix_(block, block)]
            v = z[block, j] if model.constructs[j].mode == "A" else _solve(sub, z[block, j])
            new[block, j] = _oriented(v / np.sqrt(v @ sub @ v))
        change = np.abs(new - w).max()
        w = new
        if change <= TOLERANCE:
            return w, iteration
    raise ModelError(f"no convergence in {MOST_ITERATIONS} iterations")


def rho_a(s: np.ndarray, w: np.ndarray) -> float | None:
    """Dijkstra and Henseler's reliability of one block's score; None where it has no value."""
    if len(w) == 1:
        return None
    inner = np.outer(w, w)
    np.fill_diagonal(inner, 0)
    below = w @ inner @ w
    off = s - np.diag(np.diag(s))
    return float((w @ w) ** 2 * (w @ off @ w) / below) if below > 1e-14 else None


def fit(model: PathModel, m: Moments, scheme: str = "path", preprocess: str = "standardized", consistent: bool = False, start: np.ndarray | None = None) -> Fit:
    """The estimates from moments of the model's indicators."""
    m = m.of(model.indicators)
    s = m.corr() if preprocess == "standardized" else m.cov()
    w, iterations = outer_weights(model, s, scheme, start)
    c = w.T @ s @ w
    loadings = (s @ w) / np.sqrt(np.diag(s))[:, None]
    rho = None
    if consistent:
        rho = np.ones(len(model.constructs))
        for j, construct in enumerate(model.constructs):
            block = model.block(construct.name)
            if construct.mode == "A" and len(block) > 1:
                r = rho_a(s[np.ix_(block, block)], w[block, j])
                if r is None or not 0 < r <= 1:
                    raise ModelError(f"reliability of {construct.name} is improper: {r}")
                rho[j] = r
                v = w[block, j]
                loadings[block, j] = v * np.sqrt(r) / (v @ v) / np.sqrt(np.diag(s))[block]
        c = c / np.sqrt(np.outer(rho, rho))
        np.fill_diagonal(c, 1.0)
        if np.abs(c).max() > 1 + 1e-12:
            raise ModelError("a corrected correlation is improper")
    b, r2 = structural(model, c)
    return Fit(model, m, s, w, c, loadings, b, r2, iterations, rho)


def fixed(model: PathModel, m: Moments, weights: dict[str, float] | None = None) -> Fit:
    """The estimates with given outer weights (all one, if none are), scaled to unit-variance scores; no iteration."""
    m = m.of(model.indicators)
    s, k = m.corr(), len(model.constructs)
    w = np.zeros((len(s), k))
    for j, c in enumerate(model.constructs):
        block = model.block(c.name)
        v = np.array([1.0 if weights is None else weights[x] for x in c.indicators])
        w[block, j] = v / np.sqrt(v @ s[np.ix_(block, block)] @ v)
    c = w.T @ s @ w
    b, r2 = structural(model, c)
    return Fit(model, m, s, w, c, s @ w, b, r2, 0)


def estimate(df: DataFrame, model: PathModel, weight: str | None = None, **options) -> Fit:
    """The estimates from the complete cases of a frame; weight names a column of case weights, which must be above 0."""
    if weight and df.filter(F.coalesce(F.col(weight) <= 0, F.lit(True)) | F.isnan(F.col(weight).cast("double"))).limit(1).count():
        raise ModelError(f"weights in {weight} must be above 0")
    return fit(model, moments(df, model.indicators, weight), **options)


def weight_counts(df: DataFrame, weight: str) -> DataFrame:
    """sum, effective: the sum of case weights and the effective number of cases."""
    w = F.col(weight).cast("double")
    return df.agg(F.sum(w).alias("sum"), (F.sum(w) * F.sum(w) / F.sum(w * w)).alias("effective"))


def with_roles(estimates: DataFrame, model: PathModel, controls: list[tuple[str, str]]) -> DataFrame:
    """The paths among tidy estimates with their role: control for declared control paths, which must be paths of the model, or structural. Numbers do not change."""
    if missing := [p for p in controls if tuple(p) not in model.paths]:
        raise ModelError(f"control paths that the model lacks: {missing}")
    declared = F.concat_ws("\u0000", "source", "target").isin([f"{a}\u0000{b}" for a, b in controls])
    return estimates.filter("kind = 'path'").select("source", "target", "estimate", F.when(declared, "control").otherwise("structural").alias("role"))


_TIDY = "kind string, source string, target string, estimate double, status string"


def tidy(df_or_spark, f: Fit) -> DataFrame:
    """kind, source, target, estimate, status: paths, total and indirect effects, weights, loadings and R2."""
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    names, total = f.model.names, f.total()
    rows = []
    for a, b in f.model.paths:
        rows.append(("path", a, b, float(f.paths[names.index(a), names.index(b)]), "ok"))
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            if abs(total[i, j]) > 0:
                rows.append(("total", a, b, float(total[i, j]), "ok"))
                if abs(total[i, j] - f.paths[i, j]) > 1e-14:
                    rows.append(("indirect", a, b, float(total[i, j] - f.paths[i, j]), "ok"))
    for j, c in enumerate(f.model.constructs):
        for i, x in zip(f.model.block(c.name), c.indicators):
            rows += [("weight", c.name, x, float(f.weights[i, j]), "ok"), ("loading", c.name, x, float(f.loadings[i, j]), "ok")]
        if np.isfinite(f.r2[j]):
            rows.append(("r2", c.name, c.name, float(f.r2[j]), "ok"))
        if f.rho_a is not None:
            rows.append(("rho_a", c.name, c.name, float(f.rho_a[j]), "ok"))
    return spark.createDataFrame(rows, _TIDY)


def scores(df: DataFrame, f: Fit, keep: list[str], preprocess: str = "standardized") -> DataFrame:
    """keep and one column for each construct: scores of mean 0 and variance 1, of the complete cases."""
    sd = f.moments.sd() if preprocess == "standardized" else np.ones(len(f.moments.names))
    out = []
    for j, c in enumerate(f.model.constructs):
        terms = [(F.col(x).cast("double") - float(f.moments.mean[i])) * float(f.weights[i, j] / sd[i]) for i, x in zip(f.model.block(c.name), c.indicators)]
        out.append(sum(terms[1:], terms[0]).alias(c.name))
    return df.dropna(subset=f.model.indicators).select(*keep, *out)
