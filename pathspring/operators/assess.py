"""Assessment of a path model's measurement and structure, from its estimates.

Each function returns rows for a tidy frame; what has no value is None with a reason.
"""

from __future__ import annotations

import itertools
import math

import numpy as np

from pathspring.operators.pls import Fit, rho_a, structural


def alpha_raw(cov: np.ndarray) -> float | None:
    """Cronbach's alpha of items with these covariances; None for one item or a sum that does not vary."""
    k, whole = len(cov), float(cov.sum())
    return k / (k - 1) * (1 - float(np.trace(cov)) / whole) if k > 1 and whole > 0 else None


def alpha_standardized(r: np.ndarray) -> float | None:
    k = len(r)
    return k / (k - 1) * (1 - k / r.sum()) if k > 1 else None


def reliability(f: Fit) -> list[tuple]:
    """construct, statistic, value, reason: alpha, rho_a, rho_c, AVE."""
    out = []
    for j, c in enumerate(f.model.constructs):
        b = f.model.block(c.name)
        r = _corr(f.s)[np.ix_(b, b)]
        load = f.loadings[b, j]
        if c.mode == "B" or len(b) == 1:
            reason = "formative" if c.mode == "B" else "single_item"
            out += [(c.name, s, None, reason) for s in ("alpha", "rho_a", "rho_c", "ave")]
            continue
        rho = rho_a(f.s[np.ix_(b, b)], f.weights[b, j])
        out += [
            (c.name, "alpha", alpha_standardized(r), None),
            (c.name, "rho_a", rho, None if rho is not None else "zero_denominator"),
            (c.name, "rho_c", float(load.sum() ** 2 / (load.sum() ** 2 + (1 - load**2).sum())), None),
            (c.name, "ave", float((load**2).mean()), None),
        ]
    return out


def _corr(s: np.ndarray) -> np.ndarray:
    d = np.sqrt(np.diag(s))
    return s / np.outer(d, d)


def cross_loadings(f: Fit) -> list[tuple]:
    """indicator, construct, correlation of each indicator and score."""
    r = (f.s @ f.weights) / np.sqrt(np.diag(f.s))[:, None]
    return [(x, n, float(r[i, j])) for i, x in enumerate(f.model.indicators) for j, n in enumerate(f.model.names)]


def fornell_larcker(f: Fit) -> list[tuple]:
    """construct, other, value: root of AVE on the diagonal, score correlations off it."""
    ave = {c: v for c, s, v, _ in reliability(f) if s == "ave"}
    n = f.model.names
    return [(a, b, (math.sqrt(ave[a]) if ave[a] is not None else None) if a == b else float(f.scores[i, j])) for i, a in enumerate(n) for j, b in enumerate(n) if j <= i]


def htmt(f: Fit, absolute: bool = False) -> list[tuple]:
    """construct, other, value, reason: heterotrait-monotrait ratio of correlations (absolute: of their sizes)."""
    r = _corr(f.s)
    r = np.abs(r) if absolute else r
    out = []
    for a, b in itertools.combinations([c for c in f.model.constructs if c.mode == "A" and len(c.indicators) > 1], 2):
        i, j = f.model.block(a.name), f.model.block(b.name)
        within = [r[np.ix_(x, x)][np.triu_indices(len(x), 1)].mean() for x in (i, j)]
        ok = within[0] > 0 and within[1] > 0
        out.append((a.name, b.name, float(r[np.ix_(i, j)].mean() / math.sqrt(within[0] * within[1])) if ok else None, None if ok else "nonpositive_within"))
    return out


def vif(r: np.ndarray) -> np.ndarray | None:
    """Variance inflation of each variable from their correlations; None if they are dependent."""
    return np.diag(np.linalg.inv(r)) if len(r) and np.linalg.eigvalsh(r)[0] > 1e-12 else None


def structure(f: Fit) -> list[tuple]:
    """construct, predictor, statistic, value: adjusted R2, inner and outer VIF, f2."""
    out, a, names = [], f.model.adjacency(), f.model.names
    for j, n in enumerate(names):
        x = np.flatnonzero(a[:, j])
        if len(x):
            out.append((n, None, "adj_r2", float(1 - (1 - f.r2[j]) * (f.moments.n - 1) / (f.moments.n - len(x) - 1))))
            v = vif(f.scores[np.ix_(x, x)])
            for k, i in enumerate(x):
                out.append((n, names[i], "vif", float(v[k]) if v is not None else None))
                rest = np.delete(x, k)
                less = f.scores[rest, j] @ np.linalg.solve(f.scores[np.ix_(rest, rest)], f.scores[rest, j]) if len(rest) else 0.0
                out.append((n, names[i], "f2", float((f.r2[j] - less) / (1 - f.r2[j]))))
        b = f.model.block(n)
        if f.model.constructs[j].mode == "B" and len(b) > 1:
            v = vif(_corr(f.s)[np.ix_(b, b)])
            out += [(n, x, "outer_vif", float(v[k]) if v is not None else None) for k, x in enumerate(f.model.constructs[j].indicators)]
    return out


def implied_scores(f: Fit) -> np.ndarray:
    """Score correlations that the paths imply: (I - B)^-1 psi (I - B)^-T, exogenous correlations as observed."""
    k = len(f.paths)
    psi = np.diag(np.where(np.isnan(f.r2), 1.0, 1 - np.nan_to_num(f.r2)))
    x = np.flatnonzero(np.isnan(f.r2))
    psi[np.ix_(x, x)] = f.scores[np.ix_(x, x)]
    inv = np.linalg.inv(np.eye(k) - f.paths.T)
    return inv @ psi @ inv.T


def composite_check(f: Fit) -> list[tuple]:
    """construct, other, observed, implied, difference for each pair of constructs."""
    c, n = implied_scores(f), f.model.names
    return [(n[i], n[j], float(f.scores[i, j]), float(c[i, j]), float(f.scores[i, j] - c[i, j])) for j in range(len(n)) for i in range(j)]


def implied_indicators(f: Fit, estimated: bool) -> np.ndarray:
    """Indicator correlations implied by loadings and score correlations (of the paths, if estimated)."""
    c = implied_scores(f) if estimated else f.scores
    r = _corr(f.s)
    d = np.sqrt(np.diag(c))
    out = np.zeros_like(r)
    for i, a in enumerate(f.model.constructs):
        for j, b in enumerate(f.model.constructs):
            x, y = f.model.block(a.name), f.model.block(b.name)
            if i == j and a.mode == "B":
                out[np.ix_(x, y)] = r[np.ix_(x, y)]
            else:
                out[np.ix_(x, y)] = np.outer(f.loadings[x, i], f.loadings[y, j]) * (1.0 if i == j else c[i, j] / (d[i] * d[j]))
    np.fill_diagonal(out, 1.0)
    return out


def model_fit(f: Fit) -> list[tuple]:
    """variant, statistic, value for the saturated and the estimated model: SRMR, d_ULS, d_G, chi2, NFI."""
    r, out = _corr(f.s), []
    p = len(r)
    for variant in ("saturated", "estimated"):
        sigma = implied_indicators(f, variant == "estimated")
        low = np.tril_indices(p)
        uls = float((((r - sigma)[low]) ** 2).sum())
        values = {"d_uls": uls, "srmr": math.sqrt(uls / (p * (p + 1) / 2))}
        e = np.linalg.eigvals(np.linalg.solve(r, sigma)) if np.linalg.eigvalsh(r)[0] > 1e-12 else np.array([-1.0])
        e = e.real
        if (e > 0).all():
            values["d_g"] = float(0.5 * (np.log(e) ** 2).sum())
            ml = float(np.log(np.linalg.det(sigma)) + np.trace(np.linalg.solve(sigma, r)) - np.log(np.linalg.det(r)) - p)
            base = float(-np.log(np.linalg.det(r)))
            values |= {"chi2": (f.moments.n - 1) * ml, "nfi": 1 - ml / base}
        out += [(variant, s, values.get(s), None if s in values else "implied_matrix_not_positive") for s in ("srmr", "d_uls", "d_g", "chi2", "nfi")]
    return out


def mediation(f: Fit, source: str, mediator: str, target: str, tolerance: float = 1e-12) -> tuple:
    """direct, indirect, total, share of the indirect effect (VAF), class."""
    n = f.model.names
    i, m, j = (n.index(x) for x in (source, mediator, target))
    direct, indirect = float(f.paths[i, j]), float(f.paths[i, m] * f.paths[m, j])
    if abs(indirect) <= tolerance:
        kind = "direct_only" if abs(direct) > tolerance else "no_effect"
    elif abs(direct) <= tolerance:
        kind = "indirect_only"
    else:
        kind = "complementary" if direct * indirect > 0 else "competitive"
    total = direct + indirect
    return direct, indirect, total, indirect / total if abs(total) > tolerance else None, kind


def specific_indirect(f: Fit) -> list[tuple]:
    """route (names joined by ' > '), product of its paths, for all routes of two paths or more."""
    n, out = f.model.names, []
    for a, b in itertools.permutations(n, 2):
        for route in f.model.routes(a, b):
            if len(route) > 2:
                out.append((" > ".join(route), float(np.prod([f.paths[n.index(x), n.index(y)] for x, y in zip(route, route[1:])]))))
    return out


def tetrads(names, cov: np.ndarray) -> list[tuple]:
    """i, j, k, l, tetrad, value: the three tetrads of each four indicators."""
    out = []
    for q in itertools.combinations(range(len(names)), 4):
        i, j, k, m = q
        for label, (a, b, c, d) in (("1", (i, j, k, m)), ("2", (i, k, m, j)), ("3", (i, m, j, k))):
            out.append((*(names[x] for x in q), label, float(cov[a, b] * cov[c, d] - cov[a, d] * cov[b, c])))
    return out


def importance(f: Fit, target: str) -> dict[str, float]:
    """Total effects of the target's predecessors on it."""
    n, t = f.model.names, f.total()
    return {a: float(t[i, n.index(target)]) for i, a in enumerate(n) if abs(t[i, n.index(target)]) > 0}


def refit_paths(f: Fit, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return structural(f.model, scores)
