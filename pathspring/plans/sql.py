"""Path models as DuckDB SQL, for comparison: the iteration is a recursive query on correlations.

A statement is a chain of CTEs. Small linear algebra is written out in columns:
``layers`` nests queries that each add columns, and ``solved`` is elimination.
Everything is keyed by ``k`` (a replicate, a group, a case left out; 0 for all), so
one recursive query fits the models of all keys.
"""

from __future__ import annotations

from collections.abc import Iterable

from pathspring.plans.model import Construct, PathModel


def layers(base: str, *added: dict[str, str]) -> str:
    """base with more columns; each layer may use those of the layers before it."""
    for columns in added:
        if columns:
            base = f"SELECT *, {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM ({base})"
    return base


def solved(name: str, a: list[list[str]], b: list[str]) -> tuple[list[dict[str, str]], list[str]]:
    """Layers and names of the solution of a x = b, by Gauss-Jordan elimination."""
    n = len(b)
    cell = lambda step, i, j: f"{name}_{step}_{i}_{j}"
    out = [{cell(0, i, j): (a[i] + [b[i]])[j] for i in range(n) for j in range(n + 1)}]
    for p in range(n):
        step = {}
        for i in range(n):
            for j in range(p + 1, n + 1):
                pivot = f"{cell(p, p, j)} / {cell(p, p, p)}"
                step[cell(p + 1, i, j)] = pivot if i == p else f"{cell(p, i, j)} - {cell(p, i, p)} * {pivot}"
        out.append(step)
    return out, [cell(n, i, n) for i in range(n)]


def total(terms: Iterable[str]) -> str:
    return "(" + (" + ".join(terms) or "0.0") + ")"


def _r(x: str, y: str) -> str:
    return "1.0" if x == y else f"r_{min(x, y)}_{max(x, y)}"


def _c(a: str, b: str, name: str = "c") -> str:
    return "1.0" if a == b else f"{name}_{min(a, b)}_{max(a, b)}"


def correlations(model: PathModel, rows: str, weight: str = "1.0") -> str:
    """k, cases (the sum of weights), the indicators' correlations, means and standard deviations, from rows (k and indicators), each counted weight times."""
    x = model.indicators
    means = f"SELECT k AS mk, sum({weight}) AS cases, {', '.join(f'sum({weight} * {i}) / sum({weight}) AS mean_{i}' for i in x)} FROM {rows} GROUP BY k"
    pairs = [(a, b) for i, a in enumerate(x) for b in x[i:]]
    sums = ", ".join(f"sum({weight} * ({a} - mean_{a}) * ({b} - mean_{b})) AS x_{a}_{b}" for a, b in pairs)
    cross = f"SELECT k, any_value(cases) AS cases, {', '.join(f'any_value(mean_{i}) AS mean_{i}' for i in x)}, {sums} FROM {rows} JOIN ({means}) ON k = mk GROUP BY k"
    out = [f"sqrt(x_{i}_{i} / (cases - 1)) AS sd_{i}" for i in x] + [f"x_{a}_{b} / sqrt(x_{a}_{a} * x_{b}_{b}) AS {_r(a, b)}" for a, b in pairs if a != b]
    return f"SELECT k, cases, {', '.join(f'mean_{i}' for i in x)}, {', '.join(out)} FROM ({cross})"


def _score_correlations(model: PathModel) -> list[dict[str, str]]:
    """Layers z_<indicator>_<construct> (with the score) and c_<construct>_<construct>, from the weights."""
    blocks = {c.name: c.indicators for c in model.constructs}
    z = {f"z_{x}_{c}": total(f"{_r(x, y)} * w_{y}" for y in block) for x in model.indicators for c, block in blocks.items()}
    names = model.names
    return [z, {_c(a, b): total(f"w_{x} * z_{x}_{b}" for x in blocks[a]) for i, a in enumerate(names) for b in names[i + 1 :]}]


def _regressions(model: PathModel, name: str, c: str = "c") -> tuple[list[dict[str, str]], dict[tuple[str, str], str]]:
    """Layers of each construct's regression on its predecessors, and the names of its coefficients."""
    out, found = [], {}
    for y in model.names:
        xs = [a for a in model.names if (a, y) in model.paths]
        if xs:
            steps, b = solved(f"{name}_{y}", [[_c(i, j, c) for j in xs] for i in xs], [_c(i, y, c) for i in xs])
            out += steps
            found |= {(x, y): v for x, v in zip(xs, b)}
    return out, found


def _iteration(model: PathModel, scheme: str) -> list[dict[str, str]]:
    """Layers that lead from weights w_ to new ones n_, and their largest change."""
    steps, b = _regressions(model, "e") if scheme == "path" else ([], {})
    v, size, new = {}, {}, {}
    for c in model.constructs:
        terms = [(a, b.get((a, c.name), _c(a, c.name))) for a in model.names if (a, c.name) in model.paths]
        terms += [(s, _c(s, c.name)) for s in model.names if (c.name, s) in model.paths]
        terms = terms or [(c.name, "1.0")]
        v |= {f"v_{x}": total(f"{e} * z_{x}_{a}" for a, e in terms) for x in c.indicators}
        norm = total(f"v_{x} * v_{y} * {_r(x, y)}" for x in c.indicators for y in c.indicators)
        size[f"s_{c.name}"] = f"sqrt({norm}) * CASE WHEN v_{c.indicators[0]} < 0 THEN -1 ELSE 1 END"
        new |= {f"n_{x}": f"v_{x} / s_{c.name}" for x in c.indicators}
    moved = {"moved": f"greatest({', '.join(f'abs(n_{x} - w_{x})' for x in model.indicators)})"}
    return [*_score_correlations(model), *steps, v, size, new, moved]


def fitted(model: PathModel, rows: str, name: str = "fit", scheme: str = "path", weight: str = "1.0", consistent: bool = False, start: str | None = None, tolerance: float = 1e-7) -> str:
    """CTEs <name>_r (correlations), <name>_it (the iteration) and <name>: for each k weights w_, score correlations, loadings l_, paths b_, R2 q_, reliabilities rho_.

    start: a query with k and u_<indicator>, the first weights before they are scaled.
    """
    xs, blocks = model.indicators, {c.name: c.indicators for c in model.constructs}
    r = f"{name}_r AS MATERIALIZED ({correlations(model, rows, weight)})"
    unit = start or f"SELECT k AS uk, {', '.join(f'1.0 AS u_{x}' for x in xs)} FROM {name}_r"
    norm = {c: "sqrt" + total(f"u_{x} * u_{y} * {_r(x, y)}" for x in b for y in b) for c, b in blocks.items()}
    where = {x: c for c, b in blocks.items() for x in b}
    first = f"SELECT k, 0 AS i, 1.0::DOUBLE AS moved, {', '.join(f'(u_{x} / {norm[where[x]]})::DOUBLE AS w_{x}' for x in xs)} FROM {name}_r JOIN ({unit}) ON uk = k"
    weights = ", ".join(f"w_{x}" for x in xs)
    if scheme == "fixed":
        it = f"{name}_it AS ({first})"
    else:
        state = f"SELECT t.k, t.i, {', '.join(f't.w_{x}' for x in xs)}, r.* EXCLUDE (k) FROM {name}_it t JOIN {name}_r r ON r.k = t.k WHERE t.moved > {tolerance} AND t.i < 3000"
        it = f"{name}_it AS ({first} UNION ALL SELECT k, i + 1, moved, {', '.join(f'n_{x}' for x in xs)} FROM ({layers(state, *_iteration(model, scheme))}))"
    last = f"SELECT k AS wk, {weights} FROM {name}_it QUALIFY row_number() OVER (PARTITION BY k ORDER BY i DESC) = 1"
    more = _score_correlations(model)
    loadings = {f"l_{x}": f"z_{x}_{where[x]}" for x in xs}
    used = "c"
    if consistent:
        rho, corrected = {}, {}
        for c, b in blocks.items():
            if len(b) == 1:
                rho[f"rho_{c}"] = "1.0"
                continue
            own = total(f"w_{x} * w_{x}" for x in b)
            off = total(f"w_{x} * w_{y} * {_r(x, y)}" for x in b for y in b if x != y)
            rho[f"rho_{c}"] = f"{own} * {own} * {off} / {total(f'w_{x} * w_{x} * w_{y} * w_{y}' for x in b for y in b if x != y)}"
            loadings |= {f"l_{x}": f"w_{x} * sqrt(rho_{c}) / {own}" for x in b}
        names = model.names
        corrected = {_c(a, b, "d"): f"{_c(a, b)} / sqrt(rho_{a} * rho_{b})" for i, a in enumerate(names) for b in names[i + 1 :]}
        more += [rho, corrected]
        used = "d"
    steps, b = _regressions(model, "p", used)
    more += [loadings, *steps, {f"b_{x}_{y}": v for (x, y), v in b.items()}]
    more.append({f"q_{y}": total(f"b_{x}_{y} * {_c(x, y, used)}" for x in model.names if (x, y) in model.paths) for y in model.names if any(t == y for _, t in model.paths)})
    base = f"SELECT * FROM {name}_r JOIN ({last}) ON wk = k"
    proper = ""
    if consistent:  # a key whose reliabilities or corrected correlations are improper has no fit
        proper = " WHERE " + " AND ".join([f"rho_{c} > 0 AND rho_{c} <= 1" for c in blocks] + [f"abs({d}) <= 1 + 1e-12" for d in corrected])
    return f"{r}, {it}, {name} AS MATERIALIZED (SELECT * FROM ({layers(base, *more)}){proper})"


def effect(model: PathModel, a: str, b: str, indirect: bool = False) -> str | None:
    """The total (or indirect) effect as an expression on a fit; None without a route."""
    routes = [t for t in model.routes(a, b) if len(t) > 2 or not indirect]
    return total(" * ".join(f"b_{x}_{y}" for x, y in zip(t, t[1:])) for t in routes) if routes else None


def estimates(model: PathModel, kinds: Iterable[str] = ("path", "total", "indirect", "weight", "loading", "r2"), consistent: bool = False) -> list[tuple[str, str, str, str]]:
    """(kind, source, target, expression on a fit) of what a tidy frame holds."""
    out = [("path", a, b, f"b_{a}_{b}") for a, b in model.paths]
    for kind in ("total", "indirect"):
        out += [(kind, a, b, e) for a in model.names for b in model.names if a != b and (e := effect(model, a, b, kind == "indirect"))]
    for c in model.constructs:
        out += [(kind, c.name, x, f"{letter}_{x}") for x in c.indicators for kind, letter in (("weight", "w"), ("loading", "l"))]
        out += [("r2", c.name, c.name, f"q_{c.name}")] if any(t == c.name for _, t in model.paths) else []
        out += [("rho_a", c.name, c.name, f"rho_{c.name}")] if consistent else []
    return [x for x in out if x[0] in {*kinds, "rho_a"}]


def tidy(model: PathModel, fit: str = "fit", digits: int = 6, **options) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS kind, '{a}' AS source, '{b}' AS target, round({e}, {digits}) AS estimate, 'ok' AS status FROM {fit}" for k, a, b, e in estimates(model, **options))


def scored(model: PathModel, rows: str, keep: str, fit: str = "fit", turned: bool = False) -> str:
    """Scores of the rows (k, indicators and what is kept), as columns; turned: by the fit's signs s_."""
    terms = {c.name: total(f"w_{x} * (f.{x} - mean_{x}) / sd_{x}" for x in c.indicators) + (f" * s_{c.name}" if turned else "") for c in model.constructs}
    return f"SELECT {keep}, {', '.join(f'{e} AS {n}' for n, e in terms.items())} FROM {rows} f JOIN {fit} ON {fit}.k = f.k"


def standardized(rows: str, y: str, xs: list[str], weight: str = "1.0") -> str:
    """For each k of weighted rows the least squares of y on xs: b_<x>, and t_<x> for a standard deviation of x."""
    used = PathModel((Construct("all", (*xs, y)),))
    steps, b = solved("h", [[_r(i, j) for j in xs] for i in xs], [_r(i, y) for i in xs])
    return layers(correlations(used, rows, weight), *steps, {f"t_{x}": f"{e} * sd_{y}" for x, e in zip(xs, b)}, {f"b_{x}": f"t_{x} / sd_{x}" for x in xs})


def regression(rows: str, y: str, xs: list[str], name: str = "g") -> str:
    """One row: b_<x>, r2 and sd_<x> of least squares with an intercept of y on xs."""
    cov = {f"v_{a}_{b}": f"covar_samp({a}, {b})" for i, a in enumerate([*xs, y]) for b in [*xs, y][i:]}
    v = lambda a, b: f"v_{a}_{b}" if f"v_{a}_{b}" in cov else f"v_{b}_{a}"
    base = f"SELECT {', '.join(f'{e} AS {c}' for c, e in cov.items())} FROM {rows}"
    steps, b = solved(name, [[v(i, j) for j in xs] for i in xs], [v(i, y) for i in xs])
    last = {f"b_{x}": e for x, e in zip(xs, b)} | {f"sd_{x}": f"sqrt({v(x, x)})" for x in xs}
    return layers(base, *steps, last, {"r2": total(f"b_{x} * {v(x, y)}" for x in xs) + f" / {v(y, y)}"})
