"""DuckDB SQL of the path-model queries, by the driver's names."""

from __future__ import annotations

from pathspring.plans import sql
from pathspring.plans.frames import ORDERS_SQL, chain_model, order_model, wide_model
from pathspring.plans.model import Construct, PathModel, model

CUSTOMERS_SQL = f"""{ORDERS_SQL}, c AS (
  SELECT o_custkey, count(*)::DOUBLE AS norders, sum(f.q) AS q, sum(f.n) AS n, sum(gross) AS gross, sum(disc) AS disc, sum(tax) AS tax, max(mx) AS mx, any_value(c_mktsegment) AS c_mktsegment
  FROM f JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey
)"""
_M = order_model()
_ALL = f"WITH RECURSIVE {ORDERS_SQL}, o AS (SELECT 0 AS k, * FROM f)"
_CUSTOMERS = f"WITH RECURSIVE {CUSTOMERS_SQL}, o AS (SELECT 0 AS k, * FROM c)"
_POSITIONS = "pos AS (SELECT *, row_number() OVER (ORDER BY md5(o_custkey::VARCHAR), o_custkey) - 1 AS pos FROM c)"


def _of(m: PathModel, frame: str = _ALL, **options) -> str:
    return f"{frame}, {sql.fitted(m, 'o', 'fit', **options)}"


_BASE = _of(_M)


def _union(rows, columns: str) -> str:
    """Rows of literals and expressions on the fit."""
    names = columns.split()
    return " UNION ALL ".join("SELECT " + ", ".join(f"{v} AS {n}" for v, n in zip(row, names)) + " FROM fit" for row in rows)


def _text(x: str | None) -> str:
    return "NULL::VARCHAR" if x is None else f"'{x}'"


def _round(e: str) -> str:
    return f"round({e}, 6) + 0.0"


def normal_p(z: str) -> str:
    """Two-sided p of a standard normal, by the series of odd double factorials (all terms positive)."""
    terms = "[exp((2 * i + 1) * ln(zz) - (i + 1) * ln(2) - lgamma(i + 1.5) + 0.5 * ln(pi())) FOR i IN range(0, 400)]"
    return f"(SELECT CASE WHEN zz > 8 THEN 0.0 WHEN zz = 0 THEN 1.0 ELSE 1 - 2 * exp(-zz * zz / 2) / sqrt(2 * pi()) * list_sum({terms}) END FROM (SELECT abs({z}) AS zz))"


def student_p(t: str, df: str) -> str:
    """Two-sided p of Student's t, by the incomplete beta function's series (all terms positive)."""
    terms = "[exp(lgamma(1.5) + lgamma(0.5 + b + i + 1) - lgamma(i + 2.5) - lgamma(0.5 + b) + (i + 1) * ln(y)) FOR i IN range(0, 2000)]"
    front = "exp(0.5 * ln(y) + b * ln(1 - y) + lgamma(0.5 + b) - lgamma(0.5) - lgamma(b)) / 0.5"
    return f"(SELECT CASE WHEN tt > 40 THEN 0.0 WHEN tt = 0 THEN 1.0 ELSE greatest(0.0, 1 - {front} * (1 + list_sum({terms}))) END FROM (SELECT abs({t}) AS tt, {t} * {t} / ({df} + {t} * {t}) AS y, {df} / 2.0 AS b))"


# Assessment


def _reliability() -> str:
    rows = []
    for c in _M.constructs:
        x = c.indicators
        r = sql.total(sql._r(a, b) for a in x for b in x)
        own, off = sql.total(f"w_{a} * w_{a}" for a in x), sql.total(f"w_{a} * w_{b} * {sql._r(a, b)}" for a in x for b in x if a != b)
        below = sql.total(f"w_{a} * w_{a} * w_{b} * w_{b}" for a in x for b in x if a != b)
        load, error = sql.total(f"l_{a}" for a in x), sql.total(f"1 - l_{a} * l_{a}" for a in x)
        values = {"alpha": f"{len(x)} / ({len(x)} - 1.0) * (1 - {len(x)} / {r})", "rho_a": f"{own} * {own} * {off} / {below}", "rho_c": f"{load} * {load} / ({load} * {load} + {error})", "ave": sql.total(f"l_{a} * l_{a}" for a in x) + f" / {len(x)}"}
        rows += [(_text(c.name), _text(s), _round(e), "NULL::VARCHAR") for s, e in values.items()]
    return _union(rows, "construct statistic value reason")


def _htmt_plus() -> str:
    rows, cs = [], _M.constructs
    for i, a in enumerate(cs):
        for b in cs[i + 1 :]:
            hetero = sql.total(f"abs({sql._r(x, y)})" for x in a.indicators for y in b.indicators) + " / 4"
            rows.append((_text(a.name), _text(b.name), _round(f"{hetero} / sqrt(abs({sql._r(*a.indicators)}) * abs({sql._r(*b.indicators)}))"), "NULL::VARCHAR"))
    return _union(rows, "construct other value reason")


def _fornell() -> str:
    n, blocks = _M.names, {c.name: c.indicators for c in _M.constructs}
    value = lambda a, b: f"sqrt({sql.total(f'l_{x} * l_{x}' for x in blocks[a])} / {len(blocks[a])})" if a == b else sql._c(a, b)
    return _union([(_text(a), _text(b), _round(value(a, b))) for i, a in enumerate(n) for b in n[: i + 1]], "construct other value")


def _structure() -> str:
    rows = []
    for y in _M.names:
        xs = [a for a in _M.names if (a, y) in _M.paths]
        if not xs:
            continue
        rows.append((_text(y), "NULL::VARCHAR", "'adj_r2'", _round(f"1 - (1 - q_{y}) * (cases - 1) / (cases - {len(xs) + 1})")))
        for x in xs:
            other = [o for o in xs if o != x]
            vif = f"1 / (1 - {sql._c(x, other[0])} * {sql._c(x, other[0])})" if other else "1.0"
            less = f"{sql._c(other[0], y)} * {sql._c(other[0], y)}" if other else "0.0"
            rows += [(_text(y), _text(x), "'vif'", _round(vif)), (_text(y), _text(x), "'f2'", _round(f"(q_{y} - {less}) / (1 - q_{y})"))]
    return _union(rows, "construct predictor statistic value")


def _implied(a: str, b: str, estimated: bool, m: PathModel) -> str:
    """The score correlation that a chain's paths imply."""
    if a == b or not estimated:
        return sql._c(a, b)
    i, j = sorted((m.names.index(a), m.names.index(b)))
    return sql.total([" * ".join(f"b_{m.names[x]}_{m.names[x + 1]}" for x in range(i, j))])


def _cca() -> str:
    m, rows = chain_model(), []
    n = m.names
    for j in range(len(n)):
        for i in range(j):
            e = _implied(n[i], n[j], True, m)
            rows.append((_text(n[i]), _text(n[j]), _round(sql._c(n[i], n[j])), _round(e), _round(f"{sql._c(n[i], n[j])} - {e}")))
    return f"{_of(m)} {_union(rows, 'construct other observed implied difference')}"


def _fit_rows() -> str:
    m, parts = chain_model(), []
    where = {x: c.name for c in m.constructs for x in c.indicators}
    x = m.indicators
    for variant in ("saturated", "estimated"):
        gaps = []
        for i, a in enumerate(x):
            for b in x[:i]:
                same = where[a] == where[b]
                c = "1.0" if same else _implied(where[a], where[b], variant == "estimated", m)
                gaps.append(f"pow({sql._r(a, b)} - l_{a} * l_{b} * {c}, 2)")
        uls = sql.total(gaps)
        parts += [(_text(variant), "'d_uls'", _round(uls), "NULL::VARCHAR"), (_text(variant), "'srmr'", _round(f"sqrt({uls} / {len(x) * (len(x) + 1) / 2})"), "NULL::VARCHAR")]
    return f"{_of(m)} {_union(parts, 'variant statistic value reason')}"


# Stage two


def _moderation(m: PathModel, terms: list[tuple[str, ...]]) -> tuple[str, str]:
    """CTEs up to the regression g, and its rows."""
    y = terms[0][-1]
    products = {"_x_".join(t[:-1]): (" * ".join(t[:-1]), "*".join(t[:-1])) for t in terms}
    xs = [a for a, b in m.paths if b == y] + [*products]
    label = {a: a for a in m.names} | {p: shown for p, (_, shown) in products.items()}
    s = f"{_of(m)}, s AS ({sql.scored(m, 'o', 'f.k', 'fit')}), p AS (SELECT *, {', '.join(f'{e} AS {p}' for p, (e, _) in products.items())} FROM s), g AS MATERIALIZED ({sql.regression('p', y, xs)})"
    return s, " UNION ALL ".join(f"SELECT '{y}' AS target, '{label[x]}' AS predictor, round(b_{x} * sd_{x}, 6) AS estimate, round(r2, 6) AS r2 FROM g" for x in xs)


def _nonlinear() -> str:
    squares = ", ".join(f"{c} * {c} AS {c}_sq" for c in _M.names)
    out, rows = f"{_BASE}, s AS ({sql.scored(_M, 'o', 'f.k', 'fit')}), p AS (SELECT *, {squares} FROM s)", []
    for y in _M.names:
        xs = [a for a, b in _M.paths if b == y]
        if xs:
            out += f", g_{y} AS MATERIALIZED ({sql.regression('p', y, xs)}), h_{y} AS MATERIALIZED ({sql.regression('p', y, xs + [f'{x}_sq' for x in xs])})"
            rows += [f"SELECT '{y}' AS target, '{x}' AS predictor, round(h.b_{x}, 6) AS linear, round(h.b_{x}_sq, 6) AS quadratic, round(h.r2 - g.r2, 6) AS r2_change FROM g_{y} g, h_{y} h" for x in xs]
    return f"{out} {' UNION ALL '.join(rows)}"


def _higher() -> str:
    second = PathModel((Construct("SCALE", ("SIZE", "VALUE")), Construct("CHARGES", ("CHARGES_score",))), (("SCALE", "CHARGES"),))
    return f"{_BASE}, s AS ({sql.scored(_M, 'o', 'f.k', 'fit')}), t AS (SELECT k, SIZE, VALUE, CHARGES AS CHARGES_score FROM s), {sql.fitted(second, 't', 'higher')} {sql.tidy(second, 'higher')}"


def _repeated() -> str:
    again = [f"{i}_again" for c in ("SIZE", "VALUE") for i in next(x for x in _M.constructs if x.name == c).indicators]
    whole = PathModel((*_M.constructs, Construct("SCALE", tuple(again))), (("SIZE", "SCALE"), ("VALUE", "SCALE"), ("SCALE", "CHARGES")))
    frame = f"WITH RECURSIVE {ORDERS_SQL}, o AS (SELECT 0 AS k, *, {', '.join(f'{a.removesuffix("_again")} AS {a}' for a in again)} FROM f)"
    return f"{_of(whole, frame)} {sql.tidy(whole)}"


# Prediction


def _errors(m: PathModel, name: str, with_lm: bool = True) -> str:
    """CTE <name>: l_orderkey, indicator and the errors of cases, each predicted by the fit of the other folds (b has k, the fold left out)."""
    block = {c.name: c.indicators for c in m.constructs}
    out = f"{sql.fitted(m, 'b', f'{name}_fit')}"
    if with_lm:
        out += "".join(f", {name}_{y} AS MATERIALIZED ({sql.standardized('b', y, ['q', 'n'])})" for y in block["CHARGES"])
    parts = []
    for y in block["CHARGES"]:
        effect = sql.effect(m, "SIZE", "CHARGES")
        guess = f"t.mean_{y} + {effect} * l_{y} * t.sd_{y} * {sql.total(f'w_{x} * (f.{x} - t.mean_{x}) / t.sd_{x}' for x in block['SIZE'])}"
        lm = f", f.{y} - g.mean_{y} - b_q * (f.q - g.mean_q) - b_n * (f.n - g.mean_n) AS lm" if with_lm else ""
        join = f" JOIN {name}_{y} g ON g.k = f.fold" if with_lm else ""
        parts.append(f"SELECT l_orderkey, '{y}' AS indicator, f.{y} AS seen, f.{y} - ({guess}) AS pls, f.{y} - t.mean_{y} AS mean{lm} FROM folds f JOIN {name}_fit t ON t.k = f.fold{join}")
    return f"{out}, {name} AS MATERIALIZED ({' UNION ALL '.join(parts)})"


_FOLDS = f"{_ALL}, folds AS MATERIALIZED (SELECT *, (row_number() OVER (ORDER BY sha256('1:0:' || l_orderkey), l_orderkey) - 1) % 10 AS fold FROM f), b AS (SELECT x.k, folds.* FROM folds JOIN range(10) x(k) ON fold <> x.k)"


def lower_p(t: str, df: str) -> str:
    return f"CASE WHEN {t} < 0 THEN {student_p(t, df)} / 2 ELSE 1 - {student_p(t, df)} / 2 END"


def _predict() -> str:
    tests = ", ".join(f"avg(pls * pls - {c} * {c}) / (stddev_samp(pls * pls - {c} * {c}) / sqrt(count(*))) AS t_{c}" for c in ("mean", "lm"))
    inner = f"SELECT indicator, sqrt(avg(pls * pls)) AS rmse_pls, sqrt(avg(lm * lm)) AS rmse_lm, sqrt(avg(mean * mean)) AS rmse_mean, avg(abs(pls)) AS mae_pls, avg(abs(lm)) AS mae_lm, avg(abs(pls / nullif(seen, 0))) AS mape_pls, {tests}, count(*) - 1 AS df FROM e GROUP BY indicator"
    shown = ", ".join(f"round({x}, 6) + 0.0 AS {n}" for n, x in [*((c, c) for c in ("rmse_pls", "rmse_lm", "rmse_mean", "mae_pls", "mae_lm", "mape_pls", "t_mean", "t_lm")), ("q2", "1 - rmse_pls * rmse_pls / (rmse_mean * rmse_mean)"), ("p_mean", lower_p("t_mean", "df")), ("p_lm", lower_p("t_lm", "df"))])
    return f"{_FOLDS}, {_errors(_M, 'e')}, g AS MATERIALIZED ({inner}) SELECT indicator, {shown} FROM g"


def _compare() -> str:
    both = ((_M, "e", "established", 3), (chain_model(), "a", "alternative", 2))
    out = f"{_FOLDS}, {', '.join(_errors(m, n, False) for m, n, _, _ in both)}"
    out += ", " + ", ".join(f"{label} AS (SELECT l_orderkey, avg(pls * pls) AS loss FROM {n} GROUP BY l_orderkey), {sql.fitted(m, 'o', f'{label}_whole')}" for m, n, label, _ in both)
    out += ", pairs AS (SELECT e.loss AS x, a.loss AS y FROM established e JOIN alternative a USING (l_orderkey)), g AS MATERIALIZED (SELECT avg(x) AS x, avg(y) AS y, avg(y - x) AS d, avg(y - x) / (stddev_samp(y - x) / sqrt(count(*))) AS t, count(*) - 1 AS df FROM pairs)"
    size = lambda label, p, cost: f"(SELECT cases * ln((1 - q_CHARGES) * (cases - 1) / cases) + {p} * {cost} FROM {label}_whole)"
    out += ", s AS (" + " UNION ALL ".join(f"SELECT '{s}' AS statistic, {size('established', 3, cost)} AS x, {size('alternative', 2, cost)} AS y" for s, cost in (("aic", "2"), ("bic", "ln(cases)"))) + ")"
    weight = "SELECT 'weight' AS statistic, 1 / (1 + exp(-0.5 * (y - x))) AS x, 1 / (1 + exp(-0.5 * (x - y))) AS y FROM s WHERE statistic = 'aic'"
    rows = f"SELECT 'loss' AS statistic, x, y, d, t, {lower_p('t', 'df')} AS p FROM g UNION ALL SELECT statistic, x, y, y - x, NULL, NULL FROM (SELECT * FROM s UNION ALL {weight})"
    return f"{out} SELECT statistic, round(x, 3) + 0.0 AS established, round(y, 3) + 0.0 AS alternative, round(d, 3) + 0.0 AS difference, round(t, 3) + 0.0 AS t, round(p, 3) + 0.0 AS p FROM ({rows})"


# Resampling


def _drawn(frame: str, replicates: int, key: str = "o_custkey") -> str:
    """b: the rows of each replicate k with times."""
    hit = "('0x' || substr(sha256('1:' || rep || ':' || i.pos), 1, 13))::BIGINT % (SELECT count(*) FROM pos)"
    return f"{frame}, {_POSITIONS}, plan AS (SELECT rep AS k, {hit} AS place, count(*) AS times FROM range({replicates}) a(rep), pos i GROUP BY ALL), b AS MATERIALIZED (SELECT plan.k, times, pos.* EXCLUDE (pos) FROM plan JOIN pos ON pos.pos = place)"


def _aligned(m: PathModel, replicated: str, reference: str = "fit") -> str:
    """The replicates with s_<construct>, the sign that turns each score towards the reference's."""
    signs = ", ".join(f"sign({sql.total(f'ref.w_{x} * rep.l_{x}' for x in c.indicators)}) AS s_{c.name}" for c in m.constructs)
    return f"SELECT rep.*, {signs} FROM {replicated} rep, {reference} ref"


def _long(m: PathModel, source: str, kinds) -> str:
    """k, kind, source, target, estimate of aligned replicates."""
    parts = []
    for kind, a, b, e in sql.estimates(m, kinds):
        turn = {"path": f"s_{a} * s_{b}", "total": f"s_{a} * s_{b}", "indirect": f"s_{a} * s_{b}", "weight": f"s_{a}", "loading": f"s_{a}", "r2": "1"}[kind]
        parts.append(f"SELECT k, '{kind}' AS kind, '{a}' AS source, '{b}' AS target, ({e}) * {turn} AS estimate FROM {source}")
    return " UNION ALL ".join(parts)


KINDS = ("path", "total", "indirect", "weight", "loading", "r2")


def _bootstrap(m: PathModel, replicates: int, kinds=KINDS, **options) -> str:
    """CTEs t (estimates by replicate) and ref, on customers."""
    frame = f"{_CUSTOMERS}, {sql.fitted(m, 'o', 'fit', **options)}"
    frame = f"{_drawn(frame, replicates)}, {sql.fitted(m, 'b', 'boot', weight='times', **options)}, al AS MATERIALIZED ({_aligned(m, 'boot')}), t AS ({_long(m, 'al', kinds)})"
    ref = " UNION ALL ".join(f"SELECT '{k}' AS kind, '{a}' AS source, '{b}' AS target, {e} AS estimate FROM fit" for k, a, b, e in sql.estimates(m, kinds))
    return f"{frame}, ref AS ({ref})"


def _shown(columns, replicates: int) -> str:
    """Rounded columns that need enough usable replicates, with their number and the status."""
    least = -(-9 * replicates // 10)
    shown = ", ".join(f"CASE WHEN usable >= {least} THEN round({e}, 6) END AS {n}" for n, e in columns)
    return f"{shown}, usable, CASE WHEN usable >= {least} THEN 'ok' ELSE 'too_few_usable' END AS status"


def _summary(replicates: int = 200, level: float = 0.95) -> str:
    a = (1 - level) / 2
    inner = f"SELECT kind, source, target, any_value(ref.estimate) AS estimate, avg(t.estimate) AS mean, stddev_samp(t.estimate) AS se, quantile_cont(t.estimate, {a}) AS low, quantile_cont(t.estimate, {1 - a}) AS high, count(*) AS usable FROM t JOIN ref USING (kind, source, target) GROUP BY kind, source, target"
    columns = (("mean", "mean"), ("bias", "mean - estimate"), ("se", "se"), ("low", "low"), ("high", "high"), ("t", "estimate / se"), ("p", normal_p("estimate / se")))
    return f"SELECT kind, source, target, round(estimate, 6) AS estimate, {_shown(columns, replicates)} FROM ({inner})"


def _posthoc() -> str:
    p = normal_p("estimate / se")
    return f"{_bootstrap(_M, 200, ('path',))}, z AS (SELECT source, target, any_value(ref.estimate) AS estimate, stddev_samp(t.estimate) AS se FROM t JOIN ref USING (kind, source, target) GROUP BY source, target) SELECT ceil(pow(2.486 / min(abs(estimate)), 2))::BIGINT AS minimum_n FROM z WHERE {p} < 0.05"


def _jackknife() -> str:
    left = f"{_CUSTOMERS}, {sql.fitted(_M, 'o', 'fit')}, b AS (SELECT x.o_custkey AS k, y.* FROM c x JOIN c y ON x.o_custkey <> y.o_custkey), {sql.fitted(_M, 'b', 'jack')}, al AS MATERIALIZED ({_aligned(_M, 'jack')}), t AS ({_long(_M, 'al', ('path',))})"
    return f"{left} SELECT source, target, count(*) AS n, round(sqrt((count(*) - 1) * var_pop(estimate)), 6) AS se FROM t GROUP BY source, target"


def _groups(replicates: int, **options) -> str:
    """Permuted groups of customers: k is twice the permutation (-1: as they are), and 1 more for the first group."""
    sub = f"WITH RECURSIVE {CUSTOMERS_SQL}, o AS (SELECT 0 AS k, * FROM c WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING'))"
    order = "PARTITION BY rep ORDER BY sha256('1:' || rep || ':' || o_custkey), o_custkey"
    dealt = f"SELECT 2 * rep + (row_number() OVER ({order}) <= (SELECT count(*) FROM o WHERE c_mktsegment = 'AUTOMOBILE'))::INT AS k, o.* EXCLUDE (k) FROM o, range({replicates}) r(rep)"
    own = "SELECT -2 + (c_mktsegment = 'AUTOMOBILE')::INT AS k, * EXCLUDE (k) FROM o"
    t = f"{sub}, {sql.fitted(_M, 'o', 'fit', **options)}, b AS MATERIALIZED ({own} UNION ALL {dealt}), {sql.fitted(_M, 'b', 'two', **options)}, al AS MATERIALIZED ({_aligned(_M, 'two')}), t AS ({_long(_M, 'al', ('path',))})"
    d = "SELECT x.k, x.source, x.target, x.estimate AS first, y.estimate AS second, x.estimate - y.estimate AS d FROM t x JOIN t y ON y.k = x.k - 1 AND x.source = y.source AND x.target = y.target WHERE x.k % 2 <> 0"
    return f"{t}, d AS MATERIALIZED ({d}) SELECT s.source, s.target, round(any_value(s.first), 6) AS first, round(any_value(s.second), 6) AS second, round(any_value(s.d), 6) AS difference, round((count(*) FILTER (WHERE abs(r.d) >= abs(s.d)) + 1) / (count(*) + 1), 6) AS p FROM d r JOIN d s USING (source, target) WHERE r.k >= 0 AND s.k = -1 GROUP BY s.source, s.target"


def _micom(replicates: int = 100) -> str:
    """Pairs of groups: the compositional correlation on the pooled frame, and means and variances of pooled scores."""
    statement = _groups(replicates)
    frame = statement[: statement.index(", al AS MATERIALIZED")]
    parts, blocks = [], {c.name: c.indicators for c in _M.constructs}
    for c, block in blocks.items():
        u, v = ({x: f"{t}.w_{x} / {t}.sd_{x} * p.sd_{x}" for x in block} for t in "ab")
        form = lambda left, right: sql.total(f"({left[x]}) * ({right[y]}) * {'1.0' if x == y else 'p.' + sql._r(x, y)}" for x in block for y in block)  # noqa: E731, B023
        mean = sql.total(f"(a.mean_{x} - b.mean_{x}) * p.w_{x} / p.sd_{x}" for x in block)
        var = lambda t: sql.total(f"p.w_{x} / p.sd_{x} * p.w_{y} / p.sd_{y} * {t}.sd_{x} * {t}.sd_{y} * {'1.0' if x == y else t + '.' + sql._r(x, y)}" for x in block for y in block)  # noqa: E731, B023
        parts.append(f"SELECT a.k, '{c}' AS construct, abs({form(u, v)} / sqrt({form(u, u)} * {form(v, v)})) AS c, {mean} AS m, ln({var('a')} / {var('b')}) AS v FROM two a JOIN two b ON b.k = a.k - 1, fit p WHERE a.k % 2 <> 0")
    q = lambda x, p, n: f"quantile_cont({x}, {p}) AS {n}"
    limits = ", ".join((q("c", 0.05, "bound"), q("m", 0.025, "mean_low"), q("m", 0.975, "mean_high"), q("v", 0.025, "variance_low"), q("v", 0.975, "variance_high")))
    names = ("compositional", "bound", "mean_difference", "variance_ratio_log", "mean_low", "mean_high", "variance_low", "variance_high")
    partial = "compositional + 1e-12 >= bound"
    whole = f"{partial} AND mean_difference BETWEEN mean_low AND mean_high AND variance_ratio_log BETWEEN variance_low AND variance_high"
    return f"{frame}, t AS MATERIALIZED ({' UNION ALL '.join(parts)}), l AS (SELECT construct, {limits} FROM t WHERE k >= 0 GROUP BY construct), g AS (SELECT construct, c AS compositional, m AS mean_difference, v AS variance_ratio_log, l.* EXCLUDE (construct) FROM t JOIN l USING (construct) WHERE k = -1) SELECT construct, {', '.join(f'round({n}, 6) + 0.0 AS {n}' for n in names)}, CASE WHEN {whole} THEN 'full' WHEN {partial} THEN 'partial' ELSE 'none' END AS invariance FROM g"


def _freedman_lane(permutations: int = 99) -> str:
    """Residuals of CHARGES on VALUE alone, permuted and added back; SIZE is tested."""
    base = f"{_of(_M, _CUSTOMERS)}, s AS ({sql.scored(_M, 'o', 'f.o_custkey', 'fit')}), e AS (SELECT *, CHARGES - (SELECT c_CHARGES_VALUE FROM fit) * VALUE AS e, row_number() OVER (ORDER BY md5(o_custkey::VARCHAR), o_custkey) - 1 AS pos FROM s)"
    dealt = "dealt AS (SELECT rep, pos, row_number() OVER (PARTITION BY rep ORDER BY sha256('1:' || rep || ':' || pos), pos) - 1 AS src FROM e, range(%d) r(rep))" % permutations
    sums = "sums AS (SELECT rep, sum(x.SIZE * y.e) AS u, sum(x.VALUE * y.e) AS v FROM dealt JOIN e x ON x.pos = dealt.pos JOIN e y ON y.pos = src GROUP BY rep)"
    beta = "((c_CHARGES_VALUE * c_SIZE_VALUE + u / (cases - 1)) - c_SIZE_VALUE * (c_CHARGES_VALUE + v / (cases - 1))) / (1 - c_SIZE_VALUE * c_SIZE_VALUE)"
    return f"{base}, {dealt}, {sums} SELECT 'SIZE' AS source, 'CHARGES' AS target, round(any_value(b_SIZE_CHARGES), 6) AS estimate, round((count(*) FILTER (WHERE abs({beta}) >= abs(b_SIZE_CHARGES)) + 1) / (count(*) + 1), 6) AS p FROM sums, fit"


def _replicates(statistics: dict[str, str], replicates: int, m: PathModel) -> str:
    """CTEs t (k, name, value by replicate) and ref of expressions on correlations."""
    frame = f"{_drawn(_CUSTOMERS, replicates)}, seen AS MATERIALIZED ({sql.correlations(m, 'o')}), boot AS MATERIALIZED ({sql.correlations(m, 'b', 'times')})"
    t, ref = (" UNION ALL ".join(f"SELECT k, '{n}' AS name, ({e})::DOUBLE AS value FROM {of}" for n, e in statistics.items()) for of in ("boot", "seen"))
    return f"{frame}, t AS ({t}), ref AS ({ref})"


def _intervals(statistics: dict[str, str], replicates: int, correlated: PathModel | None = None) -> str:
    """Percentile intervals of expressions on correlations."""
    inner = "SELECT name, any_value(ref.value) AS value, stddev_samp(t.value) AS se, quantile_cont(t.value, 0.025) AS low, quantile_cont(t.value, 0.975) AS high, count(*) AS usable FROM t JOIN ref USING (name) GROUP BY name"
    return f"{_replicates(statistics, replicates, correlated or _M)} SELECT name, round(value, 6) AS value, {_shown((('se', 'se'), ('low', 'low'), ('high', 'high')), replicates)} FROM ({inner})"


def _htmt_boot() -> str:
    cs, out = _M.constructs, {}
    for i, a in enumerate(cs):
        for b in cs[i + 1 :]:
            hetero = sql.total(sql._r(x, y) for x in a.indicators for y in b.indicators) + " / 4"
            out[f"{a.name}~{b.name}"] = f"{hetero} / sqrt({sql._r(*a.indicators)} * {sql._r(*b.indicators)})"
    return _intervals(out, 100)


_SLOPED = model({"A": ["q", "n", "gross"]}, [])


def _slopes() -> dict[str, str]:
    """Slopes of gross on q and n."""
    r, s, t = sql._r("q", "n"), sql._r("q", "gross"), sql._r("n", "gross")
    return {"q": f"({s} - {r} * {t}) / (1 - {r} * {r}) * sd_gross / sd_q", "n": f"({t} - {r} * {s}) / (1 - {r} * {r}) * sd_gross / sd_n"}


def _regression_boot() -> str:
    return _intervals(_slopes(), 100, _SLOPED)


def _regression_tests() -> str:
    p = "(count(*) FILTER (WHERE abs(t.value - ref.value) >= abs(ref.value)) + 1) / (count(*) + 1)"
    return f"{_replicates(_slopes(), 100, _SLOPED)} SELECT name, round(any_value(ref.value), 6) AS value, round({p}, 6) AS p, count(*) AS usable, 'ok' AS status FROM t JOIN ref USING (name) GROUP BY name"


def _bca(keys: str, value: str) -> str:
    """CTEs that lead from t, ref and tj (the jackknife's rows) to bounded: keys, low, high. The normal quantile of the share below is found by halving."""
    cdf = lambda z: f"(SELECT CASE WHEN zz < 0 THEN p / 2 ELSE 1 - p / 2 END FROM (SELECT {z} AS zz, {normal_p(z)} AS p))"
    mid = "(lo + hi) / 2"
    share = f"share AS MATERIALIZED (SELECT {keys}, count(*) AS b, avg(CASE WHEN abs(t.{value} - ref.{value}) <= 1e-14 THEN 0.5 WHEN t.{value} < ref.{value} THEN 1.0 ELSE 0.0 END) AS below, list_sort(list(t.{value})) AS sorted FROM t JOIN ref USING ({keys}) GROUP BY {keys})"
    half = f"half AS (SELECT {keys}, least(greatest(below, 0.5 / b), 1 - 0.5 / b) AS below, -9.0::DOUBLE AS lo, 9.0::DOUBLE AS hi, 0 AS i FROM share UNION ALL SELECT {keys}, below, CASE WHEN {cdf(mid)} < below THEN {mid} ELSE lo END, CASE WHEN {cdf(mid)} < below THEN hi ELSE {mid} END, i + 1 FROM half WHERE i < 55)"
    centred = f"SELECT *, {value} - avg({value}) OVER (PARTITION BY {keys}) AS dev FROM tj"
    skew = f"skew AS (SELECT {keys}, -sum(pow(dev, 3)) / (6 * pow(sum(dev * dev), 1.5)) AS acc FROM ({centred}) GROUP BY {keys})"
    level = lambda z: cdf(f"z0 + (z0 + {z}) / (1 - acc * (z0 + {z}))")
    at = lambda p: f"sorted[floor((b - 1) * {p})::INT + 1] + ((b - 1) * {p} - floor((b - 1) * {p})) * (sorted[least(floor((b - 1) * {p})::INT + 2, b)] - sorted[floor((b - 1) * {p})::INT + 1])"
    levels = f"levels AS (SELECT {keys}, b, sorted, {level('-1.959963984540054')} AS p0, {level('1.959963984540054')} AS p1 FROM (SELECT *, (lo + hi) / 2 AS z0 FROM half WHERE i = 55) JOIN skew USING ({keys}) JOIN share USING ({keys}))"
    return f"{share}, {half}, {skew}, {levels}, bounded AS (SELECT {keys}, round({at('p0')}, 6) AS low, round({at('p1')}, 6) AS high FROM levels)"


_LEFT_OUT = "bj AS (SELECT x.o_custkey AS k, y.* FROM c x JOIN c y ON x.o_custkey <> y.o_custkey)"


def _path_bca() -> str:
    jack = f"{_LEFT_OUT}, {sql.fitted(_M, 'bj', 'jack')}, alj AS MATERIALIZED ({_aligned(_M, 'jack')}), tj AS ({_long(_M, 'alj', ('path',))})"
    return f"{_bootstrap(_M, 200, ('path',))}, {jack}, {_bca('kind, source, target', 'estimate')} SELECT * FROM bounded"


def _regression_bca() -> str:
    tj = " UNION ALL ".join(f"SELECT '{n}' AS name, ({e})::DOUBLE AS value FROM left_out" for n, e in _slopes().items())
    return f"{_replicates(_slopes(), 100, _SLOPED)}, {_LEFT_OUT}, left_out AS MATERIALIZED ({sql.correlations(_SLOPED, 'bj')}), tj AS ({tj}), {_bca('name', 'value')} SELECT * FROM bounded"


def _process_boot() -> str:
    slope, first = _slopes(), f"{sql._r('q', 'n')} * sd_n / sd_q"
    whole = {"q > n": first, "q > gross": slope["q"], "n > gross": slope["n"], "q > n > gross": f"{first} * {slope['n']}", "total q > gross": f"{slope['q']} + {first} * {slope['n']}"}
    return _intervals(whole, 200, _SLOPED)


def _studentized(replicates: int = 39, inner: int = 19) -> str:
    m, kinds = chain_model(), ("path", "indirect")
    hit = lambda text: f"('0x' || substr(sha256({text}), 1, 13))::BIGINT % (SELECT count(*) FROM pos)"
    first, then = hit("'1:inner:' || rep || ':' || sub || ':' || i.pos"), hit("'1:' || rep || ':' || drawn")
    draws = f"SELECT rep, sub, {first} AS drawn FROM range({replicates}) a(rep), range({inner}) b(sub), pos i"
    nest = f"nest AS (SELECT rep * {inner} + sub AS k, {then} AS place, count(*) AS times FROM ({draws}) GROUP BY ALL), nb AS MATERIALIZED (SELECT nest.k, times, pos.* EXCLUDE (pos) FROM nest JOIN pos ON pos.pos = place)"
    own = f"{sql.fitted(m, 'nb', 'own', weight='times')}, al2 AS MATERIALIZED ({_aligned(m, 'own')}), t2 AS ({_long(m, 'al2', kinds)}), sp AS (SELECT k // {inner} AS k, kind, source, target, stddev_samp(estimate) AS own FROM t2 GROUP BY ALL)"
    z = "(t.estimate - ref.estimate) / own"
    last = f"SELECT kind, source, target, any_value(ref.estimate) AS estimate, stddev_samp(t.estimate) AS se, quantile_cont({z}, 0.025) AS z0, quantile_cont({z}, 0.975) AS z1, count(*) AS usable FROM t JOIN ref USING (kind, source, target) JOIN sp USING (k, kind, source, target) GROUP BY kind, source, target"
    columns = (("se", "se"), ("low", "estimate - z1 * se"), ("high", "estimate - z0 * se"))
    return f"{_bootstrap(m, replicates, kinds)}, {nest}, {own} SELECT kind, source, target, round(estimate, 6) AS estimate, {_shown(columns, replicates)} FROM ({last})"


def _second_stage(m: PathModel, replicates: int, derived: dict[str, str], after: str, statistics: dict[str, str]) -> str:
    """Intervals of expressions on the second stage, of all replicates and (k = -1) the data; derived: columns on scores (u), after: CTEs with a table z."""
    both = "b2 AS MATERIALIZED (SELECT * FROM b UNION ALL SELECT -1 AS k, 1 AS times, * FROM c)"
    reference = "(SELECT * FROM boot WHERE k = -1)"
    frame = f"{_drawn(_CUSTOMERS, replicates)}, {both}, {sql.fitted(m, 'b2', 'boot', weight='times')}, al AS MATERIALIZED ({_aligned(m, 'boot', reference)})"
    columns = "".join(f", {e} AS {n}" for n, e in derived.items())
    frame += f", s AS ({sql.scored(m, 'b2', 'f.k, times', 'al', True)}), u AS MATERIALIZED (SELECT *{columns} FROM s), {after}"
    t = " UNION ALL ".join(f"SELECT '{n}' AS name, k, ({e})::DOUBLE AS value FROM z" for n, e in statistics.items())
    inner = "SELECT name, max(value) FILTER (WHERE k = -1) AS value, stddev_samp(value) FILTER (WHERE k >= 0) AS se, quantile_cont(value, 0.025) FILTER (WHERE k >= 0) AS low, quantile_cont(value, 0.975) FILTER (WHERE k >= 0) AS high, count(*) FILTER (WHERE k >= 0) AS usable FROM t GROUP BY name"
    return f"{frame}, t AS ({t}) SELECT name, round(value, 6) AS value, {_shown((('se', 'se'), ('low', 'low'), ('high', 'high')), replicates)} FROM ({inner})"


def _moderation_boot(m: PathModel, terms: list[tuple[str, ...]], replicates: int = 100) -> str:
    y = terms[0][-1]
    products = {"_x_".join(t[:-1]): " * ".join(t[:-1]) for t in terms}
    xs = [a for a, b in m.paths if b == y] + [*products]
    return _second_stage(m, replicates, products, f"z AS MATERIALIZED ({sql.standardized('u', y, xs, 'times')})", {f"{y}~{x.replace('_x_', '*')}": f"t_{x}" for x in xs})


def _modmed_boot(replicates: int = 100) -> str:
    m = wide_model()
    xs = [a for a, b in m.paths if b == "CHARGES"] + ["M_x_N"]
    after = f"g AS MATERIALIZED ({sql.standardized('u', 'CHARGES', xs, 'times')}), h AS MATERIALIZED ({sql.standardized('u', 'M', ['Q'], 'times')}), z AS (SELECT g.k, g.b_M, g.t_M_x_N, h.b_Q AS first FROM g JOIN h ON g.k = h.k)"
    levels = {f"indirect at {level}": f"first * (b_M + {level} * t_M_x_N)" for level in (-1, 0, 1)}
    return _second_stage(m, replicates, {"M_x_N": "M * N"}, after, {"interaction": "t_M_x_N", "index": "first * t_M_x_N"} | levels)


def _higher_boot(replicates: int = 100) -> str:
    second = PathModel((Construct("SCALE", ("SIZE", "VALUE")), Construct("CHARGES", ("CHARGES_score",))), (("SCALE", "CHARGES"),))
    out = {"path:SCALE:CHARGES": "b_SCALE_CHARGES"} | {f"{kind}:SCALE:{x}": f"{letter}_{x}" for x in ("SIZE", "VALUE") for kind, letter in (("weight", "w"), ("loading", "l"))}
    return _second_stage(_M, replicates, {"CHARGES_score": "CHARGES"}, sql.fitted(second, "u", "z", weight="times"), out)


# Regressions


def _ols(y: str, xs: list[str]) -> str:
    """HC3 errors: the inverse by elimination, then leverages row by row, then the meat."""
    p = len(xs)
    means = ", ".join(f"avg({c}) AS m_{c}" for c in [*xs, y])
    sums = {f"s_{a}_{b}": f"regr_sxy({a}, {b})" if a != b else f"regr_sxx({a}, {a})" for i, a in enumerate([*xs, y]) for b in [*xs, y][i:]}
    s = lambda a, b: f"s_{a}_{b}" if f"s_{a}_{b}" in sums else f"s_{b}_{a}"
    a, steps, inv = [[s(i, j) for j in xs] for i in xs], [], {}
    for k in range(p):
        more, x = sql.solved(f"i{k}", a, [f"{float(i == k)}" for i in range(p)])
        steps += more
        inv |= {(i, k): x[i] for i in range(p)}
    named = {f"v{i}_{j}": e for (i, j), e in inv.items()}
    beta = {f"b{i}": sql.total(f"v{i}_{j} * {s(x, y)}" for j, x in enumerate(xs)) for i in range(p)}
    one = sql.layers(f"SELECT count(*) AS cases, {means}, {', '.join(f'{e} AS {c}' for c, e in sums.items())} FROM f", *steps, named, beta)
    z = {f"z{i}": f"{x} - m_{x}" for i, x in enumerate(xs)}
    e = {"e": f"{y} - m_{y} - {sql.total(f'b{i} * z{i}' for i in range(p))}", "h": "1.0 / cases + " + sql.total(f"v{i}_{j} * z{i} * z{j}" for i in range(p) for j in range(p))}
    rows = sql.layers("SELECT * FROM f, one", z, e, {"u": "pow(e / (1 - h), 2)", "z_": "1.0"})
    zs = ["z_", *[f"z{i}" for i in range(p)]]
    meat = ", ".join(f"sum(u * {zs[i]} * {zs[j]}) AS k{i}_{j}" for i in range(p + 1) for j in range(p + 1))
    part = lambda i, j: " + ".join(f"v{i}_{a} * k{a + 1}_{b + 1} * v{b}_{j}" for a in range(p) for b in range(p))
    var = {f"c{i}_{j}": part(i, j) for i in range(p) for j in range(p)} | {f"c_{j}": sql.total(f"k0_{a + 1} * v{a}_{j}" for a in range(p)) + " / cases" for j in range(p)} | {"c__": "k0_0 / cases / cases"}
    origin = f"c__ - 2 * {sql.total(f'm_{x} * c_{j}' for j, x in enumerate(xs))} + " + sql.total(f"m_{x} * m_{w} * c{i}_{j}" for i, x in enumerate(xs) for j, w in enumerate(xs))
    cut = f"m_{y} - {sql.total(f'b{i} * m_{x}' for i, x in enumerate(xs))}"
    terms = [("(intercept)", cut, f"sqrt({origin})"), *[(x, f"b{i}", f"sqrt(c{i}_{i})") for i, x in enumerate(xs)]]
    table = " UNION ALL ".join(f"SELECT '{n}' AS term, {b} AS estimate, {se} AS se, cases - {p + 1} AS df FROM var" for n, b, se in terms)
    final = f"SELECT term, round(estimate, 4) AS estimate, round(se, 4) AS se, round(estimate / se, 6) AS t, round({student_p('(estimate / se)', 'df')}, 6) AS p FROM g"
    return f"WITH {ORDERS_SQL}, one AS MATERIALIZED ({one}), sums AS MATERIALIZED (SELECT {meat} FROM ({rows})), var AS MATERIALIZED ({sql.layers('SELECT * FROM one, sums', var)}), g AS ({table}) {final}"


def _logistic() -> str:
    """Newton's method on counts by the predictor's value."""
    step = """SELECT i + 1 AS i, b0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS b0, b1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS b1, h11 / (h00 * h11 - h01 * h01) AS v0, h00 / (h00 * h11 - h01 * h01) AS v1
  FROM (SELECT i, b0, b1, list_sum([c.ones - c.cases * c.m FOR c IN t]) AS g0, list_sum([c.x * (c.ones - c.cases * c.m) FOR c IN t]) AS g1, list_sum([c.cases * c.m * (1 - c.m) FOR c IN t]) AS h00,
          list_sum([c.x * c.cases * c.m * (1 - c.m) FOR c IN t]) AS h01, list_sum([c.x * c.x * c.cases * c.m * (1 - c.m) FOR c IN t]) AS h11
        FROM (SELECT i, b0, b1, [{'x': c.x, 'cases': c.cases, 'ones': c.ones, 'm': 1 / (1 + exp(-b0 - b1 * c.x))} FOR c IN cells] AS t FROM it, (SELECT list({'x': x, 'cases': cases, 'ones': ones}) AS cells FROM cells) WHERE i < 30))"""
    rows = " UNION ALL ".join(f"SELECT '{n}' AS term, b{i} AS estimate, sqrt(v{i}) AS se FROM it WHERE i = 30" for i, n in enumerate(("(intercept)", "n")))
    return f"WITH RECURSIVE {ORDERS_SQL}, cells AS (SELECT n AS x, count(*)::DOUBLE AS cases, count(*) FILTER (WHERE gross >= 100000)::DOUBLE AS ones FROM f GROUP BY n), it AS (SELECT 0 AS i, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS v0, 0.0::DOUBLE AS v1 UNION ALL {step}), g AS ({rows}) SELECT term, round(estimate, 6) AS estimate, round(se, 6) AS se, round(estimate / se, 6) AS z, round({normal_p('estimate / se')}, 6) AS p, round(exp(estimate), 6) AS odds FROM g"


_TWO = _moderation(_M, [("SIZE", "VALUE", "CHARGES")])
_MULTI = _moderation(wide_model(), [("Q", "N", "CHARGES"), ("Q", "M", "CHARGES")])
_THREE = _moderation(wide_model(), [("Q", "N", "CHARGES"), ("Q", "M", "CHARGES"), ("N", "M", "CHARGES"), ("Q", "N", "M", "CHARGES")])
_CONDITIONAL = _moderation(wide_model(), [("M", "N", "CHARGES")])
_SCORES = f"s AS ({sql.scored(_M, 'o', 'f.l_orderkey', 'fit')})"
_START = f"SELECT k AS uk, {', '.join(f'abs(w_{x}) + 0.1 AS u_{x}' for x in _M.indicators)} FROM first"

_FACTOR = sql.fitted(_M, "o", "other", scheme="factor")
_PATHS = ("path",)

SQL = {
    "result_compare": f"{_BASE}, {_FACTOR}, a AS ({sql.tidy(_M, 'fit', kinds=_PATHS)}), b AS ({sql.tidy(_M, 'other', kinds=_PATHS)}) SELECT a.source, a.target, a.estimate AS left, b.estimate AS right, round(b.estimate - a.estimate, 6) + 0.0 AS difference, 'both' AS status FROM a JOIN b USING (source, target)",
    "saved_run_compare": f"{_BASE}, {_FACTOR}, a AS ({sql.tidy(_M, 'fit', kinds=_PATHS)}), b AS ({sql.tidy(_M, 'other', kinds=_PATHS)}) SELECT a.source, a.target, a.estimate AS left, b.estimate AS right, round(b.estimate - a.estimate, 6) + 0.0 AS difference, 'both' AS status FROM a JOIN b USING (source, target)",
    "src_matrix": f"WITH {ORDERS_SQL} " + " UNION ALL ".join(f"SELECT '{a}' AS i, '{b}' AS j, round(corr({a}, {b}), 6) AS r FROM f" for a, b in (("q", "n"), ("q", "gross"), ("n", "gross"))),
    "pls_pm": f"{_BASE} {sql.tidy(_M)}",
    "pls_factor": f"{_of(_M, scheme='factor')} {sql.tidy(_M)}",
    "plsc": f"{_of(_M, consistent=True)} {sql.tidy(_M, consistent=True)}",
    "pls_scores": f"{_BASE}, {_SCORES} SELECT l_orderkey, {', '.join(f'{_round(c)} AS {c}' for c in _M.names)} FROM s",
    "wpls": f"{_of(_M, _CUSTOMERS, weight='norders')} {sql.tidy(_M)} UNION ALL SELECT 'weights', 'cases', 'sum', round(sum(norders), 6), 'ok' FROM c UNION ALL SELECT 'weights', 'cases', 'effective', round(sum(norders) * sum(norders) / sum(norders * norders), 6), 'ok' FROM c",
    "pls_init_individual": f"{_ALL}, {sql.fitted(_M, 'o', 'first')}, {sql.fitted(_M, 'o', 'fit', start=_START)} {sql.tidy(_M)}",
    "pls_controls": f"{_BASE} SELECT source, target, estimate, CASE WHEN source = 'SIZE' AND target = 'CHARGES' THEN 'control' ELSE 'structural' END AS role FROM ({sql.tidy(_M, kinds=('path',))})",
    "as_reliability": f"{_BASE} {_reliability()}",
    "as_htmt_plus": f"{_BASE} {_htmt_plus()}",
    "as_cross_loadings": f"{_BASE} {_union([(_text(x), _text(c), _round(f'z_{x}_{c}')) for x in _M.indicators for c in _M.names], 'indicator construct value')}",
    "as_fornell_larcker": f"{_BASE} {_fornell()}",
    "as_structure": f"{_BASE} {_structure()}",
    "cca": _cca(),
    "as_fit": _fit_rows(),
    "mediation": f"{_BASE}, e AS (SELECT b_SIZE_CHARGES AS direct, b_SIZE_VALUE * b_VALUE_CHARGES AS indirect FROM fit) SELECT round(direct, 6) AS direct, round(indirect, 6) AS indirect, round(direct + indirect, 6) AS total, round(indirect / (direct + indirect), 6) AS vaf, CASE WHEN direct * indirect > 0 THEN 'complementary' ELSE 'competitive' END AS class FROM e",
    "specific_indirect": f"{_BASE} SELECT 'SIZE > VALUE > CHARGES' AS route, round(b_SIZE_VALUE * b_VALUE_CHARGES, 6) AS effect FROM fit",
    "as_ipma": f"{_BASE}, {_SCORES} " + " UNION ALL ".join(f"SELECT '{c}' AS construct, round((SELECT {sql.effect(_M, c, 'CHARGES')} FROM fit), 6) AS importance, round((avg({c}) - min({c})) / (max({c}) - min({c})) * 100, 6) AS performance FROM s" for c in ("SIZE", "VALUE")),
    "moderation_two_stage": " ".join(_TWO),
    "moderation_multi": " ".join(_MULTI),
    "moderation_three_way": " ".join(_THREE),
    "moderated_mediation": f"{_CONDITIONAL[0]} SELECT level, round(b_Q_M * (b_M + level * b_M_x_N * sd_M_x_N), 6) + 0.0 AS indirect, round(b_Q_M * b_M_x_N * sd_M_x_N, 6) + 0.0 AS index FROM g, fit, (VALUES (-1.0::DOUBLE), (0.0::DOUBLE), (1.0::DOUBLE)) AS v(level)",
    "nonlinear": _nonlinear(),
    "hoc_two_stage": _higher(),
    "hoc_repeated": _repeated(),
    "ols_multiple": _ols("gross", ["q", "n", "disc"]),
    "logistic": _logistic(),
    "rs_boot_pls": f"{_bootstrap(_M, 200)} {_summary()}",
    "rs_mediation": f"{_bootstrap(_M, 200, ('indirect',))} {_summary()}",
    "rs_boot_plsc": f"{_bootstrap(_M, 200, consistent=True)} {_summary()}",
    "rs_moderation": _moderation_boot(_M, [("SIZE", "VALUE", "CHARGES")]),
    "rs_three_way": _moderation_boot(wide_model(), [("Q", "N", "CHARGES"), ("Q", "M", "CHARGES"), ("N", "M", "CHARGES"), ("Q", "N", "M", "CHARGES")]),
    "rs_modmed": _modmed_boot(),
    "rs_hoc": _higher_boot(),
    "predict_kfold": _predict(),
    "model_compare": _compare(),
    "micom": _micom(),
    "rs_freedman_lane": _freedman_lane(),
    "rs_jackknife": _jackknife(),
    "rs_htmt_boot": _htmt_boot(),
    "rs_regression": _regression_boot(),
    "rs_regression_tests": _regression_tests(),
    "rs_regression_bca": _regression_bca(),
    "rs_bca": _path_bca(),
    "rs_process": _process_boot(),
    "rs_studentized": _studentized(),
    "mga_permutation": _groups(100),
    "rs_perm_plsc": _groups(100, consistent=True),
    "posthoc_n": _posthoc(),
}
