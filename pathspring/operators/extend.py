"""Extensions of path models: moderation, higher-order constructs, nonlinear and copula terms, components, prediction, groups."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathspring.functions import dist
from pathspring.operators import assess, pls
from pathspring.operators.moments import Moments, moments, moments_by, shift_of, unpack
from pathspring.operators.resample import fold_plan, shuffled
from pathspring.plans.model import Construct, ModelError, PathModel

# Stage two on scores


def regress(m: Moments, y: str, xs: list[str]) -> tuple[dict[str, float], float]:
    """Least squares of y on xs from moments, and R2."""
    s = m.of([*xs, y]).cov()
    b = pls._solve(s[:-1, :-1], s[:-1, -1])
    return {x: float(v) for x, v in zip(xs, b)}, float(b @ s[:-1, -1] / s[-1, -1])


def moderation(df: DataFrame, model: PathModel, terms: list[tuple[str, ...]], **options) -> DataFrame:
    """target, predictor, estimate, r2: two-stage moderation. terms: (factors ..., target), fitted together.

    Stage one gives the scores; products of two or more scores join the target's
    predictors in stage two. Coefficients of products are per standard deviation of
    the product. One projection and one aggregate more than the model.
    """
    f = pls.estimate(df, model, **options)
    t = pls.scores(df, f, [])
    products = []
    for *factors, y in terms:
        if any((x, y) not in model.paths for x in factors):
            raise ModelError(f"each of {factors} must have a path to {y}")
        name = "*".join(factors)
        value = F.col(factors[0])
        for x in factors[1:]:
            value = value * F.col(x)
        t = t.withColumn(name, value) if name not in t.columns else t
        products.append((name, y))
    columns = t.columns
    t = t.toDF(*[f"c{i}" for i in range(len(columns))])
    m = moments(t, t.columns)
    sd, rows = m.sd(), []
    for y in dict.fromkeys(y for _, y in products):
        xs = [a for a, b in model.paths if b == y] + [name for name, target in products if target == y]
        b, r2 = regress(m, f"c{columns.index(y)}", [f"c{columns.index(x)}" for x in xs])
        for x in xs:
            i = columns.index(x)
            rows.append((y, x, b[f"c{i}"] * float(sd[i]), r2))
    return df.sparkSession.createDataFrame(rows, "target string, predictor string, estimate double, r2 double")


def moderated_mediation(df: DataFrame, model: PathModel, source: str, mediator: str, target: str, moderator: str, **options) -> DataFrame:
    """level, indirect, index: the indirect effect at -1, 0 and 1 of a moderator of the second path, and the index (product times first path)."""
    t = moderation(df, model, [(mediator, moderator, target)], **options)
    b = {r["predictor"]: r["estimate"] for r in t.collect()}
    f = pls.estimate(df, model, **options)
    first = float(f.paths[model.names.index(source), model.names.index(mediator)])
    product = b[f"{mediator}*{moderator}"]
    return df.sparkSession.createDataFrame([(x, first * y, first * product) for x, y in simple_slopes(b[mediator], product)], "level double, indirect double, index double")


def repeated_indicators(df: DataFrame, model: PathModel, name: str, parts: list[str], paths: list[tuple[str, str]], mode: str = "A", **options) -> DataFrame:
    """Higher construct measured by all indicators of its parts once more (a tidy frame)."""
    own = [i for c in model.constructs if c.name in parts for i in c.indicators]
    wide = df.withColumns({f"{i}_again": F.col(i) for i in own})
    whole = PathModel((*model.constructs, Construct(name, tuple(f"{i}_again" for i in own), mode)), tuple(paths))
    return pls.tidy(df, pls.estimate(wide, whole, **options))


def simple_slopes(main: float, product: float, levels=(-1.0, 0.0, 1.0)) -> list[tuple[float, float]]:
    """(level of the moderator in standard deviations, slope)."""
    return [(x, main + x * product) for x in levels]


def nonlinear(df: DataFrame, model: PathModel, **options) -> DataFrame:
    """target, predictor, linear, quadratic, r2_change: centred squared scores added to each target's predictors."""
    f = pls.estimate(df, model, **options)
    t = pls.scores(df, f, [])
    n = model.names
    t = t.select(*[F.col(c) for c in n], *[(F.col(c) * F.col(c)).alias(f"{c}_sq") for c in n])
    m, rows = moments(t, t.columns), []
    for y in n:
        xs = [a for a, b in model.paths if b == y]
        if xs:
            base = regress(m, y, xs)[1]
            b, r2 = regress(m, y, xs + [f"{x}_sq" for x in xs])
            rows += [(y, x, b[x], b[f"{x}_sq"], r2 - base) for x in xs]
    return df.sparkSession.createDataFrame(rows, "target string, predictor string, linear double, quadratic double, r2_change double")


def copula(df: DataFrame, model: PathModel, target: str, predictor: str, **options) -> DataFrame:
    """term, estimate, skewness: the target's regression with a Gaussian copula term of one predictor.

    The term is the normal quantile of the rank (mean of ties, over n + 1). Ranks are
    counted over distinct values, so ties collapse before they are ordered.
    """
    f = pls.estimate(df, model, **options)
    t = pls.scores(df, f, [])
    n = f.moments.n
    values = t.groupBy(F.round(predictor, 12).alias("v")).agg(F.count("*").alias("k"))
    below = F.sum("k").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    values = values.withColumn("p", (below - (F.col("k") - 1) / 2.0) / (n + 1))

    @F.pandas_udf("double")
    def normal_quantile(p: pd.Series) -> pd.Series:
        return pd.Series(dist.norm_ppf_of(p.to_numpy()))

    values = values.select("v", normal_quantile("p").alias("copula"))
    xs = [a for a, b in model.paths if b == target]
    joined = t.withColumn("v", F.round(predictor, 12)).join(values, "v").select(*xs, target, "copula")
    skew = joined.agg(F.skewness(predictor)).first()[0]
    b, _ = regress(moments(joined, [*xs, target, "copula"]), target, [*xs, "copula"])
    return df.sparkSession.createDataFrame([(k, v, float(skew)) for k, v in b.items()], "term string, estimate double, skewness double")


def higher_order(df: DataFrame, model: PathModel, name: str, parts: list[str], paths: list[tuple[str, str]], mode: str = "A", **options) -> DataFrame:
    """Disjoint two-stage: scores of the parts are the indicators of the higher construct in a second model (a tidy frame)."""
    f = pls.estimate(df, model, **options)
    t = pls.scores(df, f, [])
    rest = [c for c in model.names if c not in parts]
    second = PathModel((Construct(name, tuple(parts), mode), *(Construct(f"{c}", (f"{c}_score",)) for c in rest)), tuple(paths))
    t = t.select(*parts, *[F.col(c).alias(f"{c}_score") for c in rest])
    return pls.tidy(df, pls.estimate(t, second, **options))


# Prediction


def case_errors(df: DataFrame, model: PathModel, target: str, key: str, folds: int = 10, repeats: int = 1, seed: int = 1) -> DataFrame:
    """repeat, key, indicator, seen, pls, lm, mean: errors of k-fold predictions of the target's indicators, case by case.

    Training moments are the whole less the fold. Each fold's path model, a linear model
    of all exogenous indicators, and the training mean predict the fold's cases.
    """
    names = model.indicators
    full = df.dropna(subset=names)
    shift = shift_of(full, names)
    exogenous = [c for c in model.constructs if not any(b == c.name for _, b in model.paths)]
    xs = [i for c in exogenous for i in c.indicators]
    ys = [names[i] for i in model.block(target)]
    whole = moments(full, names)
    out = None
    for repeat in range(repeats):
        rows = full.select(key, *names).join(fold_plan(full, key, folds, seed, repeat), key)
        parts = {r["fold"]: unpack(names, r["n"], r["w"], r["sums"], r["products"], shift) for r in moments_by(rows, names, ["fold"], None, shift).collect()}
        rules = {k: _rules(model, whole.minus(m), target, xs, ys) for k, m in parts.items()}

        def score(frames, rules=rules):
            for pdf in frames:
                held = [pd.DataFrame({"key": [], "indicator": [], "seen": [], "pls": [], "lm": [], "mean": []})]
                for fold, g in pdf.groupby("fold"):
                    x = g[xs].to_numpy(float)
                    for y in ys:
                        seen = g[y].to_numpy(float)
                        e = [seen - (a + x @ b) for a, b in rules[fold][y]] + [seen - rules[fold][y, "mean"]]
                        held.append(pd.DataFrame({"key": g["key"], "indicator": y, "seen": seen, "pls": e[0], "lm": e[1], "mean": e[2]}))
                yield pd.concat(held[1:] or held)

        part = rows.select(F.col(key).cast("long").alias("key"), "fold", *dict.fromkeys([*xs, *ys])).mapInPandas(score, "key long, indicator string, seen double, pls double, lm double, mean double")
        part = part.withColumn("repeat", F.lit(repeat))
        out = part if out is None else out.unionByName(part)
    return out


def lower_t(mean: float, sd: float | None, n: int) -> tuple[float | None, float | None]:
    """t of a mean difference of losses, and its one-sided p (the first loses less); None without spread."""
    if not sd:
        return None, None
    t = mean / (sd / math.sqrt(n))
    return t, dist.t_cdf(t, n - 1)


def predict(df: DataFrame, model: PathModel, target: str, key: str, folds: int = 10, repeats: int = 1, seed: int = 1) -> DataFrame:
    """indicator, rmse_pls, rmse_lm, rmse_mean, mae_pls, mae_lm, mape_pls, q2, and t and p of the path model's squared losses against the mean's and the linear model's.

    mape_pls leaves out cases whose value is 0. p is one-sided: small where the path model loses less.
    """
    e = case_errors(df, model, target, key, folds, repeats, seed)
    square = lambda c: F.col(c) * F.col(c)
    by = [F.sqrt(F.avg(square(c))).alias(f"rmse_{c}") for c in ("pls", "lm", "mean")] + [F.avg(F.abs(c)).alias(f"mae_{c}") for c in ("pls", "lm")]
    by += [f(square("pls") - square(c)).alias(f"{n}_{c}") for c in ("mean", "lm") for n, f in (("d", F.avg), ("sd", F.stddev_samp))]
    t = e.groupBy("indicator").agg(*by, F.avg(F.abs(F.try_divide("pls", "seen"))).alias("mape_pls"), F.count("*").alias("n"))
    rows = []
    for r in t.collect():
        tests = [x for c in ("mean", "lm") for x in lower_t(r[f"d_{c}"], r[f"sd_{c}"], r["n"])]
        rows.append((r["indicator"], r["rmse_pls"], r["rmse_lm"], r["rmse_mean"], r["mae_pls"], r["mae_lm"], r["mape_pls"], 1 - r["rmse_pls"] ** 2 / r["rmse_mean"] ** 2, *tests))
    columns = ("rmse_pls", "rmse_lm", "rmse_mean", "mae_pls", "mae_lm", "mape_pls", "q2", "t_mean", "p_mean", "t_lm", "p_lm")
    return df.sparkSession.createDataFrame(rows, "indicator string, " + ", ".join(f"{c} double" for c in columns))


def compare_models(df: DataFrame, established: PathModel, alternative: PathModel, target: str, key: str, folds: int = 10, repeats: int = 1, seed: int = 1) -> DataFrame:
    """statistic, established, alternative, difference, t, p: two models of one target on the same folds.

    loss: mean squared prediction errors of a case over the target's indicators, with a
    paired test of alternative less established (small p: the alternative loses less);
    bic and aic of the target's equation, n ln(SSE / n) + p ln n (or 2 p) with p
    predictors and the intercept; weight: Akaike weights.
    """
    models = {"established": established, "alternative": alternative}
    if len({tuple(m.indicators[i] for i in m.block(target)) for m in models.values()}) > 1:
        raise ModelError("the target must have the same indicators in both models")
    losses = [case_errors(df, m, target, key, folds, repeats, seed).groupBy("repeat", "key").agg(F.avg(F.col("pls") * F.col("pls")).alias(n)) for n, m in models.items()]
    d = F.col("alternative") - F.col("established")
    r = losses[0].join(losses[1], ["repeat", "key"]).agg(*[F.avg(n).alias(n) for n in models], F.avg(d).alias("d"), F.stddev_samp(d).alias("sd"), F.count("*").alias("n")).first()
    rows = [("loss", r["established"], r["alternative"], r["d"], *lower_t(r["d"], r["sd"], r["n"]))]
    size = {}
    for n, m in models.items():
        f = pls.estimate(df, m)
        cases, p = f.moments.n, sum(b == target for _, b in m.paths) + 1
        fit = cases * math.log((1 - f.r2[m.names.index(target)]) * (cases - 1) / cases)
        size[n] = {"aic": fit + 2 * p, "bic": fit + p * math.log(cases)}
    for s in ("aic", "bic"):
        a, b = (float(size[n][s]) for n in models)
        rows.append((s, a, b, b - a, None, None))
    best = min(x["aic"] for x in size.values())
    share = {n: math.exp(-0.5 * (x["aic"] - best)) for n, x in size.items()}
    a, b = (v / sum(share.values()) for v in share.values())
    rows.append(("weight", a, b, b - a, None, None))
    return df.sparkSession.createDataFrame(rows, "statistic string, established double, alternative double, difference double, t double, p double")


def _rules(model: PathModel, m: Moments, target: str, xs: list[str], ys: list[str]) -> dict:
    """For each indicator (intercept, slopes on xs) of the path model and of the linear model, and its training mean."""
    f = pls.fit(model, m)
    names, sd = model.names, f.moments.sd()
    total = f.total()
    j = names.index(target)
    out = {}
    where = [f.moments.names.index(x) for x in xs]
    slope_to_score = np.zeros(len(xs))
    for i, c in enumerate(model.constructs):
        if not any(b == c.name for _, b in model.paths) and abs(total[i, j]) > 0:
            for x in model.block(c.name):
                slope_to_score[xs.index(f.moments.names[x])] += total[i, j] * f.weights[x, i] / sd[x]
    cov = f.moments.cov()
    for y in ys:
        k = f.moments.names.index(y)
        b = slope_to_score * f.loadings[k, j] * sd[k]
        lm = np.linalg.lstsq(cov[np.ix_(where, where)], cov[where, k], rcond=None)[0]
        mean = f.moments.mean
        out[y] = [(float(mean[k] - b @ mean[where]), b), (float(mean[k] - lm @ mean[where]), lm)]
        out[y, "mean"] = float(mean[k])
    return out


# Generalised structured components


def gsca(df: DataFrame, model: PathModel, tolerance: float = 1e-9, most: int = 2000) -> DataFrame:
    """kind, source, target, estimate: components that minimise measurement and structural residuals together.

    Fit: FIT, AFIT (FIT for the number of weights, loadings and paths), and GFI and SRMR
    of the indicators' correlations against those that loadings and paths imply.
    Alternating least squares on correlations: loadings and paths given weights,
    then each component's weights given the others, scaled to unit variance.
    """
    m = moments(df, model.indicators)
    r, a, names = m.corr(), model.adjacency(), model.names
    p, k = len(r), len(names)
    w = np.zeros((p, k))
    for j, n in enumerate(names):
        b = model.block(n)
        w[b, j] = 1 / math.sqrt(r[np.ix_(b, b)].sum())

    def regressions():
        c = w.T @ r @ w
        load = np.zeros((k, p))
        for j, con in enumerate(model.constructs):
            if con.mode == "A":
                load[j, model.block(con.name)] = (r @ w)[model.block(con.name), j]
        b, _ = pls.structural(model, c)
        return load, b

    def loss(load, b):
        t = np.hstack([load, b])
        e = np.hstack([np.eye(p), w]) - w @ t
        keep = np.array([bool(load[:, i].any()) for i in range(p)] + [bool(a[:, j].any()) for j in range(k)])
        e = e[:, keep]
        return float(np.einsum("ij,ik,kj->", e, r, e))

    before = math.inf
    for _ in range(most):
        load, b = regressions()
        for j, con in enumerate(model.constructs):
            block = model.block(con.name)
            beta = np.concatenate([load[j], b[j]])
            others = w.copy()
            others[:, j] = 0
            t = np.hstack([load, b])
            t[j] = 0
            target = np.zeros(p)
            whole = np.hstack([np.eye(p), others]) - others @ t
            own = beta.copy()
            if a[:, j].any():
                own[p + j] -= 1
            keep = np.array([bool(load[:, i].any()) for i in range(p)] + [bool(a[:, i].any()) for i in range(k)])
            target = (whole[:, keep] @ own[keep]) * 1.0
            sub = r[np.ix_(block, block)]
            v = np.linalg.solve(sub, (r @ target)[block])
            size = math.sqrt(v @ sub @ v)
            if size > 0:
                w[block, j] = v / size
                if w[block, j].sum() < 0:
                    w[block, j] *= -1
            load, b = regressions()
        now = loss(load, b)
        if before - now <= tolerance:
            break
        before = now
    measured = sum(len(c.indicators) for c in model.constructs if c.mode == "A")
    terms = measured + int(sum(a[:, j].any() for j in range(k)))
    load, b = regressions()
    own = np.zeros((p, k))
    for j, con in enumerate(model.constructs):
        own[model.block(con.name), j] = (r @ w)[model.block(con.name), j]
    _, r2 = pls.structural(model, w.T @ r @ w)
    implied = assess.implied_indicators(pls.Fit(model, m, r, w, w.T @ r @ w, own, b, r2, 0, np.ones(k)), True)
    free = p + measured + len(model.paths)
    fit, low = 1 - now / terms, np.tril_indices(p, -1)
    stats = {"FIT": fit, "AFIT": 1 - (1 - fit) * m.n * p / (m.n * p - free), "GFI": 1 - ((r - implied) ** 2).sum() / (r**2).sum(), "SRMR": math.sqrt(((r - implied)[low] ** 2).mean())}
    rows = [("fit", "model", x, float(v)) for x, v in stats.items()]
    rows += [("path", x, y, float(b[names.index(x), names.index(y)])) for x, y in model.paths]
    for j, con in enumerate(model.constructs):
        for i, x in zip(model.block(con.name), con.indicators):
            rows += [("weight", con.name, x, float(w[i, j])), ("loading", con.name, x, float((r @ w)[i, j]))]
    return df.sparkSession.createDataFrame(rows, "kind string, source string, target string, estimate double")


# Groups


def micom(df: DataFrame, model: PathModel, group: str, first, second, key: str, permutations: int = 200, seed: int = 1, alpha: float = 0.05, **options) -> DataFrame:
    """construct, compositional, bound, mean_difference, variance_ratio_log, mean_low, mean_high, variance_low, variance_high, invariance.

    Weights of the groups are compared on the pooled frame; means and variances of
    pooled-model scores by group are held against those of permuted groups.
    """
    full = df.filter(F.col(group).isin(first, second)).dropna(subset=model.indicators)
    names = tuple(model.indicators)
    shift = shift_of(full, names)
    pooled_m = moments(full, names)
    pooled = pls.fit(model, pooled_m, **options)
    rows = full.select(key, F.col(group).alias("_g"), *names)
    size = rows.filter(F.col("_g") == first).count()
    dealt = shuffled(rows, permutations, seed, key).withColumn("a", F.col("rank") < size)
    own = rows.select(F.lit(-1).cast("long").alias("rep"), (F.col("_g") == first).alias("a"), *names)
    m = moments_by(own.unionByName(dealt.select("rep", "a", *names)), names, ["rep", "a"], None, shift)
    both = m.groupBy("rep").agg(*[F.max(F.when(F.col("a") == side, F.struct("n", "w", "sums", "products"))).alias(c) for side, c in ((True, "x"), (False, "y"))])
    sd = pooled_m.sd()
    weights = pooled.weights / sd[:, None]

    def solve(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples():
                try:
                    part = [unpack(names, v["n"], v["w"], v["sums"], v["products"], shift) for v in (r.x, r.y)]
                    fits = [pls.fit(model, p, **options) for p in part]
                    for j, c in enumerate(model.names):
                        u, v = (f.weights[:, j] / p.sd() * sd for f, p in zip(fits, part))
                        comp = float(u @ pooled.s @ v / math.sqrt((u @ pooled.s @ u) * (v @ pooled.s @ v)))
                        mean = float((part[0].mean - part[1].mean) @ weights[:, j])
                        var = [float(weights[:, j] @ p.cov() @ weights[:, j]) for p in part]
                        out.append((r.rep, c, abs(comp), mean, math.log(var[0] / var[1])))
                except (ModelError, ValueError, np.linalg.LinAlgError):
                    continue
            yield pd.DataFrame(out, columns=["rep", "construct", "c", "m", "v"])

    t = both.mapInPandas(solve, "rep long, construct string, c double, m double, v double")
    seen = t.filter("rep = -1").select("construct", F.col("c").alias("compositional"), F.col("m").alias("mean_difference"), F.col("v").alias("variance_ratio_log"))
    q = lambda c, p, name: F.percentile(c, F.lit(p)).alias(name)
    limits = t.filter("rep >= 0").groupBy("construct").agg(q("c", alpha, "bound"), q("m", alpha / 2, "mean_low"), q("m", 1 - alpha / 2, "mean_high"), q("v", alpha / 2, "variance_low"), q("v", 1 - alpha / 2, "variance_high"))
    t = seen.join(limits, "construct")
    partial = F.col("compositional") + 1e-12 >= F.col("bound")
    full_ = partial & F.col("mean_difference").between(F.col("mean_low"), F.col("mean_high")) & F.col("variance_ratio_log").between(F.col("variance_low"), F.col("variance_high"))
    return t.withColumn("invariance", F.when(full_, "full").when(partial, "partial").otherwise("none"))


def power(spark, path: float, n: int, replicates: int = 200, indicators: int = 3, loading: float = 0.8, permutations: int = 99, alpha: float = 0.05, seed: int = 1) -> DataFrame:
    """path, n, usable, power, low, high: share of simulated two-construct samples whose path a permutation test finds, with Wilson's interval."""
    from pathspring.operators.resample import wilson

    def simulate(frames):
        for pdf in frames:
            hits = []
            for rep in pdf["id"]:
                rng = np.random.default_rng([seed, n, int(rep)])
                x = rng.standard_normal(n)
                y = path * x + math.sqrt(1 - path * path) * rng.standard_normal(n)
                z = [loading * f[:, None] + math.sqrt(1 - loading**2) * rng.standard_normal((n, indicators)) for f in (x, y)]
                z = [(v - v.mean(0)) / v.std(0) for v in z]
                a, b = (np.ones(indicators) for _ in range(2))
                for _ in range(20):
                    a, b = z[0].T @ (z[1] @ b), z[1].T @ (z[0] @ a)
                    a, b = a / np.linalg.norm(a), b / np.linalg.norm(b)
                s, t = z[0] @ a, z[1] @ b
                seen = abs(np.corrcoef(s, t)[0, 1])
                extreme = sum(abs(np.corrcoef(s, rng.permutation(t))[0, 1]) >= seen for _ in range(permutations))
                hits.append((extreme + 1) / (permutations + 1) <= alpha)
            yield pd.DataFrame({"hit": hits})

    r = spark.range(replicates).repartition(8).mapInPandas(simulate, "hit boolean").agg(F.count_if("hit").alias("k"), F.count("*").alias("n")).first()
    low, high = wilson(r["k"], r["n"])
    return spark.createDataFrame([(path, n, r["n"], r["k"] / r["n"], low, high)], "path double, n int, usable long, power double, low double, high double")
