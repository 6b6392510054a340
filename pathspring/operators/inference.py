"""More inference: any statistic of moments by replicate, permuted residuals, exact fit, blindfolding, segments, path analysis."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathspring.functions import dist
from pathspring.operators import assess, pls, regression
from pathspring.operators.moments import Moments, moments, moments_by, shift_of, unpack
from pathspring.operators.resample import bca_table, bootstrap_plan, positioned, shuffled
from pathspring.plans.model import ModelError, PathModel


def replicated(df: DataFrame, columns: list[str], key: str, replicates: int, statistic: Callable[[Moments], dict[str, float]], seed: int = 1) -> DataFrame:
    """rep, name, value: a statistic of each bootstrap replicate's moments (rep -1: of the data)."""
    full = df.dropna(subset=columns)
    shift = shift_of(full, columns)
    rows = positioned(full.select(key, *columns), key)
    n = rows.count()
    drawn = bootstrap_plan(df.sparkSession, n, replicates, seed).join(rows, "pos")
    m = moments_by(drawn, columns, ["rep"], "times", shift).unionByName(moments_by(full.withColumn("rep", F.lit(-1).cast("long")), columns, ["rep"], None, shift))

    def solve(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples():
                try:
                    out += [(r.rep, k, float(v)) for k, v in statistic(unpack(columns, r.n, r.w, r.sums, r.products, shift)).items()]
                except (ModelError, ValueError, np.linalg.LinAlgError):
                    continue
            yield pd.DataFrame(out, columns=["rep", "name", "value"])

    return m.mapInPandas(solve, "rep long, name string, value double")


def intervals(t: DataFrame, replicates: int, level: float = 0.95) -> DataFrame:
    """name, value, se, low, high, usable, status of replicated()."""
    a = (1 - level) / 2
    g = t.filter("rep >= 0").groupBy("name").agg(F.stddev_samp("value").alias("se"), F.percentile("value", F.lit(a)).alias("low"), F.percentile("value", F.lit(1 - a)).alias("high"), F.count("*").alias("usable"))
    g = t.filter("rep = -1").select("name", "value").join(g, "name")
    ok = F.col("usable") >= max(2, math.ceil(0.9 * replicates))
    return g.select("name", "value", *[F.when(ok, F.col(c)).alias(c) for c in ("se", "low", "high")], "usable", F.when(ok, "ok").otherwise("too_few_usable").alias("status"))


def jackknifed(df: DataFrame, columns: list[str], key: str, statistic: Callable[[Moments], dict[str, float]]) -> DataFrame:
    """key, name, value: a statistic of the moments without each row in turn, which are the whole less the row's."""
    full, names = df.dropna(subset=columns), tuple(columns)
    whole = moments(full, columns)

    def solve(frames):
        for pdf in frames:
            out = []
            for left_out, *x in pdf.itertuples(index=False):
                one = Moments(names, 1, 1.0, np.asarray(x, dtype=float), np.zeros((len(names),) * 2))
                try:
                    out += [(str(left_out), k, float(v)) for k, v in statistic(whole.minus(one)).items()]
                except (ModelError, ValueError, np.linalg.LinAlgError):
                    continue
            yield pd.DataFrame(out, columns=["key", "name", "value"])

    return full.select(key, *[F.col(c).cast("double") for c in columns]).mapInPandas(solve, "key string, name string, value double")


def bca_intervals(t: DataFrame, jack: DataFrame, level: float = 0.95) -> DataFrame:
    """name, low, high: bias-corrected and accelerated bounds of replicated() with jackknifed(); null where nothing varies."""
    tidy = lambda d: d.select(F.lit("value").alias("kind"), F.col("name").alias("source"), F.lit("").alias("target"), F.col("value").alias("estimate"))
    return bca_table(tidy(t.filter("rep >= 0")), tidy(jack), tidy(t.filter("rep = -1")), level).select(F.col("source").alias("name"), "low", "high")


def zero_null(t: DataFrame, replicates: int) -> DataFrame:
    """name, value, p, usable, status: replicated() moved to zero, p = (as far from zero as the estimate + 1) / (usable + 1)."""
    seen = t.filter("rep = -1").select("name", F.col("value").alias("seen"))
    far = F.abs(F.col("value") - F.col("seen")) >= F.abs(F.col("seen"))
    g = t.filter("rep >= 0").join(F.broadcast(seen), "name").groupBy("name").agg(F.first("seen").alias("value"), ((F.count_if(far) + 1) / (F.count("*") + 1)).alias("p"), F.count("*").alias("usable"))
    ok = F.col("usable") >= max(2, math.ceil(0.9 * replicates))
    return g.select("name", "value", F.when(ok, F.col("p")).alias("p"), "usable", F.when(ok, "ok").otherwise("too_few_usable").alias("status"))


ERROR = " se"


def bootstrap_t(t: DataFrame, replicates: int, level: float = 0.95) -> DataFrame:
    """name, value, se, low, high, usable, status: bounds from replicates' distances over their own analytic errors.

    t is replicated() of a statistic that gives, beside each name, its standard error
    under the name followed by " se"; quantiles are those of type 7.
    """
    a, name = (1 - level) / 2, F.regexp_replace("name", f"{ERROR}$", "")
    own = t.filter(F.col("name").endswith(ERROR)).select("rep", name.alias("name"), F.col("value").alias("se"))
    both = t.join(own, ["rep", "name"]).filter(F.col("se") > 0)
    seen = both.filter("rep = -1").select("name", F.col("value").alias("v"), F.col("se").alias("s"))
    z = (F.col("value") - F.col("v")) / F.col("se")
    g = both.filter("rep >= 0").join(F.broadcast(seen), "name").groupBy("name").agg(F.first("v").alias("value"), F.first("s").alias("se"), F.percentile(z, F.lit(a)).alias("z0"), F.percentile(z, F.lit(1 - a)).alias("z1"), F.count("*").alias("usable"))
    ok = F.col("usable") >= max(2, math.ceil(0.9 * replicates))
    return g.select("name", "value", "se", F.when(ok, F.col("value") - F.col("z1") * F.col("se")).alias("low"), F.when(ok, F.col("value") - F.col("z0") * F.col("se")).alias("high"), "usable", F.when(ok, "ok").otherwise("too_few_usable").alias("status"))


def htmt_of(model: PathModel) -> Callable[[Moments], dict[str, float]]:
    return lambda m: {f"{a}~{b}": v for a, b, v, _ in assess.htmt(pls.fit(model, m)) if v is not None}


def slopes_of(y: str, xs: list[str]) -> Callable[[Moments], dict[str, float]]:
    def statistic(m: Moments) -> dict[str, float]:
        s = m.of([*xs, y]).cov()
        return dict(zip(xs, pls._solve(s[:-1, :-1], s[:-1, -1])))

    return statistic


def effects_of(equations: dict[str, list[str]]) -> Callable[[Moments], dict[str, float]]:
    """Slopes of a path analysis of observed variables (outcome: its predictors), the product along each longer route, and total effects where there are several routes."""
    following: dict[str, list[str]] = {}
    for y, xs in equations.items():
        for x in xs:
            following.setdefault(x, []).append(y)

    def routes(at: tuple[str, ...]):
        for y in following.get(at[-1], []):
            if y in at:
                raise ModelError("the equations must not form a circle")
            yield (*at, y)
            yield from routes((*at, y))

    every = [r for x in following for r in routes((x,))]

    def statistic(m: Moments) -> dict[str, float]:
        slope = {(x, y): b for y, xs in equations.items() for x, b in slopes_of(y, xs)(m).items()}
        out, ends = {}, {}
        for r in every:
            value = math.prod(slope[step] for step in zip(r, r[1:]))
            out[" > ".join(r)] = value
            ends.setdefault((r[0], r[-1]), []).append(value)
        return out | {f"total {x} > {y}": sum(v) for (x, y), v in ends.items() if len(v) > 1}

    return statistic


def freedman_lane(df: DataFrame, model: PathModel, source: str, target: str, key: str, permutations: int = 199, seed: int = 1) -> DataFrame:
    """source, target, estimate, p: residuals of the model without the path are permuted and added back; p = (extreme + 1) / (permutations + 1).

    The refits need only sums of predictors times permuted residuals, one aggregate by
    permutation; a permutation is a ranking of rows by a hash.
    """
    f = pls.estimate(df, model)
    t = pls.scores(df, f, [key])
    xs = [a for a, b in model.paths if b == target]
    rest = [x for x in xs if x != source]
    c = {x: i for i, x in enumerate(model.names)}
    j = c[target]
    b0 = pls._solve(f.scores[np.ix_([c[x] for x in rest], [c[x] for x in rest])], f.scores[[c[x] for x in rest], j]) if rest else np.zeros(0)
    e = F.col(target) - sum((float(b) * F.col(x) for b, x in zip(b0, rest)), F.lit(0.0))
    t = positioned(t.select(key, *xs, e.alias("e")), key).select("pos", *xs, "e")
    dealt = shuffled(t.select("pos"), permutations, seed, "pos", "from")
    sums = dealt.join(t.select("pos", *xs), "pos").join(t.select(F.col("pos").alias("from"), "e"), "from").groupBy("rep").agg(*[F.sum(F.col(x) * F.col("e")).alias(x) for x in xs])
    n, at = f.moments.n, [c[x] for x in xs]
    inv = np.linalg.inv(f.scores[np.ix_(at, at)])
    base = np.array([sum(b * f.scores[c[x], c[r]] for b, r in zip(b0, rest)) for x in xs])
    k = xs.index(source)
    beta = sum((float(inv[k, i]) * (F.lit(float(base[i])) + F.col(x) / (n - 1)) for i, x in enumerate(xs)), F.lit(0.0))
    seen = float(f.paths[c[source], j])
    r = sums.select(beta.alias("b")).agg(F.count_if(F.abs("b") >= abs(seen)).alias("k"), F.count("*").alias("n")).first()
    return df.sparkSession.createDataFrame([(source, target, seen, (r["k"] + 1) / (r["n"] + 1))], "source string, target string, estimate double, p double")


def exact_fit(df: DataFrame, model: PathModel, key: str, replicates: int = 200, seed: int = 1) -> DataFrame:
    """statistic, value, p: SRMR, d_ULS and d_G of the estimated model against data made to fit it (Bollen and Stine).

    The transformation is linear, so it is applied to each replicate's moments.
    """
    columns = model.indicators
    whole = moments(df.dropna(subset=columns), columns)
    f = pls.fit(model, whole)
    sd = whole.sd()
    sigma = assess.implied_indicators(f, True) * np.outer(sd, sd)

    def root(a, power):
        v, u = np.linalg.eigh(a)
        if v[0] <= 0:
            raise ModelError("a matrix is not positive definite")
        return u @ np.diag(v**power) @ u.T

    turn = root(whole.cov(), -0.5) @ root(sigma, 0.5)

    def statistic(m: Moments) -> dict[str, float]:
        turned = Moments(m.names, m.n, m.weight, turn.T @ m.mean, turn.T @ m.cross @ turn)
        return {s: v for variant, s, v, _ in assess.model_fit(pls.fit(model, turned)) if variant == "estimated" and v is not None and s in ("srmr", "d_uls", "d_g")}

    seen = {s: v for variant, s, v, _ in assess.model_fit(f) if variant == "estimated" and s in ("srmr", "d_uls", "d_g") and v is not None}
    t = replicated(df, columns, key, replicates, statistic, seed).filter("rep >= 0")
    known = df.sparkSession.createDataFrame([*seen.items()], "name string, seen double")
    return t.join(known, "name").groupBy(F.col("name").alias("statistic"), F.col("seen").alias("value")).agg(((F.count_if(F.col("value") >= F.col("seen")) + 1) / (F.count("*") + 1)).alias("p"))


def blindfold(df: DataFrame, model: PathModel, key: str, distance: int = 7) -> DataFrame:
    """construct, q2: every distance-th cell of the target's block is left out in turn, filled with the mean, and predicted.

    Cells count along a column and then the next. One row of moments for each round.
    """
    columns = model.indicators
    full = positioned(df.dropna(subset=columns).select(key, *columns), key)
    whole = moments(full, columns)
    n, sd = whole.n, whole.sd()
    z = [((F.col(c) - float(m)) / float(s)).alias(c) for c, m, s in zip(columns, whole.mean, sd)]
    full = full.select("pos", *z)
    rows = []
    for construct in model.constructs:
        if not any(b == construct.name for _, b in model.paths):
            continue
        block = list(construct.indicators)
        d = next(x for x in (distance, 5, 6, 8, 9, 10, 11, 12) if n % x)
        out = {c: (F.pmod(F.lit(i * n) + F.col("pos"), F.lit(d)) == F.col("round")) for i, c in enumerate(block)}
        t = full.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(d - 1))))
        seen = t.groupBy("round").agg(*[F.avg(F.when(~out[c], F.col(c))).alias(c) for c in block])
        means = {r["round"]: [r[c] for c in block] for r in seen.collect()}
        table = {c: F.element_at(F.create_map(*[v for k, m in means.items() for v in (F.lit(k), F.lit(float(m[i])))]), F.col("round")) for i, c in enumerate(block)}
        filled = t.select("round", *[F.when(out[c], table[c]).otherwise(F.col(c)).alias(c) if c in block else F.col(c) for c in columns])
        zero = [0.0] * len(columns)
        fits = {r["round"]: pls.fit(model, unpack(columns, r["n"], r["w"], r["sums"], r["products"], zero)) for r in moments_by(filled, columns, ["round"], None, zero).collect()}
        j = model.names.index(construct.name)
        terms = []
        for c in block:
            i = columns.index(c)
            rule = {}
            for k, f in fits.items():
                w = sum((float(f.paths[q, j]) * f.weights[:, q] for q in range(len(model.names)) if f.paths[q, j]), np.zeros(len(columns)))
                rule[k] = (w / f.moments.sd() * f.loadings[i, j] * f.moments.sd()[i], f.moments.mean)
            guess = F.lit(None).cast("double")
            for k, (w, m) in rule.items():
                value = sum((float(w[q]) * (F.col(x) - float(m[q])) for q, x in enumerate(columns) if abs(w[q]) > 0), F.lit(float(m[i])))
                guess = F.when(F.col("round") == k, value).otherwise(guess)
            terms += [F.sum(F.when(out[c], F.pow(F.col(c) - guess, 2))).alias(f"e{i}"), F.sum(F.when(out[c], F.pow(F.col(c) - table[c], 2))).alias(f"o{i}")]
        r = t.agg(*terms).first().asDict()
        rows.append((construct.name, 1 - sum(v for k, v in r.items() if k[0] == "e") / sum(v for k, v in r.items() if k[0] == "o")))
    return df.sparkSession.createDataFrame(rows, "construct string, q2 double")


def segments(df: DataFrame, model: PathModel, target: str, key: str, k: int = 2, rounds: int = 12, least: float = 0.1, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(segment, share, source, target, estimate), (statistic, value): prediction-oriented segments of a target's paths.

    Rows start by a hash and go, round after round, to the segment whose regression on
    scores predicts them best. Each round is one aggregate; rules travel as expressions.
    The statistics are those of a mixture with hard membership.
    """
    f = pls.estimate(df, model)
    xs = [a for a, b in model.paths if b == target]
    t = pls.scores(df, f, [key]).select(key, *xs, target)
    segment = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(k)).cast("int")
    columns, before = [*xs, target], None
    for _ in range(rounds):
        parts = {r["segment"]: unpack(columns, r["n"], r["w"], r["sums"], r["products"], [0.0] * len(columns)) for r in moments_by(t.withColumn("segment", segment), columns, ["segment"], None, [0.0] * len(columns)).collect()}
        n = sum(m.n for m in parts.values())
        if before and min(m.n for m in parts.values()) < least * n or len(parts) < k:
            break
        rule = {}
        for s, m in parts.items():
            cov = m.cov()
            b = pls._solve(cov[:-1, :-1], cov[:-1, -1])
            rule[s] = (m, b, float(m.mean[-1] - b @ m.mean[:-1]), float(cov[-1, -1] - b @ cov[:-1, -1]))
        state = {s: (r[0].n, *np.round(r[1], 10)) for s, r in rule.items()}
        kept, done = rule, state == before
        before = state
        if done:
            break
        loss = {s: F.pow(F.col(target) - F.lit(a) - sum((float(v) * F.col(x) for v, x in zip(b, xs)), F.lit(0.0)), 2) for s, (_, b, a, _) in rule.items()}
        best = F.least(*loss.values())
        segment = F.coalesce(*[F.when(v == best, F.lit(s)) for s, v in loss.items()])
    rows = [(int(s), m.n / n, x, target, float(v)) for s, (m, b, _, _) in kept.items() for x, v in zip(xs, b)]
    ll = sum(m.n * (math.log(m.n / n) - 0.5 * (math.log(2 * math.pi * max(v, 1e-12)) + 1)) for m, _, _, v in kept.values())
    p = k * (len(xs) + 2) - 1
    stats = {"log_likelihood": ll, "aic": 2 * p - 2 * ll, "bic": p * math.log(n) - 2 * ll, "caic": p * (math.log(n) + 1) - 2 * ll}
    spark = df.sparkSession
    return spark.createDataFrame(rows, "segment int, share double, source string, target string, estimate double"), spark.createDataFrame([*stats.items()], "statistic string, value double")


def technical_sample_size(betas: list[float]) -> int | None:
    """Cases for power 0.8 at 5 % by the inverse square root rule, for the weakest of significant paths; None without one."""
    return math.ceil((2.486 / min(map(abs, betas))) ** 2) if betas else None


def moderated_path(df: DataFrame, y: str, x: str, w: str, controls: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(term, ...) of the HC3 regression with the centred product, (level, slope, region_low, region_high).

    The product is centred on its equation's cases unless the moderator is 0/1. The
    Johnson-Neyman bounds are where the slope's 95 % interval meets zero, clipped to
    the observed moderator.
    """
    full = df.dropna(subset=[y, x, w, *controls])
    r = full.agg(F.avg(x).alias("mx"), F.avg(w).alias("mw"), F.stddev_samp(w).alias("sw"), F.min(w).alias("lo"), F.max(w).alias("hi"), F.count_if(~F.col(w).isin(0, 1)).alias("other")).first()
    binary = not r["other"]
    centre = 0.0 if binary else float(r["mw"])
    t = full.withColumns({"_x": F.col(x) - float(r["mx"]), "_w": F.col(w) - centre}).withColumn("_p", F.col("_x") * F.col("_w"))
    table, _ = regression.ols_hc3(t, y, ["_x", "_w", "_p", *controls])
    b = {v["term"]: v for v in table.collect()}
    m = moments(t, ["_x", "_w", "_p", *controls])
    n, p = m.n, len(m.names)
    b1, b3, s1, s3 = b["_x"]["estimate"], b["_p"]["estimate"], b["_x"]["se"], b["_p"]["se"]
    # the covariance of the two slopes, from the variance of their sum
    joint, _ = regression.ols_hc3(t.withColumn("_q", F.col("_p") - F.col("_x")), y, ["_q", "_w", "_x", *controls])
    both = {v["term"]: v["se"] for v in joint.collect()}["_x"]
    s13 = (both**2 - s1**2 - s3**2) / 2
    crit = dist.t_ppf(0.975, n - p - 1)
    qa, qb, qc = b3**2 - crit**2 * s3**2, 2 * (b1 * b3 - crit**2 * s13), b1**2 - crit**2 * s1**2
    roots = sorted((-qb + s * math.sqrt(qb * qb - 4 * qa * qc)) / (2 * qa) + centre for s in (1, -1)) if qa and qb * qb >= 4 * qa * qc else []
    inside = [v for v in roots if r["lo"] <= v <= r["hi"]]
    levels = [0.0, 1.0] if binary else [centre + k * float(r["sw"]) for k in (-1, 0, 1)]
    rows = [(v, b1 + b3 * (v - centre), inside[0] if inside else None, inside[1] if len(inside) > 1 else None) for v in levels]
    return table, df.sparkSession.createDataFrame(rows, "level double, slope double, region_low double, region_high double")


def nca_permutation(df: DataFrame, x: str, y: str, key: str, permutations: int = 99, seed: int = 1) -> DataFrame:
    """effect, p: the CE-FDH effect size against those of permuted y. All permutations are one plan: peers by permutation."""
    rows = positioned(df.dropna(subset=[x, y]).select(key, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")), key).select("pos", "x", "y")
    dealt = shuffled(rows.select("pos"), permutations, seed, "pos", "from")
    t = dealt.join(rows.select("pos", "x"), "pos").join(rows.select(F.col("pos").alias("from"), "y"), "from").select("rep", "x", "y")
    t = t.unionByName(rows.select(F.lit(-1).cast("long").alias("rep"), "x", "y"))
    top = t.groupBy("rep", "x").agg(F.max("y").alias("y"))
    w = Window.partitionBy("rep").orderBy("x")
    ends = Window.partitionBy("rep")
    top = top.withColumns({"before": F.max("y").over(w.rowsBetween(Window.unboundedPreceding, -1)), "x0": F.min("x").over(ends), "x1": F.max("x").over(ends), "y1": F.max("y").over(ends)})
    low = float(df.agg(F.min(y)).first()[0])
    peers = top.filter(F.col("before").isNull() | (F.col("y") > F.col("before")))
    area = (F.coalesce(F.lead("x").over(w), F.col("x1")) - F.col("x")) * (F.col("y1") - F.col("y"))
    d = peers.withColumn("a", area).groupBy("rep").agg((F.sum("a") / F.max((F.col("x1") - F.col("x0")) * (F.col("y1") - low))).alias("d"))
    seen = d.filter("rep = -1").select(F.col("d").alias("effect"))
    return d.filter("rep >= 0").crossJoin(F.broadcast(seen)).groupBy("effect").agg(((F.count_if(F.col("d") >= F.col("effect")) + 1) / (F.count("*") + 1)).alias("p"))
