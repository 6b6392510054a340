"""Resampling: plans as frames, one weighted aggregate for all replicates, one small solve for each.

Draws come from SHA-256 of (seed, replicate, position), so a plan depends neither on
partitions nor on workers, and SQL can restate it.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathspring.functions import dist
from pathspring.operators.moments import Moments, moments, moments_by, shift_of, unpack
from pathspring.operators.pls import Fit, fit, structural
from pathspring.plans.model import ModelError, PathModel


def draw(seed: Column | int, *parts: Column) -> Column:
    """A whole number of 52 bits from the seed and the parts."""
    text = F.concat_ws(":", F.lit(seed).cast("string"), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("long")


def ranked(df: DataFrame, digest: Column, key: str, by: tuple[str, ...] = (), name: str = "pos") -> DataFrame:
    """The frame with name, 0 to n - 1 in order of a digest in hexadecimal and then the key, within by.

    Counts by the digests' first three digits come first, then ranks within these
    4,096 parts, so no task sorts all rows (or all of one value of by).
    """
    b = df.withColumn("_h", digest).withColumn("_b", F.substring("_h", 1, 3))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bases = b.groupBy(*by, "_b").agg(F.count("*").alias("_n")).select(*by, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    b = b.withColumn("_i", F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", key)) - 1)
    return b.join(bases, [*by, "_b"]).withColumn(name, F.col("_base") + F.col("_i")).drop("_b", "_base", "_i", "_h")


def positioned(df: DataFrame, key: str) -> DataFrame:
    """The frame with pos, 0 to n - 1 in order of the MD5 of a unique key."""
    return ranked(df, F.md5(F.col(key).cast("string").cast("binary")), key)


def shuffled(df: DataFrame, replicates: int, seed: int, key: str, name: str = "rank") -> DataFrame:
    """Each row once for each replicate (rep, from 0), with its rank in that replicate's random order."""
    t = df.withColumn("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(replicates - 1).cast("long"))))
    return ranked(t, F.sha2(F.concat_ws(":", F.lit(seed), "rep", F.col(key).cast("string")), 256), key, ("rep",), name)


def bootstrap_plan(spark, n: int, replicates: int, seed: int = 1) -> DataFrame:
    """rep, pos, times: how often each replicate draws each position."""
    t = spark.range(n * replicates).select(F.floor(F.col("id") / n).alias("rep"), F.pmod("id", F.lit(n)).alias("i"))
    return t.select("rep", F.pmod(draw(seed, F.col("rep"), F.col("i")), F.lit(n)).alias("pos")).groupBy("rep", "pos").agg(F.count("*").alias("times"))


def fold_plan(df: DataFrame, key: str, folds: int, seed: int = 1, repeat: int = 0) -> DataFrame:
    """key, fold: round-robin along the order of a hash of the key."""
    digest = F.sha2(F.concat_ws(":", F.lit(seed), F.lit(repeat), F.col(key).cast("string")), 256)
    return ranked(df.select(key), digest, key).select(key, F.pmod("pos", F.lit(folds)).alias("fold"))


_ESTIMATES = "rep long, kind string, source string, target string, estimate double, status string"


def aligned(ref: Fit, new: Fit) -> Fit:
    """The refit with each score turned towards the reference's."""
    s = np.sign(np.einsum("pj,pq,qj->j", ref.weights, new.s, new.weights))
    if (s == 0).any():
        raise ModelError("a score has no association with the reference")
    w, c = new.weights * s, new.scores * np.outer(s, s)
    b, r2 = structural(new.model, c)
    return Fit(new.model, new.moments, new.s, w, c, new.loadings * s, b, r2, new.iterations, new.rho_a)


def _rows(rep: int, f: Fit) -> list[tuple]:
    n, total = f.model.names, f.total()
    out = [(rep, "path", a, b, float(f.paths[n.index(a), n.index(b)]), "ok") for a, b in f.model.paths]
    for i, j in itertools.permutations(range(len(n)), 2):
        routes = f.model.routes(n[i], n[j])
        out += [(rep, "total", n[i], n[j], float(total[i, j]), "ok")] if routes else []
        out += [(rep, "indirect", n[i], n[j], float(total[i, j] - f.paths[i, j]), "ok")] if any(len(r) > 2 for r in routes) else []
    for j, c in enumerate(f.model.constructs):
        for i, x in zip(f.model.block(c.name), c.indicators):
            out += [(rep, "weight", c.name, x, float(f.weights[i, j]), "ok"), (rep, "loading", c.name, x, float(f.loadings[i, j]), "ok")]
        out += [(rep, "r2", c.name, c.name, float(f.r2[j]), "ok")] if np.isfinite(f.r2[j]) else []
    return out


def refit(replicated: DataFrame, ref: Fit, shift, options: dict) -> DataFrame:
    """Estimates of each row of moments (rep, n, w, sums, products); a failed one gives its reason."""
    model, names = ref.model, tuple(ref.model.indicators)

    def solve(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples():
                try:
                    out += _rows(r.rep, aligned(ref, fit(model, unpack(names, r.n, r.w, r.sums, r.products, shift), **options)))
                except (ModelError, ValueError, np.linalg.LinAlgError) as error:
                    out.append((r.rep, "failed", None, None, None, str(error)[:200]))
            yield pd.DataFrame(out, columns=["rep", "kind", "source", "target", "estimate", "status"])

    return replicated.select("rep", "n", "w", "sums", "products").mapInPandas(solve, _ESTIMATES)


def bootstrap(df: DataFrame, model: PathModel, key: str, replicates: int = 500, seed: int = 1, **options) -> tuple[Fit, DataFrame]:
    """The estimates, and those of each replicate. Rows are weighted by how often they are drawn; replicates are a grouping key."""
    full = df.dropna(subset=model.indicators)
    shift = shift_of(full, model.indicators)
    ref = fit(model, moments(full, model.indicators), **options)
    rows = positioned(full.select(key, *model.indicators), key)
    drawn = bootstrap_plan(df.sparkSession, ref.moments.n, replicates, seed).join(rows, "pos")
    return ref, refit(moments_by(drawn, model.indicators, ["rep"], "times", shift), ref, shift, options)


TAILS = ("two_sided", "greater", "less")


def normal_p(z: Column, tail: str = "two_sided") -> Column:
    """p of a standard normal statistic, for few rows."""
    if tail not in TAILS:
        raise ValueError(f"tail must be one of {TAILS}")

    @F.pandas_udf("double")
    def p(values: pd.Series) -> pd.Series:
        upper = 1 - (values.abs() if tail == "two_sided" else values if tail == "greater" else -values).map(dist.norm_cdf)
        return 2 * upper if tail == "two_sided" else upper

    return p(z)


def summary(estimates: DataFrame, ref: DataFrame, replicates: int, level: float = 0.95, tail: str = "two_sided") -> DataFrame:
    """kind, source, target, estimate, mean, bias, se, low, high, t, p, usable, status: percentile intervals (type 7).

    t is the estimate over its standard error, p from the standard normal. Nothing but
    the status is given where fewer than nine in ten replicates are usable.
    """
    a = (1 - level) / 2
    g = estimates.filter("kind <> 'failed'").groupBy("kind", "source", "target").agg(
        F.avg("estimate").alias("mean"), F.stddev_samp("estimate").alias("se"), F.percentile("estimate", F.lit(a)).alias("low"), F.percentile("estimate", F.lit(1 - a)).alias("high"),
        F.count("*").alias("usable"))
    t = g.join(ref.select("kind", "source", "target", "estimate"), ["kind", "source", "target"])
    ok = F.col("usable") >= max(2, math.ceil(0.9 * replicates))
    t = t.withColumn("t", F.try_divide("estimate", "se"))
    show = lambda c, name: F.when(ok, c).alias(name)
    return t.select("kind", "source", "target", "estimate", show(F.col("mean"), "mean"), show(F.col("mean") - F.col("estimate"), "bias"), show(F.col("se"), "se"), show(F.col("low"), "low"), show(F.col("high"), "high"), show(F.col("t"), "t"), show(normal_p(F.coalesce("t", F.lit(0.0)), tail), "p"), "usable", F.when(ok, "ok").otherwise("too_few_usable").alias("status"))


def nested_plan(spark, n: int, replicates: int, inner: int, seed: int = 1) -> DataFrame:
    """rep, pos, times for rep = replicate * inner + inner replicate: n draws with replacement from the draws of each replicate of bootstrap_plan."""
    t = spark.range(n * replicates * inner).select(F.floor(F.col("id") / n).alias("rep"), F.pmod("id", F.lit(n)).alias("i"))
    outer, sub = F.floor(F.col("rep") / inner), F.pmod("rep", F.lit(inner))
    drawn = F.pmod(draw(seed, F.lit("inner"), outer, sub, F.col("i")), F.lit(n))
    return t.select("rep", outer.alias("outer"), drawn.alias("drawn")).select("rep", F.pmod(draw(seed, F.col("outer"), F.col("drawn")), F.lit(n)).alias("pos")).groupBy("rep", "pos").agg(F.count("*").alias("times"))


def studentized(df: DataFrame, model: PathModel, key: str, replicates: int = 999, inner: int = 99, seed: int = 1, level: float = 0.95, **options) -> DataFrame:
    """kind, source, target, estimate, se, low, high, usable, status: bootstrap-t intervals.

    A replicate's distance from the estimate is divided by the standard error of its own
    inner replicates; quantiles (type 7) of these, times the outer standard error, are
    taken from the estimate. A replicate counts if nine in ten of its inner ones are
    usable and vary; bounds need nine in ten replicates. Work grows with rows times
    replicates times inner replicates, in one aggregate by key.
    """
    ref, t = bootstrap(df, model, key, replicates, seed, **options)
    full = df.dropna(subset=model.indicators)
    shift = shift_of(full, model.indicators)
    rows = positioned(full.select(key, *model.indicators), key)
    drawn = nested_plan(df.sparkSession, ref.moments.n, replicates, inner, seed).join(rows, "pos")
    within = refit(moments_by(drawn, model.indicators, ["rep"], "times", shift), ref, shift, options)
    names, a = ["kind", "source", "target"], (1 - level) / 2
    spread = within.filter("kind <> 'failed'").groupBy(F.floor(F.col("rep") / inner).alias("rep"), *names).agg(F.stddev_samp("estimate").alias("own"), F.count("*").alias("n"))
    spread = spread.filter((F.col("n") >= max(2, math.ceil(0.9 * inner))) & (F.col("own") > 1e-12)).drop("n")
    known = df.sparkSession.createDataFrame([r[1:5] for r in _rows(0, ref)], "kind string, source string, target string, reference double")
    each = t.filter("kind <> 'failed'").drop("status").join(F.broadcast(known), names).join(spread, ["rep", *names], "left")
    z = (F.col("estimate") - F.col("reference")) / F.col("own")
    g = each.groupBy(*names).agg(F.first("reference").alias("estimate"), F.stddev_samp("estimate").alias("se"), F.percentile(z, F.lit(a)).alias("z0"), F.percentile(z, F.lit(1 - a)).alias("z1"), F.count("own").alias("usable"))
    ok = F.col("usable") >= max(2, math.ceil(0.9 * replicates))
    return g.select(*names, "estimate", F.when(ok, F.col("se")).alias("se"), F.when(ok, F.col("estimate") - F.col("z1") * F.col("se")).alias("low"), F.when(ok, F.col("estimate") - F.col("z0") * F.col("se")).alias("high"), "usable", F.when(ok, "ok").otherwise("too_few_usable").alias("status"))


def jackknife(df: DataFrame, ref: Fit, key: str, **options) -> DataFrame:
    """Estimates without each row in turn: the whole moments less the row's, no join."""
    model, whole = ref.model, ref.moments
    names = tuple(model.indicators)

    def solve(frames):
        for pdf in frames:
            out = []
            for rep, *x in pdf.itertuples(index=False):
                one = Moments(names, 1, 1.0, np.asarray(x, dtype=float), np.zeros((len(names),) * 2))
                try:
                    out += _rows(rep, aligned(ref, fit(model, whole.minus(one), **options)))
                except (ModelError, ValueError, np.linalg.LinAlgError) as error:
                    out.append((rep, "failed", None, None, None, str(error)[:200]))
            yield pd.DataFrame(out, columns=["rep", "kind", "source", "target", "estimate", "status"])

    return df.dropna(subset=list(names)).select(F.col(key).cast("long").alias("rep"), *[F.col(c).cast("double") for c in names]).mapInPandas(solve, _ESTIMATES)


def bca(values: np.ndarray, estimate: float, jack: np.ndarray, level: float = 0.95) -> tuple[float, float] | None:
    """Bias-corrected and accelerated bounds; None if nothing varies."""
    d = jack.mean() - jack
    spread = (d**2).sum()
    if spread <= 0 or np.ptp(values) <= 0:
        return None
    b = len(values)
    share = ((values < estimate).sum() + 0.5 * (values == estimate).sum()) / b
    z0 = dist.norm_ppf(min(max(share, 0.5 / b), 1 - 0.5 / b))
    acc = (d**3).sum() / (6 * spread**1.5)
    out = []
    for p in ((1 - level) / 2, (1 + level) / 2):
        z = z0 + dist.norm_ppf(p)
        out.append(dist.type7(values.tolist(), dist.norm_cdf(z0 + z / (1 - acc * z))))
    return out[0], out[1]


def bca_table(boot: DataFrame, jack: DataFrame, ref: DataFrame, level: float = 0.95) -> DataFrame:
    """kind, source, target, low, high: BCa bounds, null where nothing varies.

    The jackknife's acceleration is an aggregate (minus its skewness over six roots of n);
    only a row for each estimate comes to the driver, for the levels of its quantiles.
    """
    keys = ["kind", "source", "target"]
    j = jack.filter("kind <> 'failed'").groupBy(*keys).agg(F.count("*").alias("n"), F.skewness("estimate").alias("skew"))
    b = boot.filter("kind <> 'failed'").join(F.broadcast(ref.select(*keys, F.col("estimate").alias("seen"))), keys)
    b = b.withColumn("tied", F.abs(F.col("estimate") - F.col("seen")) <= 1e-14)
    share = b.groupBy(*keys).agg(F.count("*").alias("b"), F.avg(F.when(F.col("tied"), 0.5).otherwise((F.col("estimate") < F.col("seen")).cast("double"))).alias("share"), (F.max("estimate") > F.min("estimate")).alias("varies"))
    levels = []
    for r in share.join(j, keys).collect():
        if not r["varies"] or r["skew"] is None or math.isnan(r["skew"]):
            levels.append((*(r[k] for k in keys), None, None))
            continue
        z0, acc = dist.norm_ppf(min(max(r["share"], 0.5 / r["b"]), 1 - 0.5 / r["b"])), -r["skew"] / (6 * math.sqrt(r["n"]))
        at = [z0 + dist.norm_ppf(p) for p in ((1 - level) / 2, (1 + level) / 2)]
        levels.append((*(r[k] for k in keys), *(dist.norm_cdf(z0 + z / (1 - acc * z)) for z in at)))
    spark = boot.sparkSession
    out = []
    for *k, low, high in levels:
        mine = (F.col("kind") == k[0]) & (F.col("source") == k[1]) & (F.col("target") == k[2])
        out += [F.percentile(F.when(mine, F.col("estimate")), F.lit(p)) if p is not None else F.max(F.lit(None).cast("double")) for p in (low, high)]
    r = boot.agg(*[c.alias(f"p{i}") for i, c in enumerate(out)]).first() if out else []
    return spark.createDataFrame([(*x[:3], r[2 * i], r[2 * i + 1]) for i, x in enumerate(levels)], "kind string, source string, target string, low double, high double")


def wilson(successes: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """Wilson's score interval of a share."""
    z = dist.norm_ppf((1 + level) / 2)
    mid, half = (successes + z * z / 2) / (n + z * z), z * math.sqrt(successes * (n - successes) / n + z * z / 4) / (n + z * z)
    return mid - half, mid + half


def group_difference(df: DataFrame, model: PathModel, group: str, first, second, key: str, permutations: int = 500, seed: int = 1, **options) -> DataFrame:
    """source, target, first, second, difference, p: paths of two groups, with a permutation test of their difference.

    Each permutation keeps the groups' sizes: rows are ranked by a hash, and the first
    of them are the first group. Ranks by permutation spread over tasks.
    """
    full = df.filter(F.col(group).isin(first, second)).dropna(subset=model.indicators)
    shift = shift_of(full, model.indicators)
    pooled = fit(model, moments(full, model.indicators), **options)
    names = tuple(model.indicators)
    rows = full.select(key, F.col(group).alias("_g"), *names)
    size = rows.filter(F.col("_g") == first).count()
    own = rows.select(F.lit(-1).cast("long").alias("rep"), (F.col("_g") == first).alias("a"), *names)
    dealt = shuffled(rows, permutations, seed, key).select("rep", (F.col("rank") < size).alias("a"), *names)
    m = moments_by(own.unionByName(dealt), list(names), ["rep", "a"], None, shift)
    both = m.groupBy("rep").agg(*[F.max(F.when(F.col("a") == side, F.struct("n", "w", "sums", "products"))).alias(name) for side, name in ((True, "x"), (False, "y"))])

    def solve(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples():
                try:
                    x, y = (aligned(pooled, fit(model, unpack(names, v["n"], v["w"], v["sums"], v["products"], shift), **options)) for v in (r.x, r.y))
                    n = model.names
                    out += [(r.rep, a, b, float(x.paths[n.index(a), n.index(b)]), float(y.paths[n.index(a), n.index(b)])) for a, b in model.paths]
                except (ModelError, ValueError, np.linalg.LinAlgError):
                    continue
            yield pd.DataFrame(out, columns=["rep", "source", "target", "x", "y"])

    t = both.mapInPandas(solve, "rep long, source string, target string, x double, y double").withColumn("d", F.col("x") - F.col("y"))
    seen = t.filter("rep = -1").select("source", "target", F.col("x").alias("first"), F.col("y").alias("second"), F.col("d").alias("difference"))
    return t.filter("rep >= 0").join(seen, ["source", "target"]).groupBy("source", "target", "first", "second", "difference").agg(((F.count_if(F.abs("d") >= F.abs("difference")) + 1) / (F.count("*") + 1)).alias("p"))
