"""Bootstraps of two-stage estimates: every stage is refitted in each replicate.

Stage one is one row of moments and one small fit for each replicate. Its weights, a
short row for each replicate, are joined to the drawn rows, which become scores and
products of scores; their moments by replicate are the second stage. Replicate -1 is
the data as they are.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathspring.operators import pls
from pathspring.operators.extend import regress, simple_slopes
from pathspring.operators.moments import Moments, moments, moments_by, shift_of, unpack
from pathspring.operators.resample import aligned, bootstrap_plan, positioned
from pathspring.plans.model import Construct, ModelError, PathModel

Statistic = Callable[[Moments], dict[str, float]]


def replicated_scores(df: DataFrame, model: PathModel, key: str, replicates: int, seed: int = 1, **options) -> DataFrame:
    """rep, times and the constructs' scores of each replicate's rows, by that replicate's own fit, turned towards the data's."""
    names = model.indicators
    full = df.dropna(subset=names)
    shift = shift_of(full, names)
    ref = pls.fit(model, moments(full, names), **options)
    rows = positioned(full.select(key, *names), key)
    drawn = bootstrap_plan(df.sparkSession, ref.moments.n, replicates, seed).join(rows, "pos").select("rep", "times", *names)
    drawn = drawn.unionByName(full.select(F.lit(-1).cast("long").alias("rep"), F.lit(1).cast("long").alias("times"), *names))

    def solve(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples():
                try:
                    f = aligned(ref, pls.fit(model, unpack(names, r.n, r.w, r.sums, r.products, shift), **options))
                except (ModelError, ValueError, np.linalg.LinAlgError):
                    continue
                out.append((r.rep, f.moments.mean.tolist(), (f.weights / f.moments.sd()[:, None]).T.ravel().tolist()))
            yield pd.DataFrame(out, columns=["rep", "centre", "by"])

    weights = moments_by(drawn, names, ["rep"], "times", shift).mapInPandas(solve, "rep long, centre array<double>, by array<double>")
    t = drawn.join(F.broadcast(weights), "rep")  # a row of (p + 1) k numbers for each replicate
    p = len(names)
    scores = []
    for j, c in enumerate(model.constructs):
        terms = [(F.col(x).cast("double") - F.get("centre", F.lit(i))) * F.get("by", F.lit(j * p + i)) for i, x in zip(model.block(c.name), c.indicators)]
        scores.append(sum(terms[1:], terms[0]).alias(c.name))
    return t.select("rep", "times", *scores)


def second_stage(scores: DataFrame, columns: dict[str, Column], statistic: Statistic) -> DataFrame:
    """rep, name, value: a statistic of the weighted moments, by replicate, of the named expressions on scores."""
    names = list(columns)
    short = [f"x{i}" for i in range(len(names))]
    t = scores.select("rep", "times", *[e.alias(s) for s, e in zip(short, columns.values())])
    zero = [0.0] * len(names)

    def solve(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples():
                try:
                    out += [(r.rep, k, float(v)) for k, v in statistic(unpack(names, r.n, r.w, r.sums, r.products, zero)).items()]
                except (ModelError, ValueError, np.linalg.LinAlgError):
                    continue
            yield pd.DataFrame(out, columns=["rep", "name", "value"])

    return moments_by(t, short, ["rep"], "times", zero).mapInPandas(solve, "rep long, name string, value double")


def _with_products(model: PathModel, terms: list[tuple[str, ...]]) -> dict[str, Column]:
    columns = {c: F.col(c) for c in model.names}
    for *factors, y in terms:
        if any((x, y) not in model.paths for x in factors):
            raise ModelError(f"each of {factors} must have a path to {y}")
        value = F.col(factors[0])
        for x in factors[1:]:
            value = value * F.col(x)
        columns["*".join(factors)] = value
    return columns


def moderation(df: DataFrame, model: PathModel, terms: list[tuple[str, ...]], key: str, replicates: int, seed: int = 1, **options) -> DataFrame:
    """rep, name (target~predictor), value: coefficients of main effects and products, as extend.moderation gives them."""
    products = {}
    for *factors, y in terms:
        products.setdefault(y, []).append("*".join(factors))

    def statistic(m: Moments) -> dict[str, float]:
        out, sd = {}, dict(zip(m.names, m.sd()))
        for y, more in products.items():
            b, _ = regress(m, y, [a for a, z in model.paths if z == y] + more)
            out |= {f"{y}~{x}": v * float(sd[x]) for x, v in b.items()}
        return out

    return second_stage(replicated_scores(df, model, key, replicates, seed, **options), _with_products(model, terms), statistic)


def moderated_mediation(df: DataFrame, model: PathModel, source: str, mediator: str, target: str, moderator: str, key: str, replicates: int, seed: int = 1, **options) -> DataFrame:
    """rep, name, value: the index, the interaction, and the indirect effect at -1, 0 and 1 of the moderator of the second path."""
    product = f"{mediator}*{moderator}"

    def statistic(m: Moments) -> dict[str, float]:
        b, _ = regress(m, target, [a for a, z in model.paths if z == target] + [product])
        first = regress(m, mediator, [a for a, z in model.paths if z == mediator])[0][source]
        times = b[product] * float(m.sd()[m.names.index(product)])
        return {"interaction": times, "index": first * times} | {f"indirect at {level:g}": first * slope for level, slope in simple_slopes(b[mediator], times)}

    return second_stage(replicated_scores(df, model, key, replicates, seed, **options), _with_products(model, [(mediator, moderator, target)]), statistic)


def higher_order(df: DataFrame, model: PathModel, name: str, parts: list[str], paths: list[tuple[str, str]], key: str, replicates: int, mode: str = "A", seed: int = 1, **options) -> DataFrame:
    """rep, name (kind:source:target), value: paths, weights and loadings of the disjoint two-stage model, both stages refitted."""
    rest = [c for c in model.names if c not in parts]
    second = PathModel((Construct(name, tuple(parts), mode), *(Construct(c, (f"{c}_score",)) for c in rest)), tuple(paths))
    columns = {c: F.col(c) for c in parts} | {f"{c}_score": F.col(c) for c in rest}

    def statistic(m: Moments) -> dict[str, float]:
        f = pls.fit(second, m, **options)
        n = second.names
        out = {f"path:{a}:{b}": float(f.paths[n.index(a), n.index(b)]) for a, b in second.paths}
        for i, x in zip(second.block(name), parts):
            out |= {f"weight:{name}:{x}": float(f.weights[i, 0]), f"loading:{name}:{x}": float(f.loadings[i, 0])}
        return out

    return second_stage(replicated_scores(df, model, key, replicates, seed, **options), columns, statistic)
