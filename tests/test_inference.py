"""Inference by replicates, rounds and segments, against plain NumPy on the same rows."""

import csv
import hashlib
import io
import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pathspring import catalog
from pathspring.functions import dist
from pathspring.operators import assess, extend, inference, pls, regression, resample, sem
from pathspring.operators.moments import Moments, covariances, moments
from pathspring.plans.model import ModelError, model
from pathspring.sources import exports, tables
from tests.test_core import MEDIATED, SF, by_rows, sample


@pytest.fixture(scope="module")
def rows(spark):
    pdf = sample()
    return spark.createDataFrame(pdf).cache(), pdf


def order(values, text):
    return sorted(values, key=lambda v: (hashlib.sha256(text(v).encode()).hexdigest(), v))


def test_ranks_are_those_of_one_sort(spark, rows):
    df, pdf = rows
    got = {(r["rep"], r["id"]): r["rank"] for r in resample.shuffled(df.select("id"), 3, 1, "id").collect()}
    for rep in range(3):
        assert [got[rep, i] for i in order(pdf["id"].tolist(), lambda v: f"1:{rep}:{v}")] == list(range(300))
    folds = {r["id"]: r["fold"] for r in resample.fold_plan(df, "id", 7).collect()}
    assert [folds[i] for i in order(pdf["id"].tolist(), lambda v: f"1:0:{v}")] == [i % 7 for i in range(300)]


def test_bca_table_is_bca(spark, rows):
    df, _ = rows
    ref, boot = resample.bootstrap(df, MEDIATED, "id", 150)
    jack = resample.jackknife(df, ref, "id")
    got = {(r["kind"], r["source"], r["target"]): (r["low"], r["high"]) for r in resample.bca_table(boot, jack, pls.tidy(spark, ref)).collect()}
    b, j = boot.toPandas(), jack.toPandas()
    n = MEDIATED.names
    for x, y in MEDIATED.paths:
        mine = lambda t: t[(t.kind == "path") & (t.source == x) & (t.target == y)].estimate.to_numpy()  # noqa: E731, B023
        assert got["path", x, y] == pytest.approx(resample.bca(mine(b), float(ref.paths[n.index(x), n.index(y)]), mine(j)), rel=1e-9)


def test_tails(spark):
    t = spark.createDataFrame([(z,) for z in (-2.5, 0.0, 1.3)], "z double")
    upper = [1 - dist.norm_cdf(z) for z in (-2.5, 0.0, 1.3)]
    got = lambda tail: [r[0] for r in t.select(resample.normal_p(F.col("z"), tail)).collect()]
    assert got("greater") == pytest.approx(upper) and got("less") == pytest.approx([1 - u for u in upper])
    assert got("two_sided") == pytest.approx([2 * min(u, 1 - u) for u in upper])
    with pytest.raises(ValueError):
        resample.normal_p(F.col("z"), "both")


def test_weights_must_be_above_zero(rows):
    df, _ = rows
    with pytest.raises(ModelError):
        pls.estimate(df.withColumn("w", F.col("id") * 1.0), MEDIATED, "w")


def test_blindfolding(rows):
    df, pdf = rows
    got = {r["construct"]: r["q2"] for r in inference.blindfold(df, MEDIATED, "id").collect()}
    assert set(got) == {"M", "Y"}
    pos = {r["id"]: r["pos"] for r in resample.positioned(df, "id").select("id", "pos").collect()}
    data = pdf.assign(pos=pdf["id"].map(pos)).sort_values("pos").reset_index(drop=True)
    z = (data[MEDIATED.indicators] - data[MEDIATED.indicators].mean()) / data[MEDIATED.indicators].std()
    block = ["m1", "m2", "m3"]
    press = base = 0.0
    for round_ in range(7):
        out = {c: (i * 300 + np.arange(300)) % 7 == round_ for i, c in enumerate(block)}
        filled = z.copy()
        for c in block:
            filled.loc[out[c], c] = z.loc[~out[c], c].mean()
        paths, scores = by_rows(filled, MEDIATED)
        for c in block:
            guess = filled[c].mean() + paths["X", "M"] * scores["X"] / scores["X"].std(ddof=1) * np.corrcoef(filled[c], scores["M"])[0, 1] * filled[c].std()
            press += ((z[c] - guess)[out[c]] ** 2).sum()
            base += ((z[c] - z.loc[~out[c], c].mean())[out[c]] ** 2).sum()
    assert got["M"] == pytest.approx(1 - press / base, abs=2e-3)


def test_exact_fit_turns_the_data_into_the_model(rows, spark):
    df, _ = rows
    f = pls.estimate(df, MEDIATED)
    got = {r["statistic"]: (r["value"], r["p"]) for r in inference.exact_fit(df, MEDIATED, "id", 40).collect()}
    want = {s: v for variant, s, v, _ in assess.model_fit(f) if variant == "estimated"}
    assert all(got[s][0] == pytest.approx(want[s]) and 1 / 41 <= got[s][1] <= 1 for s in ("srmr", "d_uls", "d_g"))


def test_copula_terms(rows):
    df, _ = rows
    f = pls.estimate(df, MEDIATED)
    t = pls.scores(df, f, []).toPandas()
    rank = t["M"].round(12).rank().to_numpy()
    term = np.array([dist.norm_ppf(r / 301) for r in rank])
    x = np.column_stack([np.ones(300), t["X"], t["M"], term])
    want = np.linalg.lstsq(x, t["Y"], rcond=None)[0][1:]
    got = {r["term"]: r["estimate"] for r in extend.copula(df, MEDIATED, "Y", "M").collect()}
    assert [got[k] for k in ("X", "M", "copula")] == pytest.approx(want.tolist(), abs=1e-8)
    p = np.array([1e-9, 0.001, 0.3, 0.5, 0.77, 1 - 1e-6])
    assert dist.norm_ppf_of(p) == pytest.approx([dist.norm_ppf(v) for v in p], abs=1e-8)


def test_segments_are_a_fixed_point(rows):
    df, _ = rows
    parts, stats = (t.collect() for t in inference.segments(df, MEDIATED, "Y", "id", 2, rounds=60))
    b = {s: {r["source"]: r["estimate"] for r in parts if r["segment"] == s} for s in (0, 1)}
    share = {r["segment"]: r["share"] for r in parts}
    assert sum(share.values()) == pytest.approx(1) and b[0] != b[1]
    t = pls.scores(df, pls.estimate(df, MEDIATED), []).toPandas()
    n, v = len(t), {r["statistic"]: r["value"] for r in stats}
    assert v["aic"] == pytest.approx(2 * 7 - 2 * v["log_likelihood"]) and v["bic"] == pytest.approx(7 * math.log(n) - 2 * v["log_likelihood"])


def test_moderated_slopes_and_regions(rows, spark):
    df, pdf = rows
    y, x, w = (pdf[c].to_numpy() for c in ("y1", "x1", "m1"))
    xc, wc = x - x.mean(), w - w.mean()
    d = np.column_stack([np.ones(300), xc, wc, xc * wc])
    inv = np.linalg.inv(d.T @ d)
    b = inv @ d.T @ y
    e = (y - d @ b) / (1 - np.einsum("ij,jk,ik->i", d, inv, d))
    v = inv @ (d * e[:, None] ** 2).T @ d @ inv
    table, slopes = inference.moderated_path(df, "y1", "x1", "m1")
    assert {r["term"]: r["estimate"] for r in table.collect()}["_p"] == pytest.approx(b[3])
    rows_ = slopes.orderBy("level").collect()
    assert [r["slope"] for r in rows_] == pytest.approx([b[1] + b[3] * k * w.std(ddof=1) for k in (-1, 0, 1)])
    crit = dist.t_ppf(0.975, 296)
    for bound in {r[c] for r in rows_ for c in ("region_low", "region_high")} - {None}:
        at = bound - w.mean()
        assert abs(b[1] + b[3] * at) == pytest.approx(crit * math.sqrt(v[1, 1] + 2 * at * v[1, 3] + at * at * v[3, 3]), rel=1e-6)


def test_ceilings_of_permuted_rows(rows):
    df, pdf = rows

    def effect(x, y):
        top = sorted({a: max(y[x == a]) for a in x}.items())
        peers = [p for i, p in enumerate(top) if all(p[1] > q for _, q in top[:i])]
        ends = [p[0] for p in peers[1:]] + [x.max()]
        return sum((e - a) * (y.max() - b) for (a, b), e in zip(peers, ends)) / ((x.max() - x.min()) * (y.max() - y.min()))

    x, y = pdf["x1"].round(1).to_numpy(), pdf["y1"].to_numpy()
    t = df.withColumn("x1", F.round("x1", 1))
    r = inference.nca_permutation(t, "x1", "y1", "id", 19).first()
    assert r["effect"] == pytest.approx(effect(x, y)) and 1 / 20 <= r["p"] <= 1
    pos = {v["id"]: v["pos"] for v in resample.positioned(t, "id").select("id", "pos").collect()}
    at = pdf["id"].map(pos).to_numpy()
    px, py = x[np.argsort(at)], y[np.argsort(at)]
    extreme = 0
    for rep in range(19):
        source = {p: i for i, p in enumerate(order(range(300), lambda v: f"1:{rep}:{v}"))}
        extreme += effect(px, np.array([py[source[i]] for i in range(300)])) >= r["effect"]
    assert r["p"] == pytest.approx((extreme + 1) / 20)


def test_bootstrap_t_is_that_of_plain_draws(rows, spark):
    df, pdf = rows
    replicates, inner, n = 8, 6, len(pdf)
    hit = lambda *parts: int(hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) % n
    plan = {}
    for rep in range(replicates):
        outer = [hit(1, rep, i) for i in range(n)]
        for sub in range(inner):
            for i in range(n):
                k = (rep * inner + sub, outer[hit(1, "inner", rep, sub, i)])
                plan[k] = plan.get(k, 0) + 1
    assert {(r["rep"], r["pos"]): r["times"] for r in resample.nested_plan(spark, n, replicates, inner).collect()} == plan
    ref, outer = resample.bootstrap(df, MEDIATED, "id", replicates)
    place = {r["pos"]: r["id"] for r in resample.positioned(df.select("id"), "id").collect()}
    by_id = pdf.set_index("id")
    x, y = MEDIATED.paths[0]
    at = tuple(MEDIATED.names.index(c) for c in (x, y))
    own = [[] for _ in range(replicates)]
    for k in range(replicates * inner):
        ids = [place[p] for (rep, p), times in plan.items() if rep == k for _ in range(times)]
        some = by_id.loc[ids].reset_index()
        own[k // inner].append(resample.aligned(ref, pls.fit(MEDIATED, of_rows(some, MEDIATED.indicators))).paths[at])
    mine = outer.filter((F.col("kind") == "path") & (F.col("source") == x) & (F.col("target") == y)).orderBy("rep").toPandas()["estimate"].to_numpy()
    z = (mine - ref.paths[at]) / np.std(own, axis=1, ddof=1)
    got = resample.studentized(df, MEDIATED, "id", replicates, inner).filter((F.col("kind") == "path") & (F.col("source") == x) & (F.col("target") == y)).first()
    low, high = (ref.paths[at] - np.quantile(z, q) * mine.std(ddof=1) for q in (0.975, 0.025))
    assert (got["low"], got["high"], got["usable"], got["status"]) == (pytest.approx(low, rel=1e-5), pytest.approx(high, rel=1e-5), replicates, "ok")


def of_rows(pdf, columns):
    x = pdf[columns].to_numpy(float)
    d = x - x.mean(0)
    return Moments(tuple(columns), len(x), float(len(x)), x.mean(0), d.T @ d)


def test_effects_along_routes():
    rng = np.random.default_rng(3)
    a = rng.normal(size=80)
    b = 0.5 * a + rng.normal(size=80)
    c = 0.3 * a - 0.4 * b + rng.normal(size=80)
    m = of_rows(pd.DataFrame({"a": a, "b": b, "c": c}), ["a", "b", "c"])
    got = inference.effects_of({"b": ["a"], "c": ["a", "b"]})(m)
    ab = np.polyfit(a, b, 1)[0]
    ac, bc = np.linalg.lstsq(np.column_stack([a, b, np.ones(80)]), c, rcond=None)[0][:2]
    assert got == pytest.approx({"a > b": ab, "a > c": ac, "b > c": bc, "a > b > c": ab * bc, "total a > c": ac + ab * bc})
    assert got["total a > c"] == pytest.approx(np.polyfit(a, c, 1)[0])
    with pytest.raises(ModelError):
        inference.effects_of({"b": ["a"], "a": ["b"]})


def test_bottlenecks(spark):
    t = spark.createDataFrame([(0.0, 2.0), (2.0, 5.0), (5.0, 4.0), (8.0, 10.0), (10.0, 0.0), (None, 99.0)], "x double, y double")
    got = {(r["ceiling"], r["level"]): (r["required"], r["status"]) for r in regression.nca_bottlenecks(t, "x", "y", (10, 20, 50, 60, 90)).collect()}
    assert got["ce_fdh", 20] == (None, "not_necessary") and got["ce_fdh", 50] == (20.0, "required") and got["ce_fdh", 60] == (80.0, "required")
    slope, cut = np.polyfit([0, 2, 8], [2, 5, 10], 1)
    assert got["cr_fdh", 10] == (None, "not_necessary") and got["cr_fdh", 90] == (pytest.approx((9 - cut) / slope * 10), "required")
    steep = spark.createDataFrame([(0.0, 0.0), (2.0, 1.0), (3.0, 10.0)], "x double, y double")
    assert {(r["ceiling"], r["required"], r["status"]) for r in regression.nca_bottlenecks(steep, "x", "y", (100,)).collect()} == {("ce_fdh", 100.0, "required"), ("cr_fdh", None, "not_attainable")}
    with pytest.raises(ValueError):
        regression.nca_bottlenecks(t.filter("x = 0"), "x", "y")
    with pytest.raises(ValueError):
        regression.nca_bottlenecks(t.filter("x is null"), "x", "y")


def test_exports(spark, tmp_path):
    t = spark.createDataFrame([(1, 'a,"b"', 0.5), (2, None, None), (3, "<x> & 'y'", 1.0), (3, "two\nlines", 1.0)], "id long, name string, v double")
    lines = [r["line"] for r in exports.csv_lines(t).collect()]
    assert lines == ['1,"a,""b""",0.5', "2,,", "3,<x> & 'y',1.0", '3,"two\nlines",1.0']
    assert [next(csv.reader(io.StringIO(x)))[0] for x in lines] == ["1", "2", "3", "3"]
    assert exports.html_rows(t).collect()[2]["line"] == "<tr><td>3</td><td>&lt;x&gt; &amp; &#39;y&#39;</td><td>1.0</td></tr>"
    back = exports.from_arrow_streams(exports.arrow_streams(t), t.schema)
    assert back.schema == t.schema and sorted(back.collect(), key=repr) == sorted(t.collect(), key=repr)
    assert exports.from_arrow_streams(exports.arrow_streams(t.limit(0)), t.schema).collect() == []
    window = lambda df, page: tuple(exports.page_window(df, page).first())
    assert window(spark.range(120), 3) == window(spark.range(120), 9) == (50, 120, 3, 3, 101, 120)
    assert window(spark.range(0), 1) == (50, 0, 1, 1, 0, 0) and window(spark.range(50), -1) == (50, 50, 1, 1, 1, 50)
    with pytest.raises(ValueError):
        exports.page_window(t, 1, 60)


def test_saved_runs_must_agree(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "source string, estimate double")
    for name, manifest in (("one", {"model": "m", "data": "d"}), ("two", {"model": "m", "data": "d"}), ("other", {"model": "m", "data": "e"})):
        tables.archive(rows.withColumn("estimate", F.col("estimate") * (2 if name == "two" else 1)), f"file://{tmp_path}/{name}", manifest)
    got = tables.compare_runs(spark, f"file://{tmp_path}/one", f"file://{tmp_path}/two", ["source"]).collect()
    assert {(r["source"], r["difference"], r["status"]) for r in got} == {("a", 1.0, "both"), ("b", 2.0, "both")}
    with pytest.raises(tables.ImportFailure):
        tables.compare_runs(spark, f"file://{tmp_path}/one", f"file://{tmp_path}/other", ["source"])


def test_left_out_rows_and_analytic_errors(rows):
    df, pdf = rows
    columns, slope = ["x1", "x2", "y1"], inference.slopes_of("y1", ["x1", "x2"])

    def ols(x):
        m = np.column_stack([np.ones(len(x)), x[:, :2]])
        b = np.linalg.lstsq(m, x[:, 2], rcond=None)[0]
        s2 = ((x[:, 2] - m @ b) ** 2).sum() / (len(x) - 3)
        return b[1], math.sqrt(s2 * np.linalg.inv(m.T @ m)[1, 1])

    def statistic(m):
        s, n = m.of(columns).cov(), m.weight
        b = np.linalg.solve(s[:2, :2], s[:2, 2])
        s2 = (s[2, 2] - b @ s[:2, 2]) * (n - 1) / (n - 3)
        return {"x1": b[0], "x1 se": math.sqrt(s2 * np.linalg.inv(s[:2, :2] * (n - 1))[0, 0])}

    jack = {int(r["key"]): r["value"] for r in inference.jackknifed(df, columns, "id", slope).filter("name = 'x1'").collect()}
    x = pdf[columns].to_numpy()
    assert len(jack) == len(x) and jack[17] == pytest.approx(ols(np.delete(x, 17, 0))[0], rel=1e-9)
    t = inference.replicated(df, columns, "id", 40, statistic)
    place = {r["pos"]: r["id"] for r in resample.positioned(df.select("id"), "id").collect()}
    plan = resample.bootstrap_plan(df.sparkSession, len(x), 40).toPandas()
    each = []
    for rep in range(40):
        p = plan[plan.rep == rep]
        each.append(ols(np.repeat(x[[place[i] for i in p.pos]], p.times, axis=0)))
    each, (b, se) = np.array(each), ols(x)
    z = (each[:, 0] - b) / each[:, 1]
    got = inference.bootstrap_t(t, 40).first()
    assert (got["name"], got["value"], got["se"], got["usable"]) == ("x1", pytest.approx(b), pytest.approx(se), 40)
    assert (got["low"], got["high"]) == (pytest.approx(b - np.quantile(z, 0.975) * se, rel=1e-6), pytest.approx(b - np.quantile(z, 0.025) * se, rel=1e-6))
    null = inference.zero_null(t.filter("name = 'x1'"), 40).first()
    assert null["p"] == pytest.approx(((abs(each[:, 0] - b) >= abs(b)).sum() + 1) / 41)


def discrepancy(s, sigma):
    return np.linalg.slogdet(sigma)[1] + np.trace(np.linalg.solve(sigma, s)) - np.linalg.slogdet(s)[1] - len(s)


TWO = model({"X": ["x1", "x2", "x3"], "Y": ["y1", "y2", "y3"]}, [("X", "Y")])


def sigma_of(v, cross):
    """Two factors with markers; cross is the loading of y2 on X."""
    l2, l3, m2, m3, b, px, py, *theta = v
    load = np.array([[1, 0], [l2, 0], [l3, 0], [0, 1], [cross, m2], [0, m3]])
    a = np.array([[px, b * px], [b * px, b * b * px + py]])
    return load @ a @ load.T + np.diag(theta)


def test_score_statistic_from_differences(rows):
    _, pdf = rows
    m = of_rows(pdf, TWO.indicators)
    f = sem.estimate(TWO, m)
    v = np.array([*f.estimates, 0.0])
    assert np.allclose(sigma_of(v[:-1], 0.0), f.sigma, atol=1e-9)
    value = lambda s: lambda x: discrepancy(s, sigma_of(x[:-1], x[-1]))
    h, eye = 1e-4, np.eye(len(v))
    grad = np.array([(value(f.s)(v + h * e) - value(f.s)(v - h * e)) / (2 * h) for e in eye])
    assert np.abs(grad[:-1]).max() < 1e-5
    at = value(f.sigma)  # at its own covariances the second derivatives are twice the expected information
    info = np.array([[(at(v + h * (a + b)) - at(v + h * (a - b)) - at(v - h * (a - b)) + at(v - h * (a + b))) / (4 * h * h) for b in eye] for a in eye]) * f.n / 2
    score = -grad * f.n / 2
    want = score[-1] ** 2 / (info[-1, -1] - info[-1, :-1] @ np.linalg.solve(info[:-1, :-1], info[:-1, -1]))
    stat, p = sem.score_test(f, sem.Parameter("loading", 4, 0))
    assert stat == pytest.approx(want, rel=1e-3) and 0 <= p <= 1
    d = np.sqrt(np.diag(f.s))
    seen = {frozenset(x[:2]): x[2] for x in sem.modification_screen(f)}
    assert len(seen) == 15 and seen[frozenset(("x1", "y2"))] == pytest.approx(f.n * ((f.s - f.sigma)[0, 4] / (d[0] * d[4])) ** 2)


def test_fit_of_a_matrix_of_millions_of_cases(rows):
    _, pdf = rows
    m = of_rows(pdf, TWO.indicators)
    began = time.process_time()
    f = sem.estimate(TWO, tables.matrix_moments(m.names, m.cov(), 9_000_000))
    stats = {s: v for s, v, _ in sem.fit_statistics(f)}
    assert time.process_time() - began < 20  # the interval alone took minutes
    assert stats["chi2"] > 10_000 and stats["rmsea_low"] < stats["rmsea"] < stats["rmsea_high"]
    for side, p in (("rmsea_low", 0.95), ("rmsea_high", 0.05)):
        nc = stats[side] ** 2 * stats["df"] * (9_000_000 - 1)
        assert dist.ncx2_cdf(stats["chi2"], stats["df"], nc) == pytest.approx(p, abs=1e-6)


def test_matrix_input_computes_the_orders_once(spark, monkeypatch):
    seen, scaled = spark.sparkContext.accumulator(0), catalog._scaled

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(catalog, "_scaled", lambda spark, d: scaled(spark, d).mapInArrow(counted, scaled(spark, d).schema))
    got = {r["statistic"]: r["value"] for r in catalog.queries()["sem_matrix_input"](spark, SF).collect()}
    pdf = scaled(spark, SF).toPandas()
    assert seen.value == len(pdf)  # twice as many when the means had a pass of their own
    want = sem.fit_statistics(sem.estimate(catalog._factors(), of_rows(pdf, catalog._factors().indicators)))
    assert got == pytest.approx({s: v for s, v, _ in want}, abs=2e-6)


def test_covariances_of_complete_cases(spark):
    x = np.random.default_rng(5).standard_normal((200, 3)) + 1e6
    rows = [(*map(float, r),) for r in x]
    t = spark.createDataFrame([*rows, (None, 1.0, 2.0), (float("nan"), 1.0, 2.0)], "a double, b double, c double")
    got, n = covariances(t, ["c", "a", "b"])
    assert n == 200 and got == pytest.approx(np.cov(x[:, [2, 0, 1]].T), rel=1e-9, abs=1e-9) and (got == got.T).all()
    with pytest.raises(ValueError, match="no complete case"):
        covariances(t.filter("a is null"), ["a", "b"])
    with pytest.raises(tables.ImportFailure, match="two cases"):
        tables.matrix_moments("ab", *covariances(t.filter(F.col("a") == rows[0][0]), ["a", "b"]))


def test_groups_with_equal_loadings(rows):
    _, pdf = rows
    whole = of_rows(pdf, TWO.indicators)
    one = sem.estimate(TWO, whole)
    chi0, df0, chi1, df1 = sem.two_groups(TWO, whole, whole)
    assert chi0 == pytest.approx(2 * one.n * one.f) and chi1 == pytest.approx(chi0, abs=1e-6) and (df0, df1) == (16, 20)
    other = pdf.assign(y3=pdf.y3 * 2)
    chi0, _, chi1, _ = sem.two_groups(TWO, whole, of_rows(other, TWO.indicators))
    assert chi0 == pytest.approx(2 * one.n * one.f, rel=1e-6) and chi1 > chi0 + 10


def test_intercepts(rows):
    _, pdf = rows
    m = of_rows(pdf, TWO.indicators)
    f = sem.estimate(TWO, m)
    got = {x: (a, e) for x, a, e, _ in sem.mean_structure(f, m)}
    assert got["x2"] == (pytest.approx(pdf.x2.mean()), pytest.approx(pdf.x2.std(ddof=0) / math.sqrt(len(pdf)), rel=1e-6))
    same = sem.fixed_intercepts(TWO, m, dict(zip(m.names, m.mean)))
    assert same.f == pytest.approx(f.f, abs=1e-10)
    moved = sem.fixed_intercepts(TWO, m, {x: v + 0.3 * (x == "x2") for x, v in zip(m.names, m.mean)})
    d = np.array([-0.3 * (x == "x2") for x in m.names])
    full = lambda g: np.linalg.slogdet(g.sigma)[1] + np.trace(np.linalg.solve(g.sigma, f.s)) + d @ np.linalg.solve(g.sigma, d)
    assert full(moved) < full(f)
    with pytest.raises(ModelError):
        sem.fixed_intercepts(TWO, m, {"x1": 0.0})


def test_products_of_indicators(spark):
    rng = np.random.default_rng(8)
    n = 4000
    x, z = rng.standard_normal((2, n))
    y = 0.4 * x + 0.3 * z + 0.35 * x * z + 0.6 * rng.standard_normal(n)
    pdf = pd.DataFrame({f"{k}{i}": f + 0.4 * rng.standard_normal(n) for k, f in (("x", x), ("z", z), ("y", y)) for i in (1, 2)})
    df, names = sem.product_indicators(spark.createDataFrame(pdf), ["x1", "x2"], ["z1", "z2"])
    got = df.toPandas()
    c = pdf - pdf.mean()
    assert names == ["x1_by_z1", "x1_by_z2", "x2_by_z1", "x2_by_z2"] and np.allclose(got["x2_by_z1"].sort_values(), (c.x2 * c.z1 - (c.x2 * c.z1).mean()).sort_values())
    m = model({"X": ["x1", "x2"], "Z": ["z1", "z2"], "XZ": names, "Y": ["y1", "y2"]}, [("X", "Y"), ("Z", "Y"), ("XZ", "Y")])
    f = sem.estimate(m, of_rows(got, m.indicators), sem.parameters(m) + sem.shared_errors(["x1", "x2"], ["z1", "z2"], m))
    paths = {r[2]: r[3] for r in sem.table(f) if r[0] == "path"}
    assert paths == pytest.approx({"X": 0.4, "Z": 0.3, "XZ": 0.35}, abs=0.06)
    plain, _ = sem.product_indicators(spark.createDataFrame(pdf), ["x1"], ["z1"], "none")
    assert np.allclose(plain.toPandas()["x1_by_z1"].sort_values(), (pdf.x1 * pdf.z1).sort_values())
    with pytest.raises(ModelError):
        sem.product_indicators(df, ["x1"], ["z1"])


def test_components_are_a_minimum(rows):
    df, pdf = rows
    t = {(r["kind"], r["source"], r["target"]): r["estimate"] for r in extend.gsca(df, MEDIATED).collect()}
    z = ((pdf[MEDIATED.indicators] - pdf[MEDIATED.indicators].mean()) / pdf[MEDIATED.indicators].std(ddof=0)).to_numpy()
    names = MEDIATED.names
    w = np.array([[t.get(("weight", c, x), 0.0) for c in names] for x in MEDIATED.indicators])

    def loss(w):
        s = z @ w
        s = s / np.sqrt((s**2).mean(0))
        out = 0.0
        for j, c in enumerate(names):
            load = z[:, MEDIATED.block(c)].T @ s[:, j] / len(z)
            out += ((z[:, MEDIATED.block(c)] - np.outer(s[:, j], load)) ** 2).sum()
            before = [names.index(a) for a, b in MEDIATED.paths if b == c]
            if before:
                out += ((s[:, j] - s[:, before] @ np.linalg.lstsq(s[:, before], s[:, j], rcond=None)[0]) ** 2).sum()
        return out / len(z)

    least = loss(w)
    assert t["fit", "model", "FIT"] == pytest.approx(1 - least / 11, abs=1e-8)
    assert t["fit", "model", "AFIT"] == pytest.approx(1 - (least / 11) * (300 * 9) / (300 * 9 - 21), abs=1e-8)
    rng = np.random.default_rng(1)
    assert all(loss(w + 0.02 * rng.standard_normal(w.shape) * (w != 0)) > least - 1e-9 for _ in range(50))
    s = z @ w
    implied = np.eye(9)
    c = np.corrcoef(s.T)  # all paths between three components: the implied correlations are those seen
    load = z.T @ s / len(z)
    own = [next(j for j in range(3) if i in MEDIATED.block(names[j])) for i in range(9)]
    for i in range(9):
        for k in range(9):
            if i != k:
                implied[i, k] = load[i, own[i]] * load[k, own[k]] * c[own[i], own[k]]
    r = np.corrcoef(z.T)
    assert t["fit", "model", "GFI"] == pytest.approx(1 - ((r - implied) ** 2).sum() / (r**2).sum(), abs=1e-6)
    assert t["fit", "model", "SRMR"] == pytest.approx(math.sqrt(((r - implied)[np.tril_indices(9, -1)] ** 2).mean()), abs=1e-6)
