"""Moments, path models, regressions and resampling against plain NumPy, and queries against DuckDB."""

import itertools
import math
import time
from decimal import Decimal, getcontext
from itertools import accumulate

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pathspring import catalog
from pathspring.functions import dist
from pathspring.functions import transforms as tx
from pathspring.operators import assess, extend, pls, regression, resample, sem
from pathspring.operators.moments import Moments, moments
from pathspring.plans.model import ModelError, model
from pathspring.sources import tables

SF = "/root/testdata/sf0.001"


def sample(n=300, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal(n)
    m = 0.6 * x + 0.8 * rng.standard_normal(n)
    y = 0.3 * x + 0.5 * m + 0.7 * rng.standard_normal(n)
    cols = {"id": np.arange(n)}
    for name, f in (("x", x), ("m", m), ("y", y)):
        for i, load in enumerate((0.9, 0.82, 0.76), 1):
            cols[f"{name}{i}"] = load * f + math.sqrt(1 - load**2) * rng.standard_normal(n) + 3
    return pd.DataFrame(cols)


MEDIATED = model({n.upper(): [f"{n}{i}" for i in (1, 2, 3)] for n in "xmy"}, [("X", "M"), ("X", "Y"), ("M", "Y")])


@pytest.fixture(scope="module")
def rows(spark):
    pdf = sample()
    return spark.createDataFrame(pdf).cache(), pdf


def by_rows(pdf, m, scheme="path"):
    """The path model on rows, with scores as vectors."""
    z = (pdf[m.indicators] - pdf[m.indicators].mean()) / pdf[m.indicators].std()
    names, blocks = m.names, {c.name: list(c.indicators) for c in m.constructs}
    unit = lambda v: (v - v.mean()) / v.std()
    w = {n: np.ones(len(b)) for n, b in blocks.items()}
    s = {n: unit(z[b].to_numpy() @ w[n]) for n, b in blocks.items()}
    for _ in range(3000):
        new = {}
        for n in names:
            before, after = [a for a, b in m.paths if b == n], [b for a, b in m.paths if a == n]
            inner = sum((np.corrcoef(s[n], s[a])[0, 1] * s[a] for a in after), np.zeros(len(z)))
            if before:
                x = np.column_stack([s[a] for a in before])
                inner = inner + x @ np.linalg.lstsq(x, s[n], rcond=None)[0]
            v = z[blocks[n]].to_numpy().T @ unit(inner)
            v = v / (z[blocks[n]].to_numpy() @ v).std()
            new[n] = v * (1 if v[0] > 0 else -1)
        s = {n: unit(z[b].to_numpy() @ new[n]) for n, b in blocks.items()}
        if max(np.abs(new[n] - w[n]).max() for n in names) < 1e-10:
            break
        w = new
    paths = {}
    for n in names:
        before = [a for a, b in m.paths if b == n]
        if before:
            b = np.linalg.lstsq(np.column_stack([s[a] for a in before]), s[n], rcond=None)[0]
            paths |= {(a, n): v for a, v in zip(before, b)}
    return paths, s


def test_path_model_is_that_of_rows(rows):
    df, pdf = rows
    f = pls.estimate(df, MEDIATED)
    paths, scores = by_rows(pdf, MEDIATED)
    n = MEDIATED.names
    for (a, b), v in paths.items():
        assert f.paths[n.index(a), n.index(b)] == pytest.approx(v, abs=1e-6)
    got = pls.scores(df, f, ["id"]).orderBy("id").toPandas()
    for c in n:
        assert np.allclose(got[c] / got[c].std(), scores[c] / scores[c].std(ddof=1), atol=1e-5)


def test_schemes_and_order_do_not_matter_much(rows):
    df, _ = rows
    base = pls.estimate(df, MEDIATED)
    again = pls.estimate(df.repartition(5).withColumns({"x1": F.col("x1") * 7 + 13}), MEDIATED)
    assert np.allclose(base.paths, again.paths, atol=1e-7)
    assert np.allclose(base.paths, pls.estimate(df, MEDIATED, scheme="factor").paths, atol=0.02)
    with pytest.raises(ModelError):
        model({"A": ["a"], "B": ["b"]}, [("A", "B"), ("B", "A")])


def test_reliability_by_hand():
    r = np.array([[1, 0.5, 0.5], [0.5, 1, 0.5], [0.5, 0.5, 1]])
    assert pls.rho_a(r, np.full(3, 1 / math.sqrt(6))) == pytest.approx(0.75)
    assert pls.rho_a(np.array([[1, 0.6], [0.6, 1]]), np.full(2, 1 / math.sqrt(3.2))) == pytest.approx(0.75)
    items = np.array([[1, 2, 3, 4], [1, 2, 4, 5], [2, 3, 4, 6]])
    v = np.cov(items)
    assert 3 / 2 * (1 - v.trace() / v.sum()) == pytest.approx(0.9818181818181818)


def test_consistent_estimates_recover_the_factors(spark):
    df = spark.createDataFrame(sample(20_000, 9))
    f = pls.estimate(df, MEDIATED, consistent=True)
    assert f.paths[0, 1] == pytest.approx(0.6, abs=0.03) and f.rho_a.min() > 0.8


def test_moments(rows):
    df, pdf = rows
    cols = MEDIATED.indicators
    m = moments(df, cols)
    assert np.allclose(m.cov(), pdf[cols].cov(), atol=1e-10)
    wide = df.select(*[F.col(c) * (i + 1) for i, c in enumerate(cols + cols)]).toDF(*[f"c{i}" for i in range(18)])
    assert np.allclose(moments(wide, wide.columns).cov(), wide.toPandas().cov(), atol=1e-9)
    part = Moments(m.names, 1, 1.0, pdf[cols].iloc[0].to_numpy(), np.zeros((9, 9)))
    assert np.allclose(m.minus(part).cov(), pdf[cols].iloc[1:].cov(), atol=1e-10)
    with pytest.raises(ValueError):
        moments(df.filter("id < 0"), ["x1", "x2"])


def test_jackknife_is_refitting(rows):
    df, pdf = rows
    f = pls.estimate(df, MEDIATED)
    j = resample.jackknife(df, f, "id").filter("kind = 'path' and rep in (0, 7)").toPandas()
    for rep in (0, 7):
        again, _ = by_rows(pdf.drop(rep), MEDIATED)
        for r in j[j.rep == rep].itertuples():
            assert r.estimate == pytest.approx(again[r.source, r.target], abs=1e-6)


def test_bootstrap_counts_and_intervals(rows, spark):
    df, _ = rows
    ref, t = resample.bootstrap(df, MEDIATED, "id", 120)
    s = resample.summary(t, pls.tidy(spark, ref), 120).filter("kind = 'path'").collect()
    assert len(s) == 3 and all(r["low"] < r["estimate"] < r["high"] and r["status"] == "ok" for r in s)
    plan = resample.bootstrap_plan(spark, 50, 4).groupBy("rep").agg(F.sum("times")).collect()
    assert all(r[1] == 50 for r in plan)
    pos = resample.positioned(df, "id").select("pos").toPandas()["pos"]
    assert sorted(pos) == list(range(300))
    assert resample.bca(np.arange(100.0), 49.5, np.arange(20.0)) is not None and resample.bca(np.ones(9), 1.0, np.ones(5)) is None


def test_regressions(rows):
    df, pdf = rows
    xs = ["x1", "m1", "m2"]
    x, y = np.column_stack([np.ones(len(pdf)), pdf[xs]]), pdf["y1"].to_numpy()
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    inv = np.linalg.inv(x.T @ x)
    e = (y - x @ b) / (1 - np.einsum("ij,jk,ik->i", x, inv, x))
    se = np.sqrt(np.diag(inv @ (x * e[:, None] ** 2).T @ x @ inv))
    got = regression.ols_hc3(df, "y1", xs)[0].toPandas()
    assert np.allclose(got.estimate, b, atol=1e-8) and np.allclose(got.se, se, atol=1e-8)
    t = df.withColumn("z", (F.col("y1") > 3).cast("int"))
    z, beta = (pdf["y1"] > 3).to_numpy(float), np.zeros(4)
    for _ in range(30):
        mu = 1 / (1 + np.exp(-x @ beta))
        beta = beta + np.linalg.solve((x * (mu * (1 - mu))[:, None]).T @ x, x.T @ (z - mu))
    assert np.allclose(regression.logistic(t, "z", xs)[0].toPandas().estimate, beta, atol=1e-6)
    with pytest.raises(ValueError):
        regression.logistic(t.withColumn("z", (F.col("x1") > 3).cast("int")), "z", ["x1"])
    values = regression.pca(df, xs).toPandas().groupby("component").eigenvalue.first()
    assert np.allclose(values, np.linalg.eigvalsh(pdf[xs].corr())[::-1])


def test_covariance_model_recovers_its_parameters(spark):
    df = spark.createDataFrame(sample(20_000, 2))
    f = sem.estimate(MEDIATED, moments(df, MEDIATED.indicators))
    stats = {s: v for s, v, _ in sem.fit_statistics(f)}
    assert stats["df"] == 24 and stats["cfi"] > 0.999 and stats["p"] > 0.001
    std = {(k, a, b): v for k, a, b, *_, v in sem.table(f)}
    assert std["loading", "X", "x2"] == pytest.approx(0.82, abs=0.02) and std["path", "M", "X"] == pytest.approx(0.6, abs=0.03)
    tied = [sem.Parameter(q.matrix, q.i, q.j, "t" if q.matrix == "theta" else "") for q in sem.parameters(MEDIATED)]
    d, df_, p = sem.nested_test(sem.estimate(MEDIATED, moments(df, MEDIATED.indicators), tied), f)
    assert df_ == 8 and d > 100 and p < 1e-6


def test_assessment(rows):
    df, pdf = rows
    f = pls.estimate(df, MEDIATED)
    r = pdf[MEDIATED.indicators].corr().to_numpy()
    value = {(a, b): v for a, b, v, _ in assess.htmt(f)}
    mono = [r[np.ix_(b, b)][np.triu_indices(3, 1)].mean() for b in ([0, 1, 2], [3, 4, 5])]
    assert value["X", "M"] == pytest.approx(r[:3, 3:6].mean() / math.sqrt(mono[0] * mono[1]))
    assert all(abs(x[4]) < 1e-12 for x in assess.composite_check(f))
    assert assess.mediation(f, "X", "M", "Y")[4] == "complementary"
    assert [x[0] for x in assess.specific_indirect(f)] == ["X > M > Y"]


def test_extensions(rows, spark):
    df, _ = rows
    t = extend.predict(df, MEDIATED, "Y", "id", 5).toPandas()
    assert (t.q2 > 0).all() and (t.p_mean < 0.05).all()
    fit = extend.gsca(df, MEDIATED).filter("kind = 'path'").toPandas()
    assert np.allclose(fit.estimate, [v for v in by_rows(sample(), MEDIATED)[0].values()], atol=0.1)
    two = df.withColumn("g", F.when(F.col("id") % 2 == 0, "a").otherwise("b"))
    assert all(r["p"] > 0.01 for r in resample.group_difference(two, MEDIATED, "g", "a", "b", "id", 60).collect())


def test_distributions():
    assert dist.t_sf2(2.0, 10) == pytest.approx(0.07338803477074039, abs=1e-12)
    assert dist.chi2_sf(3.84145882069412, 1) == pytest.approx(0.05, abs=1e-12)
    assert dist.f_sf(4.0, 2, 20) == pytest.approx(0.034571613, abs=1e-8)
    assert dist.t_ppf(0.975, 30) == pytest.approx(2.042272456301238, abs=1e-9)
    assert dist.ncx2_cdf(dist.ncx2_nc(9.0, 3, 0.3) * 0 + 9.0, 3, dist.ncx2_nc(9.0, 3, 0.3)) == pytest.approx(0.3, abs=1e-9)
    assert dist.type7([1, 2, 3, 4], 0.25) == 1.75


def exact_ncx2(x: float, df: int, nc: float) -> float:
    """The non-central chi-square for even df, term by term in 40 digits."""
    getcontext().prec = 40
    y, half = Decimal(x) / 2, Decimal(nc) / 2
    terms = lambda rate, n: accumulate(range(1, n), lambda t, j: t * rate / j, initial=(-rate).exp())
    n = int(half + 12 * half.sqrt()) + 60
    below = [Decimal(0), *accumulate(terms(y, n + df // 2))]
    return float(sum(w * (1 - below[k + df // 2]) for k, w in enumerate(terms(half, n))))


def test_non_central_chi_square_of_large_values():
    for x, df, nc in ((9, 2, 5), (3, 8, 0.01), (500, 4, 2), (2, 4, 300), (14169, 4, 13777.4)):
        assert dist.ncx2_cdf(x, df, nc) == pytest.approx(exact_ncx2(x, df, nc), abs=1e-12)
    assert dist.ncx2_cdf(0.0, 4, 3.0) == 0
    began = time.process_time()
    low, high = (dist.ncx2_nc(850158.8, 4, p) for p in (0.95, 0.05))
    assert time.process_time() - began < 20  # 200 sums of 10,000 incomplete gammas each took 1,000 s
    assert low < 850158.8 - 4 < high and high - low == pytest.approx(2 * 1.6449 * math.sqrt(2 * (4 + 2 * 850154.8)), rel=1e-3)
    assert [dist.ncx2_cdf(850158.8, 4, x) for x in (low, high)] == pytest.approx([0.95, 0.05], abs=1e-9)


def test_transforms(spark):
    t = spark.createDataFrame([(1, 2.0, "a"), (2, None, "b"), (3, 4.0, None)], "k int, x double, s string")
    got = lambda df, c: [r[c] for r in df.orderBy("k").collect()]
    assert got(tx.reverse_scale(t, "r", "x", 1, 5), "r") == [4.0, None, 2.0]
    assert got(tx.recode(t, "r", "s", {"a": "A"}, "missing"), "r") == ["A", None, None]
    assert got(tx.dummy(t, "r", "s", "a", "zero"), "r") == [1.0, 0.0, 0.0]
    assert got(tx.row_aggregate(t, "r", ["x", "k"], "sum", "available", 2), "r") == [3.0, None, 7.0]
    with pytest.raises(ValueError):
        tx.add_column(t, "x", 1)
    for bad in (tx.reverse_scale(t, "r", "x", 3, 5), tx.arithmetic(t.withColumn("z", F.lit(0.0)), "r", "x", "/", "z"), tx.recode(t, "r", "s", {"a": "A"}, "error"), tx.group(t, "r", "x", {"u": {"low": 0}, "v": {"low": 3}})):
        with pytest.raises(Exception):
            bad.collect()
    assert tx.lineage("Transform", {"b": 1, "a": 2})["spec"] == '{"a":2,"b":1}'


def test_sources(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("id, score ,name\n1, 2.5 ,x\n2,NA,y\n3,1e3, .\n")
    t = tables.read(spark, str(path))
    assert t.dtypes == [("id", "double"), ("score", "double"), ("name", "string")]
    assert [r["score"] for r in t.orderBy("id").collect()] == [2.5, None, 1000.0] and t.filter("name is null").count() == 1
    assert tables.fingerprint(t).first() == tables.fingerprint(t.repartition(3)).first()
    assert tables.fingerprint(t).first() != tables.fingerprint(t.limit(2)).first()
    with pytest.raises(tables.ImportFailure):
        tables.matrix_moments(["a", "b"], [[1, 2], [2, 1]], 50)
    m = tables.matrix_moments(["a", "b"], [[1, 0.5], [0.5, 1]], 50, "correlation")
    assert np.allclose(m.corr(), [[1, 0.5], [0.5, 1]])


def test_queries_match_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("nation", "part", "orders", "lineitem", "customer", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    queries = catalog.queries()
    for name, sql in catalog.oracle_sql().items():
        got, want = queries[name](spark, SF).toPandas(), con.execute(sql).fetchall()
        columns = [c[0] for c in con.execute(sql).description]
        assert sorted(got.columns) == sorted(columns), name
        key = lambda rows: sorted(rows, key=repr)
        clean = lambda v: None if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)) else round(float(v), 4) if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else v
        a = key([tuple(clean(v) for v in r) for r in got[columns].itertuples(index=False)])
        b = key([tuple(clean(v) for v in r) for r in want])
        assert len(a) == len(b) and all(x == pytest.approx(y, rel=1e-5, abs=2e-4) if isinstance(x, float) else x == y for r, s in itertools.zip_longest(a, b) for x, y in zip(r, s)), name
