"""Queries of the library's own operators, by the driver's names, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathspring.functions import transforms as tx
from pathspring.operators import assess, extend, inference, pls, regression, resample, second_stage, sem
from pathspring.operators.moments import covariances, moments
from pathspring.plans import frames
from pathspring import catalog_sql
from pathspring.plans.frames import ORDERS_SQL, chain_model, order_model, orders, table, wide_model
from pathspring.plans.model import model
from pathspring.sources import exports, tables

FLAGSHIP = "pls_pm"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return register


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(v.item() if hasattr(v, "item") else v for v in r) for r in rows], schema)


# Transforms


@_query("tx_add_column", "SELECT p_partkey, 1.5::DOUBLE AS c FROM part")
def _(spark, d):
    return tx.add_column(table(spark, d, "part").select("p_partkey"), "c", 1.5)


@_query("tx_missing_markers", "SELECT p_partkey, CASE WHEN p_size NOT IN (1, 7) THEN p_size END AS size_clean FROM part")
def _(spark, d):
    return tx.missing_markers(table(spark, d, "part"), {"p_size": "size_clean"}, [1, 7]).select("p_partkey", "size_clean")


@_query("tx_reverse_scale", "SELECT p_partkey, (1 + 50 - p_size)::DOUBLE AS reversed FROM part")
def _(spark, d):
    return tx.reverse_scale(table(spark, d, "part"), "reversed", "p_size", 1, 50).select("p_partkey", F.col("reversed").cast("double").alias("reversed"))


@_query("tx_standardize", "SELECT p_partkey, round((p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT stddev_samp(p_retailprice) FROM part), 8) AS z FROM part")
def _(spark, d):
    return tx.standardize(table(spark, d, "part"), "z", "p_retailprice").select("p_partkey", F.round("z", 8).alias("z"))


@_query("tx_recode", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' END AS state FROM orders")
def _(spark, d):
    return tx.recode(table(spark, d, "orders"), "state", "o_orderstatus", {"O": "open", "F": "done"}, "missing").select("o_orderkey", "state")


@_query("recode_v1", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' ELSE o_orderstatus END AS state FROM orders")
def _(spark, d):
    return tx.recode(table(spark, d, "orders"), "state", "o_orderstatus", {"O": "open"}, "keep").select("o_orderkey", "state")


@_query("tx_arithmetic", "SELECT p_partkey, round(p_retailprice / p_size, 8) AS ratio FROM part")
def _(spark, d):
    return tx.arithmetic(table(spark, d, "part"), "ratio", "p_retailprice", "/", "p_size").select("p_partkey", F.round("ratio", 8).alias("ratio"))


_HOLES = "CASE WHEN l_orderkey % 7 <> 0 THEN q END"


@_query("tx_row_aggregate", f"WITH {ORDERS_SQL} SELECT l_orderkey, round(coalesce(({_HOLES} + n) / 2, n), 8) AS m, round({_HOLES} + n, 8) AS s FROM f")
def _(spark, d):
    t = orders(spark, d).withColumn("h", F.when(F.col("l_orderkey") % 7 != 0, F.col("q")))
    t = tx.row_aggregate(tx.row_aggregate(t, "m", ["h", "n"], "mean", "available", 1), "s", ["h", "n"], "sum", "propagate")
    return t.select("l_orderkey", F.round("m", 8).alias("m"), F.round("s", 8).alias("s"))


@_query("tx_dummy", "SELECT o_orderkey, (o_orderstatus = 'F')::INT::DOUBLE AS done FROM orders")
def _(spark, d):
    return tx.dummy(table(spark, d, "orders"), "done", "o_orderstatus", "F").select("o_orderkey", "done")


@_query("tx_group", "SELECT p_partkey, CASE WHEN p_size <= 15 THEN 'small' WHEN p_size <= 35 THEN 'medium' END AS class FROM part")
def _(spark, d):
    return tx.group(table(spark, d, "part"), "class", "p_size", {"small": {"high": 15}, "medium": {"low": 15, "low_open": True, "high": 35}}).select("p_partkey", "class")


@_query("prep_listwise", f"WITH {ORDERS_SQL} SELECT count(*) FILTER (WHERE h IS NOT NULL) AS used, count(*) FILTER (WHERE h IS NULL) AS omitted FROM (SELECT {_HOLES} AS h FROM f)")
def _(spark, d):
    return tx.case_counts(orders(spark, d).withColumn("h", F.when(F.col("l_orderkey") % 7 != 0, F.col("q"))), ["h", "n"])


@_query("prep_mean_replace", f"WITH {ORDERS_SQL}, h AS (SELECT l_orderkey, {_HOLES} AS h FROM f) SELECT l_orderkey, round(coalesce(h, (SELECT avg(h) FROM h)), 8) AS h_filled FROM h")
def _(spark, d):
    t = orders(spark, d).select("l_orderkey", F.when(F.col("l_orderkey") % 7 != 0, F.col("q")).alias("h"))
    return tx.mean_replace(t, ["h"]).select("l_orderkey", F.round("h_filled", 8).alias("h_filled"))


@_query("missing_report", f"WITH {ORDERS_SQL} SELECT 'h' AS variable, count(h) AS n, count(*) - count(h) AS missing, round((count(*) - count(h)) / count(*), 8) AS share, CASE WHEN (count(*) - count(h)) / count(*) > 0.15 THEN 'high' WHEN (count(*) - count(h)) / count(*) >= 0.05 THEN 'moderate' ELSE 'none' END AS warning FROM (SELECT {_HOLES} AS h FROM f)")
def _(spark, d):
    t = orders(spark, d).select(F.when(F.col("l_orderkey") % 7 != 0, F.col("q")).alias("h"))
    return tx.missing_report(t, ["h"]).withColumn("share", F.round("share", 8))


# Sources


@_query("preview_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def _(spark, d):
    return tables.page(table(spark, d, "orders"), ["o_orderkey"], 100, 50).select("o_orderkey", "o_totalprice")


@_query("infer_types", "SELECT p_partkey::DOUBLE AS p_partkey, p_brand, p_retailprice FROM part")
def _(spark, d):
    t = table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice")
    return tables.typed(t.select([F.col(c).cast("string").alias(c) for c in t.columns]))


@_query("fingerprint")
def _(spark, d):
    return tables.fingerprint(table(spark, d, "part"))


@_query("result_compare")
def _(spark, d):
    one, other = (_rounded(pls.tidy(spark, _fit(spark, d, scheme=s)).filter("kind = 'path'").select("source", "target", "estimate"), "estimate") for s in ("path", "factor"))
    return _rounded(tables.compare(one, other, ["source", "target"]), "difference")


@_query("saved_run_compare")
def _(spark, d):
    paths, data = [], tables.fingerprint(table(spark, d, "lineitem")).first()["digest"]
    for scheme in ("path", "factor"):
        paths.append(tables.scratch(spark, f"run-{scheme}"))
        run = pls.tidy(spark, _fit(spark, d, scheme=scheme)).filter("kind = 'path'").select("source", "target", "estimate")
        tables.archive(_rounded(run, "estimate"), paths[-1], {"model": repr(order_model()), "data": data, "scheme": scheme})
    return _rounded(tables.compare_runs(spark, *paths, ["source", "target"]), "difference")


_QUOTED = "CASE WHEN contains(p_name, ',') OR contains(p_name, chr(34)) THEN chr(34) || replace(p_name, chr(34), chr(34) || chr(34)) || chr(34) ELSE p_name END"
_ESCAPED = "replace(replace(replace(replace(replace(p_name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#39;')"


@_query("export_tables", f"""WITH t AS (SELECT p_partkey, CASE WHEN p_size > 5 THEN p_name || CASE WHEN p_size > 40 THEN ', "large" <' || p_size || '>' ELSE '' END END AS p_name FROM part)
SELECT 'csv' AS format, p_partkey || ',' || coalesce({_QUOTED}, '') AS line FROM t
UNION ALL SELECT 'html', '<tr><td>' || p_partkey || '</td><td>' || coalesce({_ESCAPED}, '') || '</td></tr>' FROM t""")
def _(spark, d):
    large = F.when(F.col("p_size") > 40, F.concat(F.lit(', "large" <'), F.col("p_size").cast("string"), F.lit(">"))).otherwise("")
    t = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 5, F.concat("p_name", large)).alias("p_name"))
    csv, html = (f(t).select(F.lit(n).alias("format"), "line") for n, f in (("csv", exports.csv_lines), ("html", exports.html_rows)))
    return csv.unionByName(html)


@_query("src_arrow", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def _(spark, d):
    t = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    path = tables.scratch(spark, "orders-arrow")
    exports.arrow_streams(t).write.parquet(path)
    return exports.from_arrow_streams(spark.read.parquet(path), t.schema)


@_query("page_ui", "SELECT size::INT AS size, rows, pages, least(7, pages) AS page, least((least(7, pages) - 1) * size + 1, rows) AS first, least(least(7, pages) * size, rows) AS last FROM (SELECT size, rows, greatest(1, (rows + size - 1) // size) AS pages FROM (SELECT count(*) AS rows FROM customer), (VALUES (50), (100), (250)) v(size))")
def _(spark, d):
    one, two, three = (exports.page_window(table(spark, d, "customer"), 7, size) for size in exports.PAGE_SIZES)
    return one.unionByName(two).unionByName(three)


# Statistics


@_query("stat_summary", "SELECT count(l_quantity) AS n, round(avg(l_quantity), 8) AS mean, round(var_samp(l_quantity), 6) AS variance, round(quantile_cont(l_quantity, 0.25), 8) AS q1, round(quantile_cont(l_quantity, 0.9), 8) AS q9 FROM lineitem")
def _(spark, d):
    t = table(spark, d, "lineitem")
    return t.agg(F.count("l_quantity").alias("n"), F.round(F.avg("l_quantity"), 8).alias("mean"), F.round(F.var_samp("l_quantity"), 6).alias("variance"), F.round(F.percentile("l_quantity", F.lit(0.25)), 8).alias("q1"), F.round(F.percentile("l_quantity", F.lit(0.9)), 8).alias("q9"))


_COLUMNS = ["q", "n", "gross", "mx", "disc", "tax"]


@_query("stat_corr", f"WITH {ORDERS_SQL} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 7) AS r FROM f" for i, a in enumerate(_COLUMNS) for b in _COLUMNS[i + 1 :]))
def _(spark, d):
    r = moments(orders(spark, d), _COLUMNS).corr()
    return _rows(spark, [(a, b, round(float(r[i, j]), 7)) for i, a in enumerate(_COLUMNS) for j, b in enumerate(_COLUMNS) if i < j], "a string, b string, r double")


@_query("stat_alpha", f"WITH {ORDERS_SQL} SELECT round(3 / 2 * (1 - (var_samp(q) + var_samp(n) + var_samp(q + n + q * 2)) / var_samp(q + n + q + n + q * 2)), 7) AS alpha FROM f")
def _(spark, d):
    t = orders(spark, d).select("q", "n", (F.col("q") + F.col("n") + F.col("q") * 2).alias("w"))
    return _rows(spark, [(round(assess.alpha_raw(moments(t, ["q", "n", "w"]).cov()), 7),)], "alpha double")


@_query("wilson", "WITH c AS (SELECT count(*) FILTER (WHERE o_orderstatus = 'F')::DOUBLE AS k, count(*)::DOUBLE AS n, 1.959963984540054 AS z FROM orders) SELECT round((k + z * z / 2 - z * sqrt(k * (n - k) / n + z * z / 4)) / (n + z * z), 8) AS low, round((k + z * z / 2 + z * sqrt(k * (n - k) / n + z * z / 4)) / (n + z * z), 8) AS high FROM c")
def _(spark, d):
    c = table(spark, d, "orders").agg(F.count_if(F.col("o_orderstatus") == "F").alias("k"), F.count("*").alias("n")).first()
    low, high = resample.wilson(c["k"], c["n"])
    return _rows(spark, [(round(low, 8), round(high, 8))], "low double, high double")


# Path models


def _fit(spark, d, **options):
    return pls.estimate(orders(spark, d), order_model(), **options)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in columns})  # never -0.0


@_query("pls_pm")
def _(spark, d):
    return _rounded(pls.tidy(spark, _fit(spark, d)), "estimate")


@_query("pls_factor")
def _(spark, d):
    return _rounded(pls.tidy(spark, _fit(spark, d, scheme="factor")), "estimate")


@_query("pls_pca_weight", f"""WITH {ORDERS_SQL}, r AS (SELECT sqrt(2 + 2 * corr(q, n)) AS a, sqrt(2 + 2 * corr(gross, mx)) AS b, sqrt(2 + 2 * corr(disc, tax)) AS c FROM f)
SELECT * FROM (SELECT 'SIZE' AS source, 'q' AS target, round(1 / a, 6) AS weight FROM r UNION ALL SELECT 'SIZE', 'n', round(1 / a, 6) FROM r
UNION ALL SELECT 'VALUE', 'gross', round(1 / b, 6) FROM r UNION ALL SELECT 'VALUE', 'mx', round(1 / b, 6) FROM r
UNION ALL SELECT 'CHARGES', 'disc', round(1 / c, 6) FROM r UNION ALL SELECT 'CHARGES', 'tax', round(1 / c, 6) FROM r)""")
def _(spark, d):
    t = pls.tidy(spark, _fit(spark, d, scheme="pca")).filter("kind = 'weight'")
    return t.select("source", "target", F.round("estimate", 6).alias("weight"))


@_query("pls_scores")
def _(spark, d):
    t = pls.scores(orders(spark, d), _fit(spark, d), ["l_orderkey"])
    return _rounded(t, *order_model().names)


@_query("plsc")
def _(spark, d):
    return _rounded(pls.tidy(spark, _fit(spark, d, consistent=True)), "estimate")


@_query("wpls")
def _(spark, d):
    t = frames.customers(spark, d)
    f = pls.estimate(t, order_model(), "norders")
    n = pls.weight_counts(t, "norders").first()
    rows = _rows(spark, [("weights", "cases", x, n[x], "ok") for x in ("sum", "effective")], "kind string, source string, target string, estimate double, status string")
    return _rounded(pls.tidy(spark, f).unionByName(rows), "estimate")


@_query("as_reliability")
def _(spark, d):
    return _rounded(_rows(spark, assess.reliability(_fit(spark, d)), "construct string, statistic string, value double, reason string"), "value")


@_query("as_htmt", f"""WITH {ORDERS_SQL} SELECT 'SIZE' AS construct, 'VALUE' AS other, round((corr(q, gross) + corr(q, mx) + corr(n, gross) + corr(n, mx)) / 4 / sqrt(corr(q, n) * corr(gross, mx)), 6) AS value, NULL::VARCHAR AS reason FROM f
UNION ALL SELECT 'SIZE', 'CHARGES', round((corr(q, disc) + corr(q, tax) + corr(n, disc) + corr(n, tax)) / 4 / sqrt(corr(q, n) * corr(disc, tax)), 6), NULL FROM f
UNION ALL SELECT 'VALUE', 'CHARGES', round((corr(gross, disc) + corr(gross, tax) + corr(mx, disc) + corr(mx, tax)) / 4 / sqrt(corr(gross, mx) * corr(disc, tax)), 6), NULL FROM f""")
def _(spark, d):
    return _rounded(_rows(spark, assess.htmt(_fit(spark, d)), "construct string, other string, value double, reason string"), "value")


@_query("as_htmt_plus")
def _(spark, d):
    return _rounded(_rows(spark, assess.htmt(_fit(spark, d), True), "construct string, other string, value double, reason string"), "value")


@_query("as_cross_loadings")
def _(spark, d):
    return _rounded(_rows(spark, assess.cross_loadings(_fit(spark, d)), "indicator string, construct string, value double"), "value")


@_query("as_fornell_larcker")
def _(spark, d):
    return _rounded(_rows(spark, assess.fornell_larcker(_fit(spark, d)), "construct string, other string, value double"), "value")


@_query("as_structure")
def _(spark, d):
    return _rounded(_rows(spark, assess.structure(_fit(spark, d)), "construct string, predictor string, statistic string, value double"), "value")


@_query("as_fit")
def _(spark, d):
    return _model_fit(spark, d, ("srmr", "d_uls"))


@_query("as_fit_ml")
def _(spark, d):
    return _model_fit(spark, d, ("d_g", "chi2", "nfi"))


def _model_fit(spark, d, statistics):
    rows = [r for r in assess.model_fit(pls.estimate(orders(spark, d), chain_model())) if r[1] in statistics]
    return _rounded(_rows(spark, rows, "variant string, statistic string, value double, reason string"), "value")


@_query("cca")
def _(spark, d):
    return _rounded(_rows(spark, assess.composite_check(pls.estimate(orders(spark, d), chain_model())), "construct string, other string, observed double, implied double, difference double"), "observed", "implied", "difference")


_TETRADS = ["q", "n", "gross", "disc"]


@_query("cta", f"""WITH {ORDERS_SQL}, s AS (SELECT covar_samp(q, n) AS qn, covar_samp(q, gross) AS qg, covar_samp(q, disc) AS qd, covar_samp(n, gross) AS ng, covar_samp(n, disc) AS nd, covar_samp(gross, disc) AS gd, var_samp(q) * var_samp(gross) AS v FROM f)
SELECT '1' AS tetrad, round((qn * gd - qd * ng) / v, 6) AS value FROM s UNION ALL SELECT '2', round((qg * nd - qn * gd) / v, 6) FROM s UNION ALL SELECT '3', round((qd * ng - qg * nd) / v, 6) FROM s""")
def _(spark, d):
    v = moments(orders(spark, d), _TETRADS).cov()
    t = assess.tetrads(_TETRADS, v)
    return _rows(spark, [(x[4], round(x[5] / float(v[0, 0] * v[2, 2]), 6)) for x in t], "tetrad string, value double")


@_query("mediation")
def _(spark, d):
    r = assess.mediation(_fit(spark, d), "SIZE", "VALUE", "CHARGES")
    return _rounded(_rows(spark, [r], "direct double, indirect double, total double, vaf double, class string"), "direct", "indirect", "total", "vaf")


@_query("specific_indirect")
def _(spark, d):
    return _rounded(_rows(spark, assess.specific_indirect(_fit(spark, d)), "route string, effect double"), "effect")


@_query("as_ipma")
def _(spark, d):
    f = _fit(spark, d)
    names = [*assess.importance(f, "CHARGES")]
    s = pls.scores(orders(spark, d), f, [])
    r = s.agg(*[F.expr(f"(avg({n}) - min({n})) / (max({n}) - min({n})) * 100").alias(n) for n in names]).first()
    return _rounded(_rows(spark, [(n, v, float(r[n])) for n, v in assess.importance(f, "CHARGES").items()], "construct string, importance double, performance double"), "importance", "performance")


# Regressions


@_query("ols_hc3", f"WITH {ORDERS_SQL} SELECT * FROM (SELECT '(intercept)' AS term, round(regr_intercept(gross, q), 4) AS estimate FROM f UNION ALL SELECT 'q', round(regr_slope(gross, q), 4) FROM f)")
def _(spark, d):
    return regression.ols_hc3(orders(spark, d), "gross", ["q"])[0].select("term", F.round("estimate", 4).alias("estimate"))


@_query("ols_hc3_errors", f"""WITH {ORDERS_SQL}, m AS (SELECT avg(q) AS mq, regr_sxx(gross, q) AS sxx, count(*) AS k, regr_slope(gross, q) AS b, regr_intercept(gross, q) AS a FROM f
), e AS (SELECT (q - mq) AS z, (gross - a - b * q) / (1 - 1 / k - (q - mq) * (q - mq) / sxx) AS u, sxx FROM f, m)
SELECT 'q' AS term, round(sqrt(sum(z * z * u * u)) / max(sxx), 5) AS se FROM e""")
def _(spark, d):
    return regression.ols_hc3(orders(spark, d), "gross", ["q"])[0].filter("term = 'q'").select("term", F.round("se", 5).alias("se"))


@_query("ols_multiple")
def _(spark, d):
    t = regression.ols_hc3(orders(spark, d), "gross", ["q", "n", "disc"])[0]
    return _rounded(t.select("term", F.round("estimate", 4).alias("estimate"), F.round("se", 4).alias("se"), "t", "p"), "t", "p")


@_query("logistic")
def _(spark, d):
    t = orders(spark, d).select("n", (F.col("gross") >= 100_000).cast("int").alias("big"))
    return _rounded(regression.logistic(t, "big", ["n"])[0], "estimate", "se", "z", "p", "odds")


@_query("pca")
def _(spark, d):
    return _rounded(regression.pca(orders(spark, d), _COLUMNS), "eigenvalue", "share", "loading")


@_query("pca_two", f"WITH {ORDERS_SQL} SELECT 1 AS component, round(1 + corr(q, n), 6) AS eigenvalue FROM f UNION ALL SELECT 2, round(1 - corr(q, n), 6) FROM f")
def _(spark, d):
    return regression.pca(orders(spark, d), ["q", "n"]).select("component", F.round("eigenvalue", 6).alias("eigenvalue")).distinct()


@_query("nca_peers", f"WITH {ORDERS_SQL}, t AS (SELECT n AS x, max(gross) AS y FROM f GROUP BY n), b AS (SELECT x, y, max(y) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM t) SELECT x, round(y, 4) AS y FROM b WHERE p IS NULL OR y > p")
def _(spark, d):
    return _rounded(regression.nca_peers(orders(spark, d), "n", "gross"), "y").withColumn("y", F.round("y", 4))


_PEERS_SQL = f"""{ORDERS_SQL}, t AS (SELECT n AS x, max(gross) AS y FROM f GROUP BY n), b AS (SELECT x, y, max(y) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM t
), s AS (SELECT min(n) AS x0, max(n) AS x1, min(gross) AS y0, max(gross) AS y1 FROM f
), k AS (SELECT x, y, lead(x) OVER (ORDER BY x) AS nx FROM b WHERE p IS NULL OR y > p
), l AS (SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS cut FROM k)"""


@_query("nca", f"""WITH {_PEERS_SQL}, e AS (SELECT *, least(greatest((y0 - cut) / slope, x0), x1) AS a, least(greatest((y1 - cut) / slope, x0), x1) AS b FROM l, s)
SELECT 'ce_fdh' AS ceiling, round(sum((coalesce(nx, x1) - x) * (y1 - y)) / max((x1 - x0) * (y1 - y0)), 6) AS effect FROM k, s
UNION ALL SELECT 'cr_fdh', round(((a - x0) * (y1 - y0) + (y1 - cut) * (b - a) - slope * (b * b - a * a) / 2) / ((x1 - x0) * (y1 - y0)), 6) FROM e""")
def _(spark, d):
    return regression.nca(orders(spark, d), "n", "gross").select("ceiling", F.round("effect", 6).alias("effect"))


@_query("nca_bottlenecks", f"""WITH {_PEERS_SQL}, w AS (SELECT level::INT AS level, y0 + level / 100 * (y1 - y0) AS want, s.*, l.* FROM range(10, 100, 10) r(level), s, l
), q AS (SELECT 'ce_fdh' AS ceiling, level, x0, x1, (SELECT min(x) FROM k WHERE y >= want) AS need FROM w UNION ALL SELECT 'cr_fdh', level, x0, x1, (want - cut) / slope FROM w)
SELECT ceiling, level, CASE WHEN need > x0 AND need <= x1 THEN round((need - x0) / (x1 - x0) * 100, 6) END AS required, CASE WHEN need <= x0 THEN 'not_necessary' WHEN need > x1 THEN 'not_attainable' ELSE 'required' END AS status FROM q""")
def _(spark, d):
    return _rounded(regression.nca_bottlenecks(orders(spark, d), "n", "gross"), "required")


# Resampling


@_query("rs_plan", "SELECT rep::BIGINT AS rep, pos::BIGINT AS pos, count(*) AS times FROM (SELECT rep, ('0x' || substr(sha256('1:' || rep || ':' || i), 1, 13))::BIGINT % 200 AS pos FROM range(20) a(rep), range(200) b(i)) GROUP BY ALL")
def _(spark, d):
    return resample.bootstrap_plan(spark, 200, 20)


@_query("fold_plan", "SELECT o_orderkey, (row_number() OVER (ORDER BY sha256('1:0:' || o_orderkey), o_orderkey) - 1) % 10 AS fold FROM orders")
def _(spark, d):
    return resample.fold_plan(table(spark, d, "orders"), "o_orderkey", 10)


@_query("rs_boot_pls")
def _(spark, d):
    ref, t = resample.bootstrap(frames.customers(spark, d), order_model(), "o_custkey", 200)
    return _summarised(spark, ref, t, 200)


def _summarised(spark, ref, t, replicates):
    return _rounded(resample.summary(t, pls.tidy(spark, ref), replicates), "estimate", "mean", "bias", "se", "low", "high", "t", "p")


@_query("rs_jackknife")
def _(spark, d):
    t = frames.customers(spark, d)
    f = pls.estimate(t, order_model())
    j = resample.jackknife(t, f, "o_custkey").filter("kind = 'path'")
    return _rounded(j.groupBy("source", "target").agg(F.count("*").alias("n"), F.expr("sqrt((count(*) - 1) * var_pop(estimate))").alias("se")), "se")


@_query("mga_permutation")
def _(spark, d):
    return _rounded(resample.group_difference(frames.customers(spark, d), order_model(), "c_mktsegment", "AUTOMOBILE", "BUILDING", "o_custkey", 100), "first", "second", "difference", "p")


@_query("rs_perm_plsc")
def _(spark, d):
    return _rounded(resample.group_difference(frames.customers(spark, d), order_model(), "c_mktsegment", "AUTOMOBILE", "BUILDING", "o_custkey", 100, consistent=True), "first", "second", "difference", "p")


# Extensions


@_query("moderation_two_stage")
def _(spark, d):
    return _rounded(extend.moderation(orders(spark, d), order_model(), [("SIZE", "VALUE", "CHARGES")]), "estimate", "r2")


@_query("nonlinear")
def _(spark, d):
    return _rounded(extend.nonlinear(orders(spark, d), order_model()), "linear", "quadratic", "r2_change")


@_query("copula")
def _(spark, d):
    return _rounded(extend.copula(orders(spark, d), order_model(), "CHARGES", "VALUE"), "estimate", "skewness")


@_query("hoc_two_stage")
def _(spark, d):
    return _rounded(extend.higher_order(orders(spark, d), order_model(), "SCALE", ["SIZE", "VALUE"], [("SCALE", "CHARGES")]), "estimate")


@_query("predict_kfold")
def _(spark, d):
    t = extend.predict(orders(spark, d), order_model(), "CHARGES", "l_orderkey", 10)
    return _rounded(t, *[c for c in t.columns if c != "indicator"])


@_query("model_compare")
def _(spark, d):
    t = extend.compare_models(orders(spark, d), order_model(), chain_model(), "CHARGES", "l_orderkey", 10)
    return t.select("statistic", *[(F.round(c, 3) + F.lit(0.0)).alias(c) for c in t.columns[1:]])


@_query("gsca")
def _(spark, d):
    return _rounded(extend.gsca(orders(spark, d), order_model()), "estimate")


@_query("micom")
def _(spark, d):
    t = extend.micom(frames.customers(spark, d), order_model(), "c_mktsegment", "AUTOMOBILE", "BUILDING", "o_custkey", 100)
    return _rounded(t, *[c for c, k in t.dtypes if k == "double"])


@_query("power_mc")
def _(spark, d):
    return extend.power(spark, 0.35, 80, 100)


# Covariance structures


def _factors():
    return model({"SIZE": ["q", "n"], "VALUE": ["gross", "mx", "disc"]}, [("SIZE", "VALUE")])


def _scaled(spark, d):
    t = orders(spark, d)
    return t.select((F.col("q") / 50).alias("q"), "n", *[(F.col(c) / 10_000).alias(c) for c in ("gross", "mx")], (F.col("disc") / 1000).alias("disc"))


@_query("sem_ml")
def _(spark, d):
    m = _factors()
    f = sem.estimate(m, moments(_scaled(spark, d), m.indicators))
    return _rounded(_rows(spark, sem.table(f), "kind string, left string, right string, estimate double, se double, z double, p double, std_all double"), "estimate", "se", "z", "p", "std_all")


@_query("sem_fit")
def _(spark, d):
    m = _factors()
    f = sem.estimate(m, moments(_scaled(spark, d), m.indicators))
    return _rounded(_rows(spark, sem.fit_statistics(f), "statistic string, value double, reason string"), "value")


# Statistics one by one


@_query("stat_mean", "SELECT round(avg(o_totalprice), 6) AS mean FROM orders")
def _(spark, d):
    return _rounded(table(spark, d, "orders").agg(F.avg("o_totalprice").alias("mean")), "mean")


@_query("stat_var", "SELECT round(var_samp(p_retailprice), 6) AS variance FROM part")
def _(spark, d):
    return _rounded(table(spark, d, "part").agg(F.var_samp("p_retailprice").alias("variance")), "variance")


@_query("q_type7", "SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.025), 6) AS low, round(quantile_cont(o_totalprice, 0.975), 6) AS high FROM orders GROUP BY o_orderstatus")
def _(spark, d):
    t = table(spark, d, "orders").groupBy("o_orderstatus").agg(F.percentile("o_totalprice", F.lit(0.025)).alias("low"), F.percentile("o_totalprice", F.lit(0.975)).alias("high"))
    return _rounded(t, "low", "high")


@_query("stat_rho_a", f"WITH {ORDERS_SQL}, r AS (SELECT corr(q, n) AS r FROM f) SELECT round(power(2 / (2 + 2 * r), 2) * (2 * r / (2 + 2 * r)) / (2 / power(2 + 2 * r, 2)), 6) AS rho_a FROM r")
def _(spark, d):
    m = moments(orders(spark, d), ["q", "n"])
    f = pls.fixed(model({"SIZE": ["q", "n"]}, []), m)
    return _rows(spark, [(round(float(pls.rho_a(f.s, f.weights[:, 0])), 6),)], "rho_a double")


@_query("prep_scale", "SELECT p_partkey, round(p_size - (SELECT avg(p_size) FROM part), 6) AS centred FROM part")
def _(spark, d):
    t = tx.scale(table(spark, d, "part"), ["p_size"], "center")
    return _rounded(t.select("p_partkey", F.col("p_size_scaled").alias("centred")), "centred")


# Previews, metadata, files


@_query("tx_preview", "SELECT p_partkey, (51 - p_size)::DOUBLE AS reversed FROM part ORDER BY p_partkey LIMIT 20")
def _(spark, d):
    t = tx.reverse_scale(table(spark, d, "part"), "reversed", "p_size", 1, 50)
    return tables.page(t.select("p_partkey", F.col("reversed").cast("double").alias("reversed")), ["p_partkey"], 0, 20)


@_query("tx_lineage", """SELECT 'Transform' AS operation, '{"column":"p_size","high":50,"low":1}' AS spec, sha256('{"column":"p_size","high":50,"low":1}') AS spec_sha256""")
def _(spark, d):
    r = tx.lineage("Transform", {"column": "p_size", "low": 1, "high": 50})
    return _rows(spark, [(r["operation"], r["spec"], r["spec_sha256"])], "operation string, spec string, spec_sha256 string")


@_query("var_search", "SELECT * FROM (VALUES ('p_retailprice')) AS t(name)")
def _(spark, d):
    return _rows(spark, [(x,) for x in tables.variables(table(spark, d, "part"), "PRICE")], "name string")


@_query("meta_update", "SELECT 'p_size' AS name, 'Size of the part' AS label")
def _(spark, d):
    t = tables.with_metadata(table(spark, d, "part"), "p_size", label="Size of the part")
    return _rows(spark, [(x, t.schema[x].metadata["label"]) for x in tables.variables(t, "size of")], "name string, label string")


@_query("src_delimited", "SELECT n_nationkey::DOUBLE AS n_nationkey, n_name FROM nation")
def _(spark, d):
    path = tables.scratch(spark, "nation.csv")
    table(spark, d, "nation").select("n_nationkey", "n_name").write.csv(path, header=True)
    return tables.read_delimited(spark, path)


@_query("reopen_verify", "SELECT count(*) AS rows, true AS same FROM supplier")
def _(spark, d):
    path = tables.scratch(spark, "supplier")
    t = table(spark, d, "supplier")
    tables.archive(t, path, {"name": "supplier"})
    back, _ = tables.reopen(spark, path)
    return tables.fingerprint(back).join(tables.fingerprint(t).select(F.col("digest").alias("before"))).select("rows", (F.col("digest") == F.col("before")).alias("same"))


@_query("src_matrix")
def _(spark, d):
    names = ["q", "n", "gross"]
    whole = moments(orders(spark, d), names)
    r = tables.matrix_moments(names, whole.cov(), whole.n).corr()
    return _rounded(_rows(spark, [(a, b, r[i, j]) for i, a in enumerate(names) for j, b in enumerate(names) if i < j], "i string, j string, r double"), "r")


# Path models, other forms


@_query("pls_init_individual")
def _(spark, d):
    m = moments(orders(spark, d), order_model().indicators)
    first = pls.fit(order_model(), m)
    return _rounded(pls.tidy(spark, pls.fit(order_model(), m, start=abs(first.weights) + 0.1 * (first.weights != 0))), "estimate")


@_query("pls_fixed_scoring", f"""WITH {ORDERS_SQL}, z AS (SELECT (q - avg(q) OVER ()) / stddev_samp(q) OVER () + (n - avg(n) OVER ()) / stddev_samp(n) OVER () AS a, (gross - avg(gross) OVER ()) / stddev_samp(gross) OVER () + (mx - avg(mx) OVER ()) / stddev_samp(mx) OVER () AS b FROM f)
SELECT 'SIZE' AS source, 'VALUE' AS target, round(corr(a, b), 6) AS estimate FROM z""")
def _(spark, d):
    f = pls.fixed(order_model(), moments(orders(spark, d), order_model().indicators))
    return _rounded(pls.tidy(spark, f).filter("kind = 'path' and source = 'SIZE' and target = 'VALUE'").select("source", "target", "estimate"), "estimate")


@_query("pls_controls")
def _(spark, d):
    return _rounded(pls.with_roles(pls.tidy(spark, _fit(spark, d)), order_model(), [("SIZE", "CHARGES")]), "estimate")


@_query("moderation_multi")
def _(spark, d):
    return _rounded(extend.moderation(orders(spark, d), wide_model(), [("Q", "N", "CHARGES"), ("Q", "M", "CHARGES")]), "estimate", "r2")


@_query("moderation_three_way")
def _(spark, d):
    return _rounded(extend.moderation(orders(spark, d), wide_model(), [("Q", "N", "CHARGES"), ("Q", "M", "CHARGES"), ("N", "M", "CHARGES"), ("Q", "N", "M", "CHARGES")]), "estimate", "r2")


@_query("moderated_mediation")
def _(spark, d):
    return _rounded(extend.moderated_mediation(orders(spark, d), wide_model(), "Q", "M", "CHARGES", "N"), "indirect", "index")


@_query("hoc_repeated")
def _(spark, d):
    t = extend.repeated_indicators(orders(spark, d), order_model(), "SCALE", ["SIZE", "VALUE"], [("SIZE", "SCALE"), ("VALUE", "SCALE"), ("SCALE", "CHARGES")])
    return _rounded(t, "estimate")


@_query("as_q2_blindfold")
def _(spark, d):
    return _rounded(inference.blindfold(frames.customers(spark, d), order_model(), "o_custkey"), "q2")


# Inference


@_query("rs_htmt_boot")
def _(spark, d):
    t = inference.replicated(frames.customers(spark, d), order_model().indicators, "o_custkey", 100, inference.htmt_of(order_model()))
    return _rounded(inference.intervals(t, 100), "value", "se", "low", "high")


@_query("rs_regression")
def _(spark, d):
    t = inference.replicated(frames.customers(spark, d), ["q", "n", "gross"], "o_custkey", 100, inference.slopes_of("gross", ["q", "n"]))
    return _rounded(inference.intervals(t, 100), "value", "se", "low", "high")


@_query("rs_process")
def _(spark, d):
    effects = inference.effects_of({"n": ["q"], "gross": ["q", "n"]})
    t = inference.replicated(frames.customers(spark, d), ["q", "n", "gross"], "o_custkey", 200, effects)
    return _rounded(inference.intervals(t, 200), "value", "se", "low", "high")


@_query("rs_studentized")
def _(spark, d):
    t = resample.studentized(frames.customers(spark, d), chain_model(), "o_custkey", 39, 19)
    return _rounded(t.filter("kind in ('path', 'indirect')"), "estimate", "se", "low", "high")


@_query("rs_regression_tests")
def _(spark, d):
    t = inference.replicated(frames.customers(spark, d), ["q", "n", "gross"], "o_custkey", 100, inference.slopes_of("gross", ["q", "n"]))
    return _rounded(inference.zero_null(t, 100), "value", "p")


@_query("rs_regression_bca")
def _(spark, d):
    t, columns, slopes = frames.customers(spark, d), ["q", "n", "gross"], inference.slopes_of("gross", ["q", "n"])
    return _rounded(inference.bca_intervals(inference.replicated(t, columns, "o_custkey", 100, slopes), inference.jackknifed(t, columns, "o_custkey", slopes)), "low", "high")


@_query("rs_mediation")
def _(spark, d):
    ref, t = resample.bootstrap(frames.customers(spark, d), order_model(), "o_custkey", 200)
    return _summarised(spark, ref, t.filter("kind in ('indirect', 'failed')"), 200)


def _second(spark, t):
    return _rounded(inference.intervals(t, 100), "value", "se", "low", "high")


@_query("rs_moderation")
def _(spark, d):
    return _second(spark, second_stage.moderation(frames.customers(spark, d), order_model(), [("SIZE", "VALUE", "CHARGES")], "o_custkey", 100))


@_query("rs_three_way")
def _(spark, d):
    terms = [("Q", "N", "CHARGES"), ("Q", "M", "CHARGES"), ("N", "M", "CHARGES"), ("Q", "N", "M", "CHARGES")]
    return _second(spark, second_stage.moderation(frames.customers(spark, d), wide_model(), terms, "o_custkey", 100))


@_query("rs_modmed")
def _(spark, d):
    return _second(spark, second_stage.moderated_mediation(frames.customers(spark, d), wide_model(), "Q", "M", "CHARGES", "N", "o_custkey", 100))


@_query("rs_hoc")
def _(spark, d):
    return _second(spark, second_stage.higher_order(frames.customers(spark, d), order_model(), "SCALE", ["SIZE", "VALUE"], [("SCALE", "CHARGES")], "o_custkey", 100))


@_query("rs_boot_plsc")
def _(spark, d):
    ref, t = resample.bootstrap(frames.customers(spark, d), order_model(), "o_custkey", 200, consistent=True)
    return _summarised(spark, ref, t, 200)


@_query("rs_freedman_lane")
def _(spark, d):
    return _rounded(inference.freedman_lane(frames.customers(spark, d), order_model(), "SIZE", "CHARGES", "o_custkey", 99), "estimate", "p")


@_query("rs_fit_exact")
def _(spark, d):
    return _rounded(inference.exact_fit(frames.customers(spark, d), order_model(), "o_custkey", 60), "value", "p")


@_query("rs_bca")
def _(spark, d):
    t = frames.customers(spark, d)
    ref, boot = resample.bootstrap(t, order_model(), "o_custkey", 200)
    bounds = resample.bca_table(boot, resample.jackknife(t, ref, "o_custkey"), pls.tidy(spark, ref))
    return _rounded(bounds.filter("kind = 'path'"), "low", "high")


@_query("posthoc_n")
def _(spark, d):
    ref, t = resample.bootstrap(frames.customers(spark, d), order_model(), "o_custkey", 200)
    s = resample.summary(t, pls.tidy(spark, ref), 200).filter("kind = 'path' and p < 0.05").collect()
    return _rows(spark, [(inference.technical_sample_size([r["estimate"] for r in s]),)], "minimum_n long")


@_query("pls_pos")
def _(spark, d):
    return _rounded(inference.segments(frames.customers(spark, d), order_model(), "CHARGES", "o_custkey")[0], "share", "estimate")


@_query("fimix")
def _(spark, d):
    return _rounded(inference.segments(frames.customers(spark, d), order_model(), "CHARGES", "o_custkey", 2)[1], "value")


@_query("process_path")
def _(spark, d):
    return _rounded(inference.moderated_path(orders(spark, d), "gross", "q", "n")[1], "level", "slope", "region_low", "region_high")


@_query("nca_permutation")
def _(spark, d):
    return _rounded(inference.nca_permutation(frames.customers(spark, d), "norders", "gross", "o_custkey", 29), "effect", "p")


# Covariance structures, other forms


@_query("sem_matrix_input")
def _(spark, d):
    matrix, n = covariances(_scaled(spark, d), _factors().indicators)
    again = tables.matrix_moments(_factors().indicators, matrix, n)
    return _rounded(_rows(spark, sem.fit_statistics(sem.estimate(_factors(), again)), "statistic string, value double, reason string"), "value")


@_query("cfa_ml")
def _(spark, d):
    m = model({"SIZE": ["q", "n"], "VALUE": ["gross", "mx", "disc"]}, [])
    f = sem.estimate(m, moments(_scaled(spark, d), m.indicators))
    return _rounded(_rows(spark, sem.table(f), "kind string, left string, right string, estimate double, se double, z double, p double, std_all double"), "estimate", "se", "z", "p", "std_all")


@_query("mod_screen")
def _(spark, d):
    f = sem.estimate(_factors(), moments(_scaled(spark, d), _factors().indicators))
    return _rounded(_rows(spark, sem.modification_screen(f), "left string, right string, value double"), "value")


@_query("score_lm")
def _(spark, d):
    f = sem.estimate(_factors(), moments(_scaled(spark, d), _factors().indicators))
    return _rounded(_rows(spark, [("SIZE", "disc", *sem.score_test(f, sem.Parameter("loading", 4, 0)))], "factor string, indicator string, statistic double, p double"), "statistic", "p")


@_query("sem_nested_lrt")
def _(spark, d):
    m = moments(_scaled(spark, d), _factors().indicators)
    pars = sem.parameters(_factors())
    tied = [sem.Parameter(q.matrix, q.i, q.j, "equal" if q.matrix == "loading" and q.j == 1 else "") for q in pars]
    r = sem.nested_test(sem.estimate(_factors(), m, tied), sem.estimate(_factors(), m))
    return _rounded(_rows(spark, [r], "chi2 double, df int, p double"), "chi2", "p")


@_query("sem_invariance")
def _(spark, d):
    t = frames.customers(spark, d)
    m = model({"VALUE": ["gross", "mx", "disc", "tax"]}, [])
    t = t.select("c_mktsegment", *[(F.col(c) / s).alias(c) for c, s in (("gross", 100_000), ("mx", 10_000), ("disc", 10_000), ("tax", 10_000))])
    g = [moments(t.filter(F.col("c_mktsegment") == x), m.indicators) for x in ("AUTOMOBILE", "BUILDING")]
    return _rounded(_rows(spark, [sem.two_groups(m, *g)], "configural_chi2 double, configural_df int, metric_chi2 double, metric_df int"), "configural_chi2", "metric_chi2")


@_query("rs_cbsem")
def _(spark, d):
    m = _factors()

    def statistic(x):
        return {f"{r[0]}:{r[1]}:{r[2]}": r[3] for r in sem.table(sem.estimate(m, x)) if r[0] in ("loading", "path")}

    t = inference.replicated(_keyed(spark, d), m.indicators, "l_orderkey", 40, statistic)
    return _rounded(inference.intervals(t, 40), "value", "se", "low", "high")


def _charges(spark, d):
    """Customers' totals in units that suit the factor VALUE, and its model with a statistic of moments: loadings and their errors."""
    t = frames.customers(spark, d)
    m = model({"VALUE": ["gross", "mx", "disc", "tax"]}, [])

    def statistic(x):
        rows = [r for r in sem.table(sem.estimate(m, x)) if r[0] == "loading"]
        return {r[2]: r[3] for r in rows} | {r[2] + inference.ERROR: r[4] for r in rows}

    return t.select("o_custkey", *[(F.col(c) / s).alias(c) for c, s in (("gross", 100_000), ("mx", 10_000), ("disc", 10_000), ("tax", 10_000))]), m, statistic


@_query("rs_cbsem_stud")
def _(spark, d):
    t, m, statistic = _charges(spark, d)
    return _rounded(inference.bootstrap_t(inference.replicated(t, m.indicators, "o_custkey", 100, statistic), 100), "value", "se", "low", "high")


@_query("rs_cbsem_tests")
def _(spark, d):
    t, m, statistic = _charges(spark, d)
    r = inference.replicated(t, m.indicators, "o_custkey", 100, statistic).filter(~F.col("name").endswith(inference.ERROR))
    return _rounded(inference.zero_null(r, 100), "value", "p")


@_query("rs_cbsem_bca")
def _(spark, d):
    t, m, statistic = _charges(spark, d)
    r, j = (x.filter(~F.col("name").endswith(inference.ERROR)) for x in (inference.replicated(t, m.indicators, "o_custkey", 100, statistic), inference.jackknifed(t, m.indicators, "o_custkey", statistic)))
    return _rounded(inference.bca_intervals(r, j), "low", "high")


@_query("cfa_mean", f"""WITH {ORDERS_SQL}, v AS (SELECT 'q' AS indicator, q / 50 AS v FROM f UNION ALL SELECT 'n', n FROM f UNION ALL SELECT 'gross', gross / 10000 FROM f UNION ALL SELECT 'mx', mx / 10000 FROM f UNION ALL SELECT 'disc', disc / 1000 FROM f)
SELECT indicator, round(avg(v), 4) AS intercept, round(sqrt(var_pop(v) / count(*)), 4) AS se FROM v GROUP BY indicator""")
def _(spark, d):
    m = _factors()
    x = moments(_scaled(spark, d), m.indicators)
    t = _rows(spark, sem.mean_structure(sem.estimate(m, x), x), "indicator string, intercept double, se double, z double")
    return t.select("indicator", F.round("intercept", 4).alias("intercept"), F.round("se", 4).alias("se"))


@_query("sem_prod_ind", f"""WITH {ORDERS_SQL}, c AS (SELECT l_orderkey, (q - avg(q) OVER ()) AS q, n - avg(n) OVER () AS n, disc - avg(disc) OVER () AS disc FROM f)
SELECT l_orderkey, round(q * disc - avg(q * disc) OVER (), 2) + 0.0 AS q_by_disc, round(n * disc - avg(n * disc) OVER (), 2) + 0.0 AS n_by_disc FROM c""")
def _(spark, d):
    t, names = sem.product_indicators(orders(spark, d), ["q", "n"], ["disc"])
    return t.select("l_orderkey", *[(F.round(c, 2) + F.lit(0.0)).alias(c) for c in names])


def _keyed(spark, d):
    t = orders(spark, d)
    return t.select("l_orderkey", (F.col("q") / 50).alias("q"), "n", *[(F.col(c) / 10_000).alias(c) for c in ("gross", "mx")], (F.col("disc") / 1000).alias("disc"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return _SQL | catalog_sql.SQL
