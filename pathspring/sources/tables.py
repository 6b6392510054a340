"""Delimited files with types found per column, matrix inputs, windows of rows, fingerprints, comparison of results."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathspring.operators.moments import Moments

MISSING = ("", "NA", "N/A", ".")


class ImportFailure(ValueError):
    """A table that cannot be read, with the reason."""


def typed(raw: DataFrame, markers: Sequence[str] = MISSING) -> DataFrame:
    """A frame of strings with markers as nulls and, where every other cell is a finite number, columns of doubles."""
    if len({*raw.columns}) < len(raw.columns) or not all(c.strip() for c in raw.columns):
        raise ImportFailure("headers must be given and differ")
    cell = {c: F.when(~F.trim(F.col(f"`{c}`")).isin(list(markers)), F.trim(F.col(f"`{c}`"))) for c in raw.columns}
    number = {c: F.expr(f"try_cast(trim(`{c}`) as double)") for c in raw.columns}
    bad = raw.agg(*[F.count_if(cell[c].isNotNull() & (number[c].isNull() | F.isnan(number[c]) | (F.abs(number[c]) == float("inf")))).alias(f"b{i}") for i, c in enumerate(raw.columns)], F.count("*").alias("n")).first()
    if not bad["n"]:
        raise ImportFailure("the table has no rows")
    return raw.select(*[(F.when(cell[c].isNotNull(), number[c]) if not bad[f"b{i}"] else cell[c]).alias(c.strip()) for i, c in enumerate(raw.columns)])


def read_delimited(spark: SparkSession, path: str, sep: str = ",", markers: Sequence[str] = MISSING) -> DataFrame:
    """A CSV or TSV file with a header; rows of another width are an error."""
    return typed(spark.read.csv(path, header=True, sep=sep, mode="FAILFAST", enforceSchema=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, nullValue="\u0000"), markers)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The reader for the path's ending."""
    end = path.rsplit(".", 1)[-1].lower()
    if end in ("csv", "txt"):
        return read_delimited(spark, path)
    if end == "tsv":
        return read_delimited(spark, path, "\t")
    if end in ("parquet", "orc", "json"):
        return getattr(spark.read, end)(path)
    raise ImportFailure(f"no reader for .{end}")


def matrix_moments(names: Sequence[str], matrix, n: int, kind: str = "covariance", sd: Sequence[float] | None = None) -> Moments:
    """Moments from a covariance or correlation matrix (with standard deviations, or unit ones) of n cases."""
    m = np.asarray(matrix, dtype=float)
    if n < 2 or m.shape != (len(names),) * 2 or not np.isfinite(m).all():
        raise ImportFailure("a square matrix of finite numbers and two cases at least are needed")
    if np.abs(m - m.T).max() > 1e-10 or (np.diag(m) < 0).any():
        raise ImportFailure("the matrix must be symmetric with a diagonal that is not negative")
    if kind == "correlation":
        if np.abs(np.diag(m) - 1).max() > 1e-10 or np.abs(m).max() > 1 + 1e-10:
            raise ImportFailure("correlations lie in -1 to 1, with 1 on the diagonal")
        m = m * np.outer(sd, sd) if sd is not None else m
    values = np.linalg.eigvalsh(m)
    if values[0] < -max(abs(values[-1]), 1.0) * len(m) * np.finfo(float).eps * 100:
        raise ImportFailure("the matrix is not positive semidefinite")
    return Moments(tuple(names), n, float(n), np.zeros(len(m)), m * (n - 1))


def page(df: DataFrame, order: Sequence[str], offset: int = 0, limit: int = 100) -> DataFrame:
    """A window of rows in a fixed order; a start beyond the end gives no rows."""
    return df.orderBy(*order).offset(max(0, offset)).limit(max(0, limit))


def variables(df: DataFrame, search: str = "") -> list[str]:
    """Columns whose name or label holds the text."""
    return [f.name for f in df.schema if search.lower() in f"{f.name} {f.metadata.get('label', '')}".lower()]


def with_metadata(df: DataFrame, column: str, **values) -> DataFrame:
    """The column with its label, scale, range or the like changed."""
    return df.withMetadata(column, {**df.schema[column].metadata, **values})


def fingerprint(df: DataFrame) -> DataFrame:
    """rows, digest: of the schema and the rows as a multiset, whatever their order and partitions."""
    text = json.dumps([(f.name, f.dataType.simpleString()) for f in df.schema])
    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}), 256)
    parts = [F.bit_xor(F.conv(F.substring(row, 1 + 13 * i, 13), 16, 10).cast("long")) for i in range(4)]
    sums = [F.sum(F.conv(F.substring(row, 1 + 10 * i, 8), 16, 10).cast("decimal(38,0)")) for i in range(2)]
    return df.agg(F.count("*").alias("rows"), F.sha2(F.concat_ws(":", F.lit(text), F.count("*"), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts + sums]), 256).alias("digest"))


def compare(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str = "estimate") -> DataFrame:
    """keys, left, right, difference, status (both, left_only, right_only) of two tidy results."""
    a = left.select(*keys, F.col(value).alias("left"), F.lit(True).alias("_l"))
    b = right.select(*keys, F.col(value).alias("right"), F.lit(True).alias("_r"))
    t = a.join(b, list(keys), "full")
    return t.select(*keys, "left", "right", (F.col("right") - F.col("left")).alias("difference"), F.when(F.col("_l") & F.col("_r"), "both").when(F.col("_l"), "left_only").otherwise("right_only").alias("status"))


def compare_runs(spark: SparkSession, left: str, right: str, keys: Sequence[str], same: Sequence[str] = ("model", "data"), value: str = "estimate") -> DataFrame:
    """compare() of two archived results whose manifests agree on what must be the same; others are refused."""
    (a, one), (b, two) = reopen(spark, left), reopen(spark, right)
    for k in same:
        if k not in one or one[k] != two.get(k):
            raise ImportFailure(f"the runs differ in {k}")
    return compare(a, b, keys, value)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``; where that is unset, a folder of this machine, for a local master only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(folder or 'file://' + tempfile.gettempdir()).rstrip('/')}/pathspring/{uuid.uuid4().hex}-{name}"


def archive(df: DataFrame, path: str, manifest: dict) -> None:
    """The rows as Parquet and, beside them, the manifest with their fingerprint."""
    f = fingerprint(df).first()
    df.write.parquet(f"{path}/rows")
    record = {**manifest, "rows": f["rows"], "digest": f["digest"]}
    df.sparkSession.createDataFrame([(json.dumps(record, sort_keys=True),)], "manifest string").coalesce(1).write.text(f"{path}/manifest")


def reopen(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The rows and the manifest of an archive; rows whose fingerprint differs are refused."""
    record = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    df = spark.read.parquet(f"{path}/rows")
    if fingerprint(df).first()["digest"] != record["digest"]:
        raise ImportFailure("the rows are not those that were archived")
    return df, record
