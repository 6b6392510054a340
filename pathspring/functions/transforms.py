"""Transforms that append columns to a frame and never overwrite one.

Each takes a frame and returns it with one column more. A null input gives null
unless said otherwise. What is an error for a row raises when that row is computed.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _append(df: DataFrame, name: str, value: Column) -> DataFrame:
    if name in df.columns:
        raise ValueError(f"column {name} exists")
    return df.withColumn(name, value)


def _checked(ok: Column, value: Column, message: str) -> Column:
    return F.when(F.coalesce(ok, F.lit(True)), value).otherwise(F.raise_error(F.lit(message)).cast("double"))


def add_column(df: DataFrame, name: str, value, kind: str = "double") -> DataFrame:
    """A constant."""
    return _append(df, name, F.lit(value).cast(kind))


def missing_markers(df: DataFrame, columns: dict[str, str], markers: Sequence) -> DataFrame:
    """New columns (by the old ones' names) in which the markers are null; none is added if one of the names exists."""
    if taken := set(columns.values()) & set(df.columns):
        raise ValueError(f"columns {sorted(taken)} exist")
    return df.withColumns({new: F.when(~F.col(old).isin(list(markers)), F.col(old)) for old, new in columns.items()})


def reverse_scale(df: DataFrame, name: str, column: str, low: float, high: float) -> DataFrame:
    """low + high - x; a value outside of the scale is an error."""
    c = F.col(column)
    return _append(df, name, _checked((c >= low) & (c <= high), F.lit(low + high) - c, f"{column} is outside of {low} to {high}"))


def standardize(df: DataFrame, name: str, column: str) -> DataFrame:
    """z-scores with the sample standard deviation; a constant column is an error."""
    m = df.agg(F.avg(column).alias("m"), F.stddev_samp(column).alias("s")).first()
    if not m["s"]:
        raise ValueError(f"{column} does not vary")
    return _append(df, name, (F.col(column) - m["m"]) / m["s"])


def recode(df: DataFrame, name: str, column: str, mapping: dict, unmapped: str = "keep") -> DataFrame:
    """Exact replacement of values; others are kept, become null (missing) or are an error."""
    c = F.col(column)
    known = c.isin(list(mapping))
    rest = {"keep": c, "missing": F.lit(None), "error": F.when(c.isNotNull(), F.raise_error(F.lit(f"{column} has a value without a code")))}[unmapped]
    value = reduce(lambda w, kv: w.when(c == kv[0], F.lit(kv[1])), list(mapping.items())[1:], F.when(c == next(iter(mapping)), F.lit(next(iter(mapping.values())))))
    return _append(df, name, F.when(known, value.otherwise(None)).otherwise(rest))


def arithmetic(df: DataFrame, name: str, left: str, op: str, right: str | float) -> DataFrame:
    """left op right, a column or a number; division by zero and values that are not finite are errors."""
    a, b = F.col(left).cast("double"), F.col(right).cast("double") if isinstance(right, str) else F.lit(float(right))
    value = {"+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, b)}[op]
    ok = ((b != 0) if op == "/" else F.lit(True)) & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return _append(df, name, F.when(a.isNotNull() & b.isNotNull(), _checked(ok, value, f"{left} {op} {right} is not a number")))


def row_aggregate(df: DataFrame, name: str, columns: Sequence[str], kind: str = "mean", missing: str = "propagate", least: int = 1) -> DataFrame:
    """Sum or mean over columns. propagate: null if any is null; available: over those that are not, if there are `least` of them."""
    present = F.filter(F.array(*[F.col(c).cast("double") for c in columns]), lambda x: x.isNotNull())
    total = F.aggregate(present, F.lit(0.0), lambda a, x: a + x)
    need = len(columns) if missing == "propagate" else max(1, least)
    return _append(df, name, F.when(F.size(present) >= need, total / F.size(present) if kind == "mean" else total))


def dummy(df: DataFrame, name: str, column: str, value, missing: str = "missing") -> DataFrame:
    """1 where the column equals the value, else 0; null stays null or becomes 0."""
    c = F.col(column)
    return _append(df, name, F.when(c.isNull(), F.lit(None if missing == "missing" else 0.0)).when(c == value, 1.0).otherwise(0.0))


def group(df: DataFrame, name: str, column: str, groups: dict[str, dict], unmatched: str = "missing") -> DataFrame:
    """Names of value lists ({"values": [...]}) or ranges ({"low", "high", "low_open", "high_open"}); two that fit are an error."""
    c = F.col(column)

    def fits(g: dict) -> Column:
        if "values" in g:
            return c.isin(list(g["values"]))
        low = F.lit(True) if g.get("low") is None else (c > g["low"] if g.get("low_open") else c >= g["low"])
        high = F.lit(True) if g.get("high") is None else (c < g["high"] if g.get("high_open") else c <= g["high"])
        return low & high

    found = F.filter(F.array(*[F.when(fits(g), F.lit(label)) for label, g in groups.items()]), lambda x: x.isNotNull())
    value = F.when(c.isNull(), F.lit(None).cast("string")).when(F.size(found) > 1, F.raise_error(F.lit(f"{column} is in two groups")).cast("string")).when(F.size(found) == 1, F.get(found, F.lit(0)))
    return _append(df, name, value if unmatched == "missing" else value.otherwise(F.raise_error(F.lit(f"{column} is in no group")).cast("string")))


def scale(df: DataFrame, columns: Sequence[str], how: str = "standardize") -> DataFrame:
    """Each column as <column>_scaled: standardized (sample deviation), centred, or as it is. A constant column, or one of less than two values, is an error."""
    if how not in ("standardize", "center", "none"):
        raise ValueError(f"no scaling {how}")
    m = df.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("sd", F.stddev_samp))]).first()
    if bad := [c for c in columns if not (m[f"{c}_sd"] or 0) > 0]:
        raise ValueError(f"constant or too few values: {bad}")
    move = {c: 0.0 if how == "none" else float(m[f"{c}_mean"]) for c in columns}
    by = {c: float(m[f"{c}_sd"]) if how == "standardize" else 1.0 for c in columns}
    return reduce(lambda d, c: _append(d, f"{c}_scaled", (F.col(c).cast("double") - move[c]) / by[c]), columns, df)


def listwise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without a null or NaN in the columns."""
    return df.dropna(subset=list(columns))


def case_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """used, omitted: complete cases and the others."""
    full = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in columns])
    return df.agg(F.count_if(full).alias("used"), F.count_if(~full).alias("omitted"))


def mean_replace(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each column with its nulls replaced by the mean of what is observed, as <column>_filled."""
    m = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    if bad := [c for c in columns if m[c] is None]:
        raise ValueError(f"nothing observed in {bad}")
    return reduce(lambda d, c: _append(d, f"{c}_filled", F.coalesce(F.col(c).cast("double"), F.lit(m[c]))), columns, df)


def missing_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """variable, n, missing, share, warning (moderate from 5 %, high above 15 %)."""
    t = df.agg(F.count("*").alias("all"), *[F.count(c).alias(c) for c in columns])
    t = t.select("all", F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("n")) for c in columns])).alias("v"))
    t = t.select("v.variable", "v.n", (F.col("all") - F.col("v.n")).alias("missing"), ((F.col("all") - F.col("v.n")) / F.col("all")).alias("share"))
    return t.withColumn("warning", F.when(F.col("share") > 0.15, "high").when(F.col("share") >= 0.05, "moderate").otherwise("none"))


def lineage(operation: str, spec: dict, parent: str | None = None) -> dict:
    """The record of a step: its specification in canonical JSON and that text's SHA-256."""
    text = json.dumps(spec, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return {"operation": operation, "parent": parent, "spec": text, "spec_sha256": hashlib.sha256(text.encode()).hexdigest()}
