"""Frames for models, from the tables of orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathspring.plans.model import PathModel, model


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _totals() -> list:
    price = F.col("l_extendedprice")
    return [
        F.sum("l_quantity").alias("q"),
        F.count("*").cast("double").alias("n"),
        F.sum(price).alias("gross"),
        F.max(price).alias("mx"),
        F.sum(price * F.col("l_discount")).alias("disc"),
        F.sum(price * F.col("l_tax")).alias("tax"),
    ]


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each order that has lines: q, n, gross, mx, disc, tax."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*_totals())


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each customer with orders: segment, norders and the totals of their orders."""
    o = orders(spark, sf_dir).join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    t = o.groupBy("o_custkey").agg(F.count("*").cast("double").alias("norders"), *[F.sum(c).alias(c) for c in ("q", "n", "gross", "disc", "tax")], F.max("mx").alias("mx"))
    return t.join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")).drop("c_custkey")


def order_model() -> PathModel:
    """SIZE -> VALUE, SIZE -> CHARGES, VALUE -> CHARGES."""
    return model({"SIZE": ["q", "n"], "VALUE": ["gross", "mx"], "CHARGES": ["disc", "tax"]}, [("SIZE", "VALUE"), ("SIZE", "CHARGES"), ("VALUE", "CHARGES")])


def chain_model() -> PathModel:
    """SIZE -> VALUE -> CHARGES."""
    return model({"SIZE": ["q", "n"], "VALUE": ["gross", "mx"], "CHARGES": ["disc", "tax"]}, [("SIZE", "VALUE"), ("VALUE", "CHARGES")])


def wide_model() -> PathModel:
    """Three single items and CHARGES, which each leads to; Q leads to M."""
    return model({"Q": ["q"], "N": ["n"], "M": ["mx"], "CHARGES": ["disc", "tax"]}, [("Q", "CHARGES"), ("N", "CHARGES"), ("M", "CHARGES"), ("Q", "M")])


ORDERS_SQL = """f AS (
  SELECT l_orderkey, sum(l_quantity) AS q, count(*)::DOUBLE AS n, sum(l_extendedprice) AS gross, max(l_extendedprice) AS mx,
         sum(l_extendedprice * l_discount) AS disc, sum(l_extendedprice * l_tax) AS tax
  FROM lineitem GROUP BY l_orderkey
)"""
