"""The query registry and the inputs that several queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every double so that the order of summation does not show."""
    return df.select(
        *[
            F.round(F.col(f"`{f.name}`"), special.get(f.name, digits)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )


def gaps(spark: SparkSession, sf: str) -> DataFrame:
    """All orders, with injected missing prices and priorities."""
    o = table(spark, sf, "orders")
    return o.select(
        "o_orderkey", "o_custkey", "o_orderstatus",
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("o_totalprice"), "o_orderdate",
        F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority")).alias("o_orderpriority"),
    )


GAPS = """gaps AS (SELECT o_orderkey, o_custkey, o_orderstatus,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS o_totalprice, o_orderdate,
  CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS o_orderpriority FROM orders)"""


def copies(spark: SparkSession, sf: str) -> DataFrame:
    """All orders with gaps, the finished ones twice."""
    g = gaps(spark, sf)
    return g.unionByName(g.where(F.col("o_orderstatus") == "F"))


COPIES = GAPS + """, copies AS (SELECT * FROM gaps UNION ALL SELECT * FROM gaps WHERE o_orderstatus = 'F')"""


def messy(spark: SparkSession, sf: str) -> DataFrame:
    """Every line item price spelled in one of four ways, by line number."""
    l = table(spark, sf, "lineitem")
    us = F.format_number("l_extendedprice", 2)
    eu = F.translate(us, ",.", ".,")
    k = F.col("l_linenumber") % 4
    text = (
        F.when(k == 0, F.concat(eu, F.lit(" €"))).when(k == 1, us)
        .when(k == 2, F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" %"))).otherwise("n/a")
    )
    return l.select("l_orderkey", "l_linenumber", text.alias("price_text"))


MESSY = """messy AS (SELECT l_orderkey, l_linenumber,
  CASE WHEN l_linenumber % 4 = 0 THEN translate(format('{:,.2f}', l_extendedprice), ',.', '.,') || ' €'
       WHEN l_linenumber % 4 = 1 THEN format('{:,.2f}', l_extendedprice)
       WHEN l_linenumber % 4 = 2 THEN CAST(CAST(l_quantity AS INT) AS VARCHAR) || ' %' ELSE 'n/a' END AS price_text
  FROM lineitem)"""


def daily(spark: SparkSession, sf: str) -> DataFrame:
    """One row per day: total order value and number of orders."""
    o = table(spark, sf, "orders")
    day = F.col("o_orderdate").cast("date").cast("timestamp_ntz").alias("ts")
    return o.groupBy(day).agg(
        F.sum(F.round("o_totalprice", 2).cast("decimal(18,2)")).cast("double").alias("value"),
        F.count(F.lit(1)).alias("orders"),
    )


DAILY = """daily AS (SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS ts,
  CAST(SUM(CAST(round(o_totalprice, 2) AS DECIMAL(18,2))) AS DOUBLE) AS value, count(*) AS orders
  FROM orders GROUP BY 1)"""


def daily_by_priority(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("key"), F.col("o_orderdate").cast("date").cast("timestamp_ntz").alias("ts")).agg(
        F.sum(F.round("o_totalprice", 2).cast("decimal(18,2)")).cast("double").alias("value")
    )


DAILY_BY_PRIORITY = """daily_by_priority AS (SELECT o_orderpriority AS key, date_trunc('day', o_orderdate)::TIMESTAMP AS ts,
  CAST(SUM(CAST(round(o_totalprice, 2) AS DECIMAL(18,2))) AS DOUBLE) AS value FROM orders GROUP BY 1, 2)"""


def monthly(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.groupBy(F.trunc("o_orderdate", "month").cast("timestamp_ntz").alias("ts")).agg(
        F.sum(F.round("o_totalprice", 2).cast("decimal(18,2)")).cast("double").alias("value")
    )


MONTHLY = """monthly AS (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS ts,
  CAST(SUM(CAST(round(o_totalprice, 2) AS DECIMAL(18,2))) AS DOUBLE) AS value FROM orders GROUP BY 1)"""
