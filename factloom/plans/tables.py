"""The driver's tables seen as evidence, in Spark and, for the oracles, in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def money(c: str):
    return F.col(c).cast("decimal(18,2)")


def supplies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier to part, weighted by price, valid from shipment, published 30 days later; returns are undated."""
    line = read(spark, sf_dir, "lineitem")
    dated = F.when(F.col("l_returnflag") != "R", F.col("l_shipdate") + F.expr("interval 30 days"))
    return line.select(
        F.lit("lineitem").alias("dataset"),
        F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("subject"),
        F.lit("supplies").alias("predicate"),
        F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("object"),
        money("l_extendedprice").alias("weight"),
        F.col("l_shipdate").alias("valid_from"),
        F.lit(None).cast("timestamp_ntz").alias("valid_to"),
        dated.alias("published_at"),
    )


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer to order, weighted by total, valid for 90 days; open orders of status P are undated."""
    orders = read(spark, sf_dir, "orders")
    return orders.select(
        F.lit("orders").alias("dataset"),
        F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("subject"),
        F.lit("placed").alias("predicate"),
        F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("object"),
        money("o_totalprice").alias("weight"),
        F.col("o_orderdate").alias("valid_from"),
        (F.col("o_orderdate") + F.expr("interval 90 days")).alias("valid_to"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate") + F.expr("interval 10 days")).alias("published_at"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supplies(spark, sf_dir).unionByName(placed(spark, sf_dir))


SUPPLIES_SQL = """(SELECT 'lineitem' AS dataset, 'supplier:' || l_suppkey AS subject, 'supplies' AS predicate, 'part:' || l_partkey AS object,
 CAST(l_extendedprice AS DECIMAL(18,2)) AS weight, l_shipdate AS valid_from, CAST(NULL AS TIMESTAMP) AS valid_to,
 CASE WHEN l_returnflag <> 'R' THEN l_shipdate + INTERVAL 30 DAY END AS published_at FROM lineitem)"""
PLACED_SQL = """(SELECT 'orders' AS dataset, 'customer:' || o_custkey AS subject, 'placed' AS predicate, 'order:' || o_orderkey AS object,
 CAST(o_totalprice AS DECIMAL(18,2)) AS weight, o_orderdate AS valid_from, o_orderdate + INTERVAL 90 DAY AS valid_to,
 CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + INTERVAL 10 DAY END AS published_at FROM orders)"""
EDGES_SQL = f"(SELECT * FROM {SUPPLIES_SQL} UNION ALL SELECT * FROM {PLACED_SQL})"
