"""Loading of the star schema's tables and the domain's fixed dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2001-08-02"
SPLIT = "2001-02-01"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-grain transactions: customer, day, amount, order."""
    return load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_totalprice").alias("amount"), F.col("o_orderkey").alias("txn"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-grain transactions with their kind: lines flagged R are returns, others sales."""
    li = load(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "R", "return").otherwise("sale")
    return li.select(F.col("l_orderkey").alias("txn"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("store"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("amount"), F.col("l_discount").alias("discount"), F.col("l_shipdate").cast("date").alias("day"), kind.alias("kind"))
