"""Employment histories out of the orders table: an order is a contract, its customer the person."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import segments as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cf, id, inizio, fine, contract_type, retribuzione and prior of each order."""
    start = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("cf"),
        F.col("o_orderkey").alias("id"),
        start.alias("inizio"),
        F.date_add(start, (30 + F.col("o_orderkey") % 90).cast("int")).alias("fine"),
        F.col("o_orderpriority").alias("contract_type"),
        F.col("o_totalprice").alias("retribuzione"),
        (F.col("o_orderkey") % 4).cast("int").alias("prior"),
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segment table of those contracts."""
    return S.build_segments(contracts(spark, sf_dir))


def grouped_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with the customer's market segment as `area`."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cf"), F.col("c_mktsegment").alias("area"))
    return segments(spark, sf_dir).join(customers, "cf")


def period_segments(spark: SparkSession, sf_dir: str, cut: str = "1998-01-01") -> DataFrame:
    """Segments with a period: pre or post the cut date, by their start."""
    period = F.when(F.col("inizio") < F.lit(cut).cast("date"), "pre").otherwise("post")
    return segments(spark, sf_dir).withColumn("period", period)
