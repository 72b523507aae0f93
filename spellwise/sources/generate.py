"""Synthetic employment histories from seeded hashes: the same rows for the same seed, whatever the partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C

CONTRACTS = ("A.03.00", "A.03.01", "A.03.08", "A.07.00", "C.01.00")


def _uniform(seed: int, *key: str) -> Column:
    return (F.xxhash64(F.lit(seed), *key) % 1_000_000 + 1_000_000) % 1_000_000 / 1_000_000.0


def histories(spark: SparkSession, persons: int = 4252, contracts: int = 476_400, seed: int = 12345, start: str = "2015-01-01") -> DataFrame:
    """Segments in the canonical layout: per person a run of employment and unemployment spells without gaps."""
    each = max(1, contracts // persons)
    rows = spark.range(persons).withColumnRenamed("id", "cf").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(each))))
    u = lambda k: _uniform(seed + k, "cf", "n")
    job = u(1) < 0.75
    rows = rows.withColumns({"arco": F.when(job, F.when(u(2) < 0.85, 1).when(u(2) < 0.97, 2).otherwise(3)).otherwise(0), "durata": F.greatest(F.lit(1), (-60.0 * F.ln(1 - u(3) * 0.999)).cast("int")).cast("int")})
    order = Window.partitionBy("cf").orderBy("n")
    before = F.sum("durata").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("durata")
    begin = F.date_add(F.lit(start).cast("date"), before.cast("int"))
    opened = ((F.col("arco") > 0) & (F.coalesce(F.lag("arco").over(order), F.lit(0)) == 0)).cast("long")
    rows = rows.withColumns({"inizio": begin, "o": F.sum(opened).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    code = F.element_at(F.array(*map(F.lit, CONTRACTS)), (F.floor(u(4) * len(CONTRACTS)) + 1).cast("int"))
    prior = F.when(F.col("arco") > 0, F.when(u(5) < 0.6, 1 + F.floor(u(6) * 3)).otherwise(-F.floor(u(6) * 2))).cast("int")
    person = lambda k: _uniform(seed + k, "cf")
    return rows.select(
        F.when(F.col("arco") > 0, F.col("cf") * each + F.col("n")).otherwise(0).alias("id"), "cf", "inizio", F.date_add("inizio", F.col("durata") - 1).alias("fine"), F.col("arco").cast("int").alias("arco"), prior.alias("prior"),
        F.when(F.col("arco") > 0, F.col("o")).otherwise(0).alias("over_id"), "durata", F.when(F.col("arco") == 0, "disoccupato").when(F.col("arco") == 1, F.when(prior >= 1, "occ_ft").otherwise("occ_pt")).otherwise("over_pt_ft").alias("stato"),
        F.when(F.col("arco") > 0, code).alias(C.CONTRACT), F.when(F.col("arco") > 0, F.round(800 + 2200 * u(7), 2)).alias("retribuzione"), (16 + F.floor(person(8) * 55)).cast("int").alias("eta"),
        F.when(person(9) < 0.5, "F").otherwise("M").alias("sesso"), F.concat(F.lit("area"), F.floor(person(10) * 5).cast("int").cast("string")).alias("area"),
    )


def validate(segments: DataFrame) -> DataFrame:
    """One row: sizes, missing shares, ranges and whether the basic rules hold."""
    return segments.agg(
        F.count("*").alias("n_rows"), F.count_distinct("cf").alias("n_persons"), C.count_if(F.col(C.CONTRACT).isNull()).alias("n_missing_contract"), F.min("durata").alias("min_duration"), F.max("durata").alias("max_duration"),
        F.bool_and(F.col("inizio") <= F.col("fine")).alias("dates_in_order"), F.bool_and(F.datediff("fine", "inizio") + 1 == F.col("durata")).alias("durations_match"), F.bool_and((F.col("arco") == 0) == (F.col("over_id") == 0)).alias("coding_holds"),
    )
