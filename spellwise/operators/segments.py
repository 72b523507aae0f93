"""From contracts to person-period segments, their attribute chains, consolidation and validation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C

ATTRIBUTES = (C.CONTRACT, "retribuzione", "prior", "stato", "id")

#: Contracts of a task, about.
PART_ROWS = 100_000
#: Tables of at most so many contracts are left to Spark, which joins small partitions.
FEW_ROWS = 1_000_000


def _by_person(rows: DataFrame, count: int) -> DataFrame:
    """rows partitioned by person.  Partitions of many rows are numbered, so that Spark does not join them to a few per core.

    All that follows by person runs in the tasks of this shuffle; its memory follows the rows of a part, not those of the table.
    """
    if count <= FEW_ROWS:
        return rows.repartition("cf")
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(count / PART_ROWS)), "cf")


def sweep(contracts: DataFrame) -> DataFrame:
    """cf, inizio, fine, arco, over_id, durata: time cut at each start and end, with the number of contracts in force.

    arco 0 is unemployment between contracts; over_id numbers the spans of employment.  One shuffle by person
    serves the sums, the windows and whatever person-level work follows.
    """
    rows = _by_person(contracts.where("fine >= inizio").select("cf", "inizio", "fine"), contracts.count())
    edges = rows.select("cf", F.explode(F.array(F.struct(F.col("inizio").alias("d"), F.lit(1).alias("step")), F.struct(F.date_add("fine", 1).alias("d"), F.lit(-1).alias("step")))).alias("e"))
    days = edges.groupBy("cf", F.col("e.d").alias("inizio")).agg(F.sum("e.step").alias("step"))
    order = Window.partitionBy("cf").orderBy("inizio")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    counted = days.select("cf", "inizio", F.sum("step").over(running).cast("int").alias("arco"), F.date_sub(F.lead("inizio").over(order), 1).alias("fine"))
    opened = (F.col("arco") > 0) & (F.coalesce(F.lag("arco").over(order), F.lit(0)) == 0)
    numbered = counted.withColumn("episode", F.sum(opened.cast("long")).over(running)).where(F.col("fine").isNotNull())
    return numbered.select("cf", "inizio", "fine", "arco", F.when(F.col("arco") > 0, F.col("episode")).otherwise(0).alias("over_id"), (F.datediff("fine", "inizio") + 1).cast("int").alias("durata"))


def attach_attributes(swept: DataFrame, contracts: DataFrame) -> DataFrame:
    """Adds what the covering contracts say: chains of types, mean salary, strongest prior, status and the first id."""
    held = contracts.select(F.col("cf").alias("p"), F.col("id").alias("contract"), F.col("inizio").alias("begins"), F.col("fine").alias("ends"), "contract_type", F.col("retribuzione").alias("pay"), F.col("prior").alias("part"))
    covers = (F.col("p") == F.col("cf")) & (F.col("begins") <= F.col("inizio")) & (F.col("ends") >= F.col("fine"))
    joined = swept.join(held, covers, "left")
    links = F.array_sort(F.collect_list(F.when(F.col("contract").isNotNull(), F.struct("begins", "contract", "contract_type"))))
    chain = F.array_join(F.transform(links, lambda x: x["contract_type"]), "->")
    grouped = joined.groupBy("cf", "inizio", "fine", "arco", "over_id", "durata").agg(
        chain.alias("chain"), F.avg("pay").alias("retribuzione"), F.max("part").alias("prior"), F.min("part").alias("least"), F.coalesce(F.min("contract"), F.lit(0)).alias("id")
    )
    full, least = F.col("prior") >= 1, F.col("least") >= 1
    status = F.when(F.col("arco") == 0, "disoccupato").when(F.col("arco") == 1, F.when(full, "occ_ft").otherwise("occ_pt"))
    status = status.when(least, "over_ft_ft").when(full, "over_pt_ft").otherwise("over_pt_pt")
    return grouped.select("cf", "id", "inizio", "fine", "arco", "over_id", "durata", "prior", F.when(F.col("chain") != "", F.col("chain")).alias(C.CONTRACT), "retribuzione", status.alias("stato"))


def build_segments(contracts: DataFrame) -> DataFrame:
    return attach_attributes(sweep(contracts), contracts)


def _merge(rows: DataFrame, island: str) -> DataFrame:
    order = F.array_sort(F.collect_list(F.when(F.col(C.CONTRACT).isNotNull(), F.struct("inizio", C.CONTRACT))))
    chain = F.array_join(F.transform(order, lambda x: x[C.CONTRACT]), "->")
    merged = rows.groupBy("cf", island).agg(
        F.min("inizio").alias("inizio"),
        F.max("fine").alias("fine"),
        F.max("arco").alias("arco"),
        F.min("over_id").alias("over_id"),
        F.sum("durata").cast("int").alias("durata"),
        F.max("prior").alias("prior"),
        F.avg("retribuzione").alias("retribuzione"),
        chain.alias("chain"),
        F.sum("n_periods").cast("int").alias("n_periods"),
    )
    return merged.select("cf", "inizio", "fine", "arco", "over_id", "durata", "prior", "retribuzione", F.when(F.col("chain") != "", F.col("chain")).alias(C.CONTRACT), "n_periods", (F.col("n_periods") > 1).alias("collapsed"))


def consolidate(segments: DataFrame, kind: str = "both") -> DataFrame:
    """Merges segments: overlapping (one row an over_id), consecutive (adjoining rows of one status), or both in turn.

    Chains are joined in order, days summed; n_periods counts the rows merged and collapsed marks more than one.
    """
    if kind not in ("overlapping", "consecutive", "both"):
        raise ValueError(kind)
    rows = segments if "n_periods" in segments.columns else segments.withColumn("n_periods", F.lit(1))
    if kind in ("overlapping", "both"):
        rows = _merge(rows.withColumn("island", F.when(F.col("over_id") > 0, F.col("over_id")).otherwise(-F.unix_date("inizio").cast("long") - 1000000)), "island")
    if kind in ("consecutive", "both"):
        order = C.by_person()
        follows = (F.col("inizio") == F.date_add(F.lag("fine").over(order), 1)) & ((F.col("arco") > 0) == (F.lag("arco").over(order) > 0))
        rows = _merge(rows.withColumn("island", F.sum(F.when(follows, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))), "island")
    return rows


def min_duration(segments: DataFrame, days: int) -> DataFrame:
    """Segments of at least so many days; unemployment stays whatever its length."""
    return segments.where((F.col("arco") == 0) | (F.col("durata") >= days))


def validate_over_id(segments: DataFrame) -> DataFrame:
    """One row: completeness and coding of over_id, its range, overlap counts, quality score and grade."""
    out = segments.agg(
        (F.count("over_id") / F.greatest(F.count("*"), F.lit(1))).alias("over_id_completeness"),
        F.coalesce(F.bool_and(F.when(F.col("arco") == 0, F.col("over_id") == 0)), F.lit(True)).alias("unemployment_properly_coded"),
        F.coalesce(F.bool_and(F.when(F.col("arco") >= 1, F.col("over_id") > 0)), F.lit(True)).alias("employment_properly_coded"),
        F.min("over_id").alias("min_over_id"),
        F.max("over_id").alias("max_over_id"),
        F.count_distinct(F.when(F.col("arco") > 1, F.col("cf"))).alias("persons_with_overlapping"),
        F.count_distinct("over_id").alias("total_over_id_groups"),
    )
    score = (F.col("over_id_completeness") + F.col("unemployment_properly_coded").cast("int") + F.col("employment_properly_coded").cast("int")) / 3
    grade = F.when(score >= 0.95, "Excellent").when(score >= 0.85, "Good").when(score >= 0.70, "Fair").otherwise("Poor")
    return out.withColumn("quality_score", F.round(score, 6)).withColumn("quality_grade", grade)
