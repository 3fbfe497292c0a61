"""Trees of citable units: leaves, ancestors, and links that a descendant repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def leaves(units: DataFrame, key: str = "unit_id", parent: str = "parent_id") -> DataFrame:
    """Units that are no unit's parent."""
    return units.join(units.select(F.col(parent).alias(key)).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def ancestors(units: DataFrame, key: str = "unit_id", parent: str = "parent_id") -> DataFrame:
    """(unit, ancestor, distance), each pair once with its least distance, however deep the tree is.

    Pairs are joined with themselves, so the distance that is covered doubles from step to step, until a step
    adds none; a unit in a cycle is no ancestor of itself. No row limit of recursive SQL applies.
    """
    spark = units.sparkSession
    pairs = units.where(F.col(parent).isNotNull() & (F.col(parent) != F.col(key))).select(F.col(key).alias("unit"), F.col(parent).alias("ancestor")).distinct().withColumn("distance", F.lit(1))
    pairs, n = _kept(spark, pairs)
    while True:
        further = pairs.select(F.col("unit").alias("ancestor"), F.col("ancestor").alias("_up"), F.col("distance").alias("_more"))
        longer = pairs.join(further, "ancestor").where("_up <> unit").select("unit", F.col("_up").alias("ancestor"), (F.col("distance") + F.col("_more")).alias("distance"))
        pairs, now = _kept(spark, pairs.unionByName(longer).groupBy("unit", "ancestor").agg(F.min("distance").alias("distance")))
        if now == n:
            return pairs
        n = now


def _kept(spark: SparkSession, rows: DataFrame) -> tuple[DataFrame, int]:
    """Rows that later steps read without computing them again, and their number: in the shared folder if one is set, else cached."""
    rows = rows.checkpoint() if spark.conf.get("spark.checkpoint.dir", None) else rows.persist()
    return rows, rows.count()


def without_parent_repeats(links: DataFrame, closure: DataFrame, source: str, same: list[str]) -> DataFrame:
    """Links but for those of which a descendant of the source has one with equal `same` columns."""
    below = links.select(F.col(source).alias("unit"), *same).join(closure.select("unit", "ancestor"), "unit").select(F.col("ancestor").alias(source), *same).distinct()
    return links.join(below, [source, *same], "left_anti")
