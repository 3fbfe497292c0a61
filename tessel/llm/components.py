"""Connected components of a link table, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(spark: SparkSession, scratch: Scratch, links: DataFrame, name: str) -> DataFrame:
    """links(a long, b long) -> (node long, root long): root is the smallest node reachable.

    Nodes without links are not returned. Null ends and self-links are ignored. A step
    needs only each node's smallest neighbour, a sum that Spark takes before the
    shuffle, so a node with many neighbours is no hot key there; the join after it is
    one that AQE can split. Links stay on the executors; the driver sees two numbers a step.
    """
    edges = scratch.table(f"{name}-0", links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    step, before = 0, None
    while True:
        step += 1
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b"))).distinct()
        seen = Observation()  # counted while it is written
        new = scratch.table(f"{name}-{step}", small.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")))
        now = seen.get
        scratch.drop(f"{name}-{step - 1}")
        if now == before:
            return new.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(new.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        edges, before = new, now
