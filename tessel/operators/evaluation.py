"""Retrieval metrics over judgements and rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def metrics(judgements: DataFrame, rankings: DataFrame, cutoffs: Sequence[int], sample: str = "sample_id", item: str = "item_id", *, answered: DataFrame | None = None, partitions: int | None = None) -> DataFrame:
    """A row for each sample and cutoff: precision, recall, required_recall, mrr, ndcg.

    judgements(sample, item, grade int, required boolean); rankings(sample, item, rank), of which
    an item's best rank counts. Samples without a ranking have no row, and those without judgements neither;
    but samples of answered(sample) have one, as an empty ranking found nothing.
    precision divides by the number returned; required_recall is 1 where nothing is required.
    partitions: of how many tasks each step is, so that a task's share need not grow with the tables; else the session's setting.
    """
    if not cutoffs or min(cutoffs) < 1:
        raise ValueError("cutoffs must be positive")
    dealt = lambda rows, *keys: rows if partitions is None else rows.repartition(partitions, *keys)
    best = dealt(rankings, sample).groupBy(sample, item).agg(F.min("rank").alias("rank"))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy(sample).orderBy("rank", item))).where(F.col("rank") <= max(cutoffs))
    cuts = F.explode(F.array(*(F.lit(k) for k in sorted(set(cutoffs)))))
    # what is relevant, and the ideal order of its grades
    ideal = dealt(judgements, sample).withColumn("_i", F.row_number().over(Window.partitionBy(sample).orderBy(F.col("grade").desc(), item)))
    gain = lambda grade, place: (F.pow(F.lit(2.0), grade) - 1) / F.log2(place + 1.0)
    truth = ideal.select(sample, "grade", "required", "_i", cuts.alias("k")).groupBy(sample, "k").agg(
        F.count("*").alias("n_relevant"), F.count_if("required").alias("n_required"), F.sum(F.when(F.col("_i") <= F.col("k"), gain(F.col("grade"), F.col("_i"))).otherwise(0.0)).alias("ideal")
    )
    judged = dealt(dealt(best, sample, item).join(dealt(judgements.select(sample, item, "grade", "required"), sample, item), [sample, item], "left"), sample).select(sample, "rank", "grade", "required", cuts.alias("k")).where("rank <= k")
    got = judged.groupBy(sample, "k").agg(
        F.count("*").alias("n_returned"), F.count("grade").alias("hits"), F.count_if("required").alias("required_hits"), F.min(F.when(F.col("grade").isNotNull(), F.col("rank"))).alias("first"), F.sum(F.when(F.col("grade").isNotNull(), gain(F.col("grade"), F.col("rank"))).otherwise(0.0)).alias("dcg")
    )
    truth, got = dealt(truth, sample, "k"), dealt(got, sample, "k")
    r = lambda c: F.round(c, 6)
    if answered is None:
        scored = truth.join(got, [sample, "k"])
    else:
        counted = ("n_returned", "hits", "required_hits", "dcg")
        scored = truth.join(answered.select(sample).distinct(), sample, "left_semi").join(got, [sample, "k"], "left").na.fill(0, counted)
    return scored.select(
        sample,
        "k",
        r(F.col("hits") / F.greatest("n_returned", F.lit(1))).alias("precision"),
        r(F.col("hits") / F.col("n_relevant")).alias("recall"),
        r(F.when(F.col("n_required") == 0, 1.0).otherwise(F.col("required_hits") / F.col("n_required"))).alias("required_recall"),
        r(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"),
        r(F.when(F.col("ideal") == 0, 0.0).otherwise(F.col("dcg") / F.col("ideal"))).alias("ndcg"),
    )


def coverage(groups: Column, retrieved: Column) -> Column:
    """The share of groups (struct<ids, min_hits>) with enough retrieved ids; 1 without groups."""
    met = F.filter(groups, lambda g: F.size(F.array_intersect(g["ids"], retrieved)) >= g["min_hits"])
    return F.when(F.size(groups) == 0, 1.0).otherwise(F.size(met) / F.size(groups))


def means(scores: DataFrame, values: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Means over all samples and for each value of each grouping column, by one pass of grouping sets (A10)."""
    sets = [(), *((c,) for c in by)]
    grouped = scores.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(c) for c in by))
    return grouped.agg(F.count("*").alias("n"), *(F.round(F.avg(v), 6).alias(v) for v in values))


def unscored(samples: DataFrame, results: DataFrame, sample: str = "sample_id") -> DataFrame:
    """Samples that a score leaves out, and results without a sample, each with why: missing, failed or extra. results(sample, failed)."""
    both = samples.select(sample, F.lit(True).alias("_s")).join(results.select(sample, "failed"), sample, "full_outer")
    why = F.when(F.col("_s").isNull(), "extra").when(F.col("failed").isNull(), "missing").when(F.col("failed"), "failed")
    return both.select(sample, why.alias("why")).where("why is not null")
