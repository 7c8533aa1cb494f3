"""Ranking measures and the separation of scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ranking_measures(ranked: DataFrame, relevant: DataFrame, ks: list[int]) -> DataFrame:
    """Per question: mrr and, for each k, recall, precision and ndcg, rounded to 4 digits.

    ranked: query_id, unit, rank (1-based, units distinct); relevant: query_id, unit, grade. A question without relevant units
    isn't in the result.
    """
    gain = lambda g: F.pow(F.lit(2.0), g) - 1
    hits = ranked.join(relevant, ["query_id", "unit"]).select("query_id", "rank", "grade")
    ideal = relevant.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "unit")))
    sums = lambda name, rows, at: [F.sum(F.when(F.col(at) <= k, gain(F.col("grade")) / F.log2(F.col(at) + 1)).otherwise(0.0)).alias(f"{name}_{k}") for k in ks]
    best = ideal.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), *sums("ideal", ideal, "place"))
    got = hits.groupBy("query_id").agg(F.min("rank").alias("first"), *(F.sum(F.when(F.col("rank") <= k, 1).otherwise(0)).alias(f"hits_{k}") for k in ks), *sums("gain", hits, "rank"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    both = best.join(got, "query_id", "left")
    out = [F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 4).alias("mrr")]
    for k in ks:
        out += [F.round(zero(f"hits_{k}") / F.col("n"), 4).alias(f"recall_{k}"), F.round(zero(f"hits_{k}") / k, 4).alias(f"precision_{k}"), F.round(zero(f"gain_{k}") / F.col(f"ideal_{k}"), 4).alias(f"ndcg_{k}")]
    return both.select("query_id", *out)


def mean_by_group(per_case: DataFrame, groups: Column, measures: list[str]) -> DataFrame:
    """Means over all groups that a case counts in (an array): its direction, each of its tags, and all."""
    each = per_case.withColumn("group", F.explode(groups))
    return each.groupBy("group").agg(F.count(F.lit(1)).alias("cases"), *(F.round(F.avg(m), 4).alias(m) for m in measures))


def auroc(scores: DataFrame) -> DataFrame:
    """One row with the share of (positive, negative) pairs that the positive wins, ties a half. scores: score, positive.

    Pairs are never formed: equal scores are counted, coarse bins of the score are prefix-summed, and then the values
    within each bin.
    """
    counts = scores.where("score is not null").groupBy("score").agg(F.sum(F.when(F.col("positive"), 1).otherwise(0)).alias("p"), F.sum(F.when(F.col("positive"), 0).otherwise(1)).alias("n"))
    # A monotonic bin of any double: at most a few thousand bins.
    size = F.floor(F.log(F.abs("score") + 1) * 64)
    binned = counts.withColumn("bin", F.when(F.col("score") >= 0, size).otherwise(-size - 1))
    bins = binned.groupBy("bin").agg(F.sum("n").alias("n"))
    before = bins.select("bin", F.coalesce(F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = Window.partitionBy("bin").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    below = binned.join(F.broadcast(before), "bin").withColumn("below", F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    wins = F.sum(F.col("p") * (F.col("below") + F.col("n") * 0.5))
    return below.agg(F.sum("p").alias("positives"), F.sum("n").alias("negatives"), F.round(F.try_divide(wins, F.sum("p") * F.sum("n")), 4).alias("auroc"))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate: the mean of a value by weight, such as a page's confidence by its words; null without any weight."""
    total = F.sum(F.when(value.isNotNull(), weight))
    return F.when(total != 0, F.sum(value * weight) / total)


def one_or_mixed(value: Column) -> Column:
    """Aggregate: the value that all rows have, or ``mixed``, such as the extraction methods of a document's pages."""
    return F.when(F.min(value) == F.max(value), F.min(value)).otherwise(F.when(F.min(value).isNotNull(), "mixed"))


def outcome(failed: Column) -> Column:
    """Aggregate: failed where all rows have failed, partial where some have, succeeded where none has."""
    return F.when(F.bool_and(failed), "failed").when(F.bool_or(failed), "partial").otherwise("succeeded")


def spread(value: Column, digits: int = 6) -> list[Column]:
    """Aggregates: median, least, most and n of a measure, such as the latency of searches."""
    return [F.round(F.median(value), digits).alias("median"), F.min(value).alias("least"), F.max(value).alias("most"), F.count(F.lit(1)).alias("n")]
