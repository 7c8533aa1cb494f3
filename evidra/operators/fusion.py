"""Rank fusion, cross-language ranks and removal of equal texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def fuse(rankings: list[DataFrame], k: int = 60, weights: list[float] | None = None) -> DataFrame:
    """query_id, id, score and rank from lists of (query_id, id, rank): the sum of weight / (k + rank).

    Ties go to the better single rank, then to the smaller id. The lists are added up in one aggregation.
    """
    parts = [r.select("query_id", "id", "rank", (F.lit(float(w)) / (k + F.col("rank"))).alias("part"), F.lit(i).alias("list")) for i, (r, w) in enumerate(zip(rankings, weights or [1.0] * len(rankings), strict=True))]
    every = reduce(DataFrame.unionByName, parts)
    # Added in the order of the lists, so that sums don't depend on the order of rows.
    total = F.aggregate(F.sort_array(F.collect_list(F.struct("list", "part"))), F.lit(0.0), lambda s, x: s + x["part"])
    fused = every.groupBy("query_id", "id").agg(total.alias("score"), F.min("rank").alias("best"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "best", "id")
    return fused.withColumn("rank", F.row_number().over(order).cast("long")).select("query_id", "id", "score", "rank")


def impute_ranks(lexical: DataFrame, dense: DataFrame, language: DataFrame, query_language: Column) -> DataFrame:
    """The lexical list with dense ranks in the place of ranks that another language makes impossible.

    lexical, dense: query_id, id, rank; language: id, lang. A dense hit in neither the question's language nor
    mixed takes its dense rank, unless it has a lexical one; ``imputed`` tells where that happened.
    """
    cross = dense.join(language, "id").where(query_language.isin("ar", "en") & (F.col("lang") != query_language) & (F.col("lang") != "mixed"))
    own = lexical.select("query_id", "id", F.col("rank").alias("own"))
    far = cross.select("query_id", "id", F.col("rank").alias("far"))
    both = own.join(far, ["query_id", "id"], "full")
    return both.select("query_id", "id", F.coalesce("own", "far").alias("rank"), F.col("own").isNull().alias("imputed"))


def first_of_equal(ranked: DataFrame, content: str) -> DataFrame:
    """Of each question's rows with equal content the best-ranked one."""
    first = Window.partitionBy("query_id", content).orderBy("rank", "id")
    return ranked.withColumn("__first", F.row_number().over(first)).where("__first = 1").drop("__first")
