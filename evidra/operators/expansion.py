"""Context of retrieved chunks: other parts, referenced articles and definitions, for batches of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidra.operators.terms import standing

DEFINITIONS_EACH, DEFINITIONS_ALL, REFERENCES_EACH = 2, 6, 2


def siblings(retrieved: DataFrame, chunks: DataFrame, history: bool = False) -> DataFrame:
    """The other parts of split articles and tables. retrieved: query_id, chunk_id, rank."""
    split = chunks.where(F.col("parent_key").isNotNull() & F.col("chunk_type").isin("article_part", "table")).select("chunk_id", "version_id", "parent_key")
    parts = chunks.where(F.lit(history) | (F.col("chunk_type") != "amendment_history")).select(F.col("chunk_id").alias("found"), "version_id", "parent_key", "part_index")
    return retrieved.join(split, "chunk_id").join(parts, ["version_id", "parent_key"]).select("query_id", F.col("chunk_id").alias("related_to"), "rank", F.col("found").alias("chunk_id"), F.lit("sibling_part").alias("relation"), F.lit(0).alias("kind"), F.col("part_index").cast("long").alias("place"))


def references(retrieved: DataFrame, chunks: DataFrame) -> DataFrame:
    """The first parts of the first internal articles that a chunk names; a reference to itself counts among them."""
    own = chunks.select("chunk_id", "version_id", F.col("article_number").alias("own"), F.array_distinct(F.transform(F.filter("cross_references", lambda r: ~r["external"] & r["article_number"].isNotNull()), lambda r: r["article_number"])).alias("refs"))
    named = retrieved.join(own, "chunk_id").select("*", F.posexplode(F.slice("refs", 1, REFERENCES_EACH)).alias("place", "article_number")).where(~F.col("own").eqNullSafe(F.col("article_number")))
    first = chunks.where(F.col("article_number").isNotNull() & (F.col("chunk_type") != "amendment_history")).groupBy("version_id", "article_number").agg(F.min(F.struct("part_index", "chunk_id"))["chunk_id"].alias("found"))
    return named.join(first, ["version_id", "article_number"]).select("query_id", F.col("chunk_id").alias("related_to"), "rank", F.col("found").alias("chunk_id"), F.lit("cross_reference").alias("relation"), F.lit(1).alias("kind"), F.col("place").cast("long").alias("place"))


def definitions(retrieved: DataFrame, chunks: DataFrame, whole: bool = False) -> DataFrame:
    """Definitions whose folded term stands in a chunk's folded text, longest terms first, a few for each chunk.

    A question's few chunks meet every term of their version. For whole corpora (whole) that would grow with the square of
    a version: there one pass over the texts looks all terms up, which are collected before.
    """
    terms = chunks.where(F.coalesce(F.trim("definition_term"), F.lit("")) != "").select("version_id", F.col("chunk_id").alias("found"), F.col("folded_term").alias("term"))
    own = chunks.where(F.col("chunk_type") != "definitions").select("chunk_id", "version_id", "folded_text")
    if whole:
        used = retrieved.join(standing(own, terms, DEFINITIONS_EACH), "chunk_id")
    else:
        used = retrieved.join(own, "chunk_id").join(terms, "version_id").where(F.contains("folded_text", "term")).withColumn("size", F.length("term"))
    place = F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy(F.desc("size"), "found"))
    near = used.withColumn("place", place.cast("long")).where(F.col("place") <= DEFINITIONS_EACH)
    return near.select("query_id", F.col("chunk_id").alias("related_to"), "rank", F.col("found").alias("chunk_id"), F.lit("definition").alias("relation"), F.lit(2).alias("kind"), "place")


def expand(retrieved: DataFrame, chunks: DataFrame, history: bool = False) -> DataFrame:
    """Added chunks in order: by the retrieved chunk's rank, then parts, references, definitions; none twice, none that
    is retrieved itself, and no more definitions in all than the limit."""
    every = siblings(retrieved, chunks, history).unionByName(references(retrieved, chunks)).unionByName(definitions(retrieved, chunks))
    fresh = every.join(retrieved.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    first = Window.partitionBy("query_id", "chunk_id").orderBy("rank", "kind", "place")
    once = fresh.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")
    order = Window.partitionBy("query_id").orderBy("rank", "kind", "place", "chunk_id")
    told = once.withColumn("defined", F.sum(F.when(F.col("relation") == "definition", 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    kept = told.where((F.col("relation") != "definition") | (F.col("defined") <= DEFINITIONS_ALL))
    return kept.withColumn("position", F.row_number().over(order).cast("long")).select("query_id", "position", "chunk_id", "relation", "related_to")
