"""Upserts and versions of documents as differences of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upsert(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """All rows after an upsert, with ``change``: created, updated, unchanged or kept (not in incoming; never deleted).

    A row counts as updated only if some column differs, null-safe.
    """
    columns = [c for c in current.columns if c != key]
    old = current.select(key, F.struct(*columns).alias("old"), F.lit(True).alias("in_old"))
    new = incoming.select(key, F.struct(*columns).alias("new"), F.lit(True).alias("in_new"))
    both = old.join(new, key, "full")
    change = F.when(F.col("in_old").isNull(), "created").when(F.col("in_new").isNull(), "kept").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("updated")
    return both.select(key, F.when(F.col("in_new"), F.col("new")).otherwise(F.col("old")).alias("row"), change.alias("change")).select(key, "row.*", "change")


def stale(chunks: DataFrame, embeddings: DataFrame, keys: list[str], wanted: dict[str, Column]) -> DataFrame:
    """chunks with ``state``: missing, stale (a stored column differs from what is wanted) or current."""
    held = embeddings.select(*keys, F.struct(*wanted).alias("__held"))
    differs = F.lit(False)
    for c, value in wanted.items():
        differs = differs | ~F.col(f"__held.{c}").eqNullSafe(value)
    state = F.when(F.col("__held").isNull(), "missing").when(differs, "stale").otherwise("current")
    return chunks.join(held, keys, "left").withColumn("state", state).drop("__held")


def active(versions: DataFrame, document: str, order: list[str]) -> DataFrame:
    """The latest version of each document and the count of its versions, by one aggregation."""
    latest = F.max(F.struct(*order, F.struct(*[c for c in versions.columns if c not in (document, *order)]).alias("rest")))
    return versions.groupBy(document).agg(latest.alias("latest"), F.count(F.lit(1)).alias("n_versions")).select(document, *(F.col(f"latest.{c}") for c in order), "latest.rest.*", "n_versions")


def transitions(arrivals: DataFrame, document: str, content: str, order: list[str]) -> DataFrame:
    """arrivals with ``status``: created (content new to the document), skipped (content is the active one) or reactivated."""
    by = Window.partitionBy(document).orderBy(*order)
    nth = F.row_number().over(Window.partitionBy(document, content).orderBy(*order))
    status = F.when(nth == 1, "created").when(F.lag(content).over(by) == F.col(content), "skipped").otherwise("reactivated")
    return arrivals.withColumn("status", status)


def unknown(asked: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """The distinct keys of asked that held doesn't have."""
    return asked.select(key).distinct().join(held.select(key), key, "left_anti")
