"""Word windows, carried headings and packed units, without a loop over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def overlapping(items: Column, size: int, overlap: int) -> Column:
    """Array of windows of an array, each a step after the one before; the last one reaches the end."""
    step = max(1, size - overlap)

    def cut(own: Column) -> Column:
        n = F.size(own)
        starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step)), lambda i: (n > 0) & ((i == 0) | (i - step + size < n)))
        return F.transform(starts, lambda i: F.slice(own, i + 1, F.lit(size)))

    # Bound as a variable of a lambda function, the items are made once rather than once for each window.
    return F.transform(F.array(items), cut)[0]


def word_windows(text: Column, size: int, overlap: int) -> Column:
    """Array of (index, words) of overlapping windows of a text's words."""
    words = F.filter(F.split(text, "\\s+", -1), lambda w: w != "")
    return F.transform(overlapping(words, size, overlap), lambda w, k: F.struct(k.cast("long").alias("index"), w.alias("words")))


def carry(df: DataFrame, key: str, order: list[str], value: Column, out: str) -> DataFrame:
    """df with the last non-null value up to each row, in order, of its key."""
    return df.withColumn(out, F.last(value, ignorenulls=True).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def numbered_groups(df: DataFrame, key: str, order: list[str], opens: Column, out: str) -> DataFrame:
    """df with the number of the group that each row is in: a row that opens begins one; rows before the first are in 0."""
    return df.withColumn(out, F.sum(F.when(opens, 1).otherwise(0)).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)).cast("long"))


def greedy_pack(sizes: Column, limit: int) -> Column:
    """For an array of unit sizes the number of the part that each unit goes to: parts hold limit at most, or one unit."""
    start = F.struct(F.array().cast("array<long>").alias("parts"), F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("held"))

    def put(state: Column, size: Column) -> Column:
        fresh = (state["held"] > 0) & (state["held"] + size > limit)
        part = F.when(fresh, state["part"] + 1).otherwise(state["part"])
        return F.struct(F.concat(state["parts"], F.array(part)).alias("parts"), part.alias("part"), F.when(fresh, size).otherwise(state["held"] + size).alias("held"))

    return F.aggregate(F.transform(sizes, lambda s: s.cast("long")), start, put, lambda s: s["parts"])
