"""Line dedup by site-relative frequency, in DataFrame functions only.

Pages are grouped by host. For each line of a host the share of the host's pages that hold it is counted; lines
whose share exceeds ``ratio`` are boilerplate of that host and go from all its pages. A line counts once a page,
compared without case and without blanks at its ends; blank lines stay and aren't counted. A line must also stand
on ``least`` pages, so that the lines of a host with few pages aren't boilerplate by themselves.

With ``copies_once`` the pages of a host with the same set of lines count as one page, in the lines' counts and in
the host's, so that copies of a page don't make its own lines boilerplate. Near copies with lines of their own are pages of
their own. The pipeline counts so; the query counts every row, as its SQL does.

What is counted is a pair of 64-bit hashes of each line rather than the line, pre-aggregated before the shuffle, so
a hot host or a hot line is spread over all tasks. A page of L lines can make at most L / ratio lines exceed
the ratio, hence a host's boilerplate is a short list: it is joined to the host's pages as an array, cut to what the page holds by
one hashed intersection, and the lines are filtered in place, without taking pages apart a second time. The list of all hosts is broadcast if it has
at most ``BROADCAST`` lines by count, else joined by a shuffle that adaptive execution splits where a host is hot.

Defined cases: a null text counts as empty and stays null; very long texts are read whole; a null host is a host of its own; repeated rows are
pages of their own; an empty table gives an empty table; columns of any names pass through, for a page's row is
kept as one column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.llm.shared import Scratch, text_or_empty

#: A line is boilerplate of its host above this share of the host's pages.
RATIO = 0.02
#: And on at least so many of them.
LEAST = 8
#: Boilerplate lines of all hosts together that may be broadcast (about 20 bytes each).
BROADCAST = 200_000


def host_of(url: Column) -> Column:
    """The host of a URL, in lower case, without user and port; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def _keys(text: Column) -> Column:
    """For each line of a text a struct of two hashes, or null for a blank line."""
    flat = F.regexp_replace(F.lower(text), r"[ \t\r]*\n[ \t\r]*", "\n")
    lines = F.split(F.trim(flat, F.lit(" \t\r")), "\n", -1)
    return F.transform(lines, lambda x: F.when(x != "", F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(7), x).alias("b"))))


def boilerplate(pages: DataFrame, host: Column, text: Column, ratio: float = RATIO, least: int = LEAST, copies_once: bool = False) -> DataFrame:
    """Host, line key, pages that hold the line and pages of the host, of the lines over the ratio."""
    own = pages.select(F.coalesce(host, F.lit("")).alias("__evidra_host"), host.isNull().alias("__evidra_none"), text.alias("__evidra_text"))
    by = ["__evidra_host", "__evidra_none"]
    keys = F.array_distinct(F.filter(_keys(F.col("__evidra_text")), lambda x: x.isNotNull()))
    if copies_once:
        # Partial sums leave one row of each set of lines in a task, so hot copies aren't shuffled.
        own = own.select(*by, F.sort_array(keys).alias("__evidra_keys")).distinct()
        keys = F.col("__evidra_keys")
    total = own.groupBy(*by).agg(F.count(F.lit(1)).alias("__evidra_pages"))
    lines = own.select(*by, F.explode(keys).alias("__evidra_key"))
    held = lines.groupBy(*by, "__evidra_key").agg(F.count(F.lit(1)).alias("__evidra_held")).where(F.col("__evidra_held") >= least)
    return held.join(total, by).where(F.col("__evidra_held") > ratio * F.col("__evidra_pages"))


def dedup(pages: DataFrame, host: Column, column: str = "text", ratio: float = RATIO, least: int = LEAST, copies_once: bool = False, counts: bool = True) -> DataFrame:
    """pages with the boilerplate lines of their host gone from the column, and the counts of lines and of dropped lines.

    The counts are in ``__evidra_lines`` and ``__evidra_dropped``, behind the columns of pages, unless they aren't asked for.
    """
    scratch = Scratch(pages.sparkSession, "lines")
    text = F.col(column).cast("string")
    found = scratch.keep(boilerplate(pages, host, F.coalesce(text, F.lit("")), ratio, least, copies_once), "boilerplate")
    # Lines were counted by 128 bits; within a host's list 64 tell them apart.
    by_host = found.groupBy("__evidra_host", "__evidra_none").agg(F.collect_set("__evidra_key.a").alias("__evidra_drop"))
    if found.count() <= BROADCAST:
        by_host = F.broadcast(by_host)
    row = F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("__evidra_row")
    own = pages.select(row, text.alias("__evidra_text"), F.coalesce(host, F.lit("")).alias("__evidra_host"), host.isNull().alias("__evidra_none"))
    joined = own.join(by_host, ["__evidra_host", "__evidra_none"], "left")
    text = F.col("__evidra_text")
    # A page whose host has no boilerplate keeps its text as it is.
    keys = F.transform(_keys(text), lambda k: k["a"])
    lines = joined.withColumn("__evidra_keys", F.when(F.col("__evidra_drop").isNotNull() & text.isNotNull(), keys))
    lines = lines.withColumn("__evidra_mine", F.array_intersect("__evidra_keys", "__evidra_drop"))
    pairs = F.arrays_zip(F.split(text, "\n", -1).alias("line"), F.col("__evidra_keys").alias("key"))
    kept = F.transform(F.filter(pairs, lambda x: x["key"].isNull() | ~F.array_contains(F.col("__evidra_mine"), x["key"])), lambda x: x["line"])
    lines = lines.withColumn("__evidra_kept", F.when(F.size("__evidra_mine") > 0, kept))
    n = F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1
    cleaned = F.when(F.col("__evidra_kept").isNull(), text).otherwise(F.array_join("__evidra_kept", "\n"))
    every = F.coalesce(n, F.lit(1)).cast("long")
    dropped = F.when(F.col("__evidra_kept").isNull(), F.lit(0)).otherwise(every - F.size("__evidra_kept")).cast("long")
    out = [cleaned.alias(c) if c == column else F.col("__evidra_row")[c].alias(c) for c in pages.columns]
    return lines.select(*out, *([every.alias("__evidra_lines"), dropped.alias("__evidra_dropped")] if counts else []))


def report(docs: DataFrame, ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """Per document: lines, dropped lines and the SHA-256 of the cleaned text; a document's host is its source."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), text_or_empty().cast("string").alias("text"))
    done = dedup(own, F.col("source"), "text", ratio, least)
    return done.select("doc_id", F.col("__evidra_lines").alias("n_lines"), F.col("__evidra_dropped").alias("n_dropped"), F.sha2("text", 256).alias("cleaned_sha256"))


ORACLE_SQL = f"""
WITH lines AS (
  SELECT doc_id, coalesce(source, '') AS host, source IS NULL AS none, pos,
         string_split(coalesce(text, ''), chr(10))[pos] AS line,
         trim(lower(string_split(coalesce(text, ''), chr(10))[pos]), ' ' || chr(9) || chr(13)) AS norm
  FROM documents, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS u(pos)
), total AS (
  SELECT coalesce(source, '') AS host, source IS NULL AS none, count(*) AS pages FROM documents GROUP BY ALL
), held AS (
  SELECT host, none, norm, count(DISTINCT doc_id) AS held FROM lines WHERE norm <> '' GROUP BY ALL
), boiler AS (
  SELECT host, none, norm FROM held JOIN total USING (host, none)
  WHERE held >= {LEAST} AND held > {RATIO} * pages
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(b.norm)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN b.norm IS NULL THEN line END, chr(10) ORDER BY pos), '')) AS cleaned_sha256
FROM lines LEFT JOIN boiler b USING (host, none, norm) GROUP BY doc_id
"""
