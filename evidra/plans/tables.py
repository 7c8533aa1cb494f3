"""Filters, joins, versions and aggregates on tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidra.operators import measures, versions
from evidra.operators.corpus import overview
from evidra.operators.filters import Filters
from evidra.plans.retrieval import table

KINDS = ["signup", "purchase", "error", "view", "click"]


def filter_isin_combo(spark, sf_dir):
    """The filters of a search, with documents for chunks: their language, and their source for a type."""
    docs = table(spark, sf_dir, "documents").where(F.trim("text") != "")
    chunks = docs.select(F.col("lang").alias("language"), F.col("source").alias("document_type"), F.lit("article").alias("chunk_type"), "n_chars")
    kept = chunks.where(Filters(languages=["en", "fr"], document_types=["src1", "src2", "src3"]).condition())
    return kept.groupBy(F.col("language").alias("lang"), F.col("document_type").alias("source")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


def filter_array_overlap(spark, sf_dir):
    """Documents with any of some categories, by the filters of a search."""
    categories = F.array(F.col("lang"), F.concat(F.lit("c"), F.length("source").cast("string")))
    own = table(spark, sf_dir, "documents").select("doc_id", categories.alias("product_categories"), F.lit("article").alias("chunk_type"))
    return own.where(Filters(product_categories=["fr", "c4"]).condition()).select("doc_id", F.array_join("product_categories", ",").alias("categories"))


def active_version(spark, sf_dir):
    """The latest event of each user, and how many there are."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return versions.active(events, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type", "n_versions")


def version_transition(spark, sf_dir):
    """Every event as an arrival of content (its type) for its user."""
    events = table(spark, sf_dir, "events")
    return versions.transitions(events, "user_id", "event_type", ["ts", "event_id"]).select("event_id", "user_id", "status")


def registry_upsert(spark, sf_dir):
    """Customers upserted from a copy in which a segment's balances and keys have changed."""
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    moved = F.when(F.col("c_mktsegment") == "MACHINERY", F.col("c_custkey") + 10_000_000).otherwise(F.col("c_custkey"))
    balance = F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))
    new = old.select(moved.alias("c_custkey"), "c_mktsegment", balance.alias("c_acctbal"))
    done = versions.upsert(old, new, "c_custkey")
    return done.groupBy("change", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


def stale_embeddings(spark, sf_dir):
    """Documents whose vector is missing, stale (its label isn't what the text's length asks for) or current."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    held = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    return versions.stale(docs, held, ["doc_id"], {"label": (F.col("n_chars") % 10).cast("int")}).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def source_overview(spark, sf_dir):
    """The overview of a corpus whose sources are suppliers; those in credit have an active version, whose chunks are their lines."""
    own = table(spark, sf_dir, "supplier")
    sources = own.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title_original"), F.col("s_nationkey").alias("legal_status"))
    held = own.select(F.col("s_suppkey").alias("document_id"), F.col("s_suppkey").alias("version_id"), F.concat(F.lit("v"), F.col("s_suppkey").cast("string")).alias("version_label"), (F.col("s_acctbal") > 5000).alias("is_active"))
    chunks = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("version_id"), F.col("l_orderkey").alias("chunk_id"))
    return overview(sources, held, chunks)


def corpus_stats(spark, sf_dir):
    """Words, and words of two letters or more, of each source."""
    words = F.filter(F.split("text", "\\s+", -1), lambda w: w != "")
    own = table(spark, sf_dir, "documents").select("source", F.size(words).alias("n"), F.size(F.filter(words, lambda w: F.length(w) >= 2)).alias("long"))
    return own.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("words"), F.sum("long").alias("words_2plus"))


def latency_summary(spark, sf_dir):
    """Median, least and most of a measure by kind."""
    events = table(spark, sf_dir, "events")
    return events.groupBy("event_type").agg(*measures.spread(F.col("value")))


def unknown_ids(spark, sf_dir):
    """Labelled documents that don't exist, and documents without a label, as differences of keys."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    gone = versions.unknown(labels, docs, "doc_id").withColumn("kind", F.lit("unknown"))
    return gone.unionByName(versions.unknown(docs, labels, "doc_id").withColumn("kind", F.lit("unlabelled")))


def weighted_confidence(spark, sf_dir):
    """Mean of a confidence weighted by words: quantity and price of lines of orders."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy("l_returnflag", "l_linestatus").agg(F.round(measures.weighted_mean(F.col("l_discount"), F.col("l_quantity")), 6).alias("weighted"), F.count(F.lit(1)).alias("n"))


def one_or_mixed(spark, sf_dir):
    """The single status of an order's lines, or mixed; and failed, partial or succeeded by the share of returns."""
    lines = table(spark, sf_dir, "lineitem")
    found = lines.groupBy("l_orderkey").agg(measures.one_or_mixed(F.col("l_linestatus")).alias("method"), measures.outcome(F.col("l_returnflag") == "R").alias("status"))
    return found.groupBy("method", "status").agg(F.count(F.lit(1)).alias("orders"))


def label_counts(spark, sf_dir):
    """Counts by status, and whether all have been reviewed."""
    labels = table(spark, sf_dir, "labels")
    return labels.groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("toxic") == 0).alias("all_clean"))


QUERIES = {f.__name__: f for f in (filter_isin_combo, filter_array_overlap, active_version, version_transition, registry_upsert, stale_embeddings, source_overview, corpus_stats, latency_summary, unknown_ids, weighted_confidence, one_or_mixed, label_counts)}
ORACLE = {
    "filter_isin_combo": "SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents WHERE lang IN ('en', 'fr') AND source IN ('src1', 'src2', 'src3') AND trim(text) <> '' GROUP BY ALL",
    "filter_array_overlap": "SELECT doc_id, lang || ',c' || length(source) AS categories FROM documents WHERE list_has_any([lang, 'c' || length(source)], ['fr', 'c4'])",
    "active_version": "SELECT user_id, event_id, event_type, count(*) OVER (PARTITION BY user_id) AS n_versions FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "version_transition": """SELECT event_id, user_id, CASE WHEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 THEN 'created'
 WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type THEN 'skipped' ELSE 'reactivated' END AS status FROM events""",
    "registry_upsert": """WITH new AS (SELECT CASE WHEN c_mktsegment = 'MACHINERY' THEN c_custkey + 10000000 ELSE c_custkey END AS k, c_mktsegment AS s, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 1 ELSE c_acctbal END AS b FROM customer)
SELECT CASE WHEN c_custkey IS NULL THEN 'created' WHEN k IS NULL THEN 'kept' WHEN b = c_acctbal AND s = c_mktsegment THEN 'unchanged' ELSE 'updated' END AS change,
 coalesce(s, c_mktsegment) AS c_mktsegment, count(*) AS n, round(sum(coalesce(b, c_acctbal)), 2) AS balance FROM customer FULL JOIN new ON k = c_custkey GROUP BY 1, 2""",
    "stale_embeddings": "SELECT CASE WHEN vec_id IS NULL THEN 'missing' WHEN label <> n_chars % 10 THEN 'stale' ELSE 'current' END AS state, count(*) AS n FROM documents LEFT JOIN embeddings ON vec_id = doc_id GROUP BY 1",
    "source_overview": """SELECT s_suppkey AS document_id, s_name AS title_original, s_nationkey AS legal_status, CASE WHEN s_acctbal > 5000 THEN 'v' || s_suppkey END AS version_label,
 CASE WHEN s_acctbal > 5000 THEN (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey) ELSE 0 END AS chunks FROM supplier""",
    "corpus_stats": r"""SELECT source, count(*) AS docs, sum(len(w))::BIGINT AS words, sum(len(list_filter(w, lambda x: length(x) >= 2)))::BIGINT AS words_2plus
FROM (SELECT source, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents) GROUP BY source""",
    "latency_summary": "SELECT event_type, round(median(value), 6) AS median, min(value) AS least, max(value) AS most, count(*) AS n FROM events GROUP BY 1",
    "unknown_ids": "SELECT DISTINCT doc_id, 'unknown' AS kind FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT doc_id, 'unlabelled' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "weighted_confidence": "SELECT l_returnflag, l_linestatus, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS weighted, count(*) AS n FROM lineitem GROUP BY ALL",
    "one_or_mixed": """WITH o AS (SELECT CASE WHEN count(DISTINCT l_linestatus) = 1 THEN min(l_linestatus) ELSE 'mixed' END AS method, CASE WHEN bool_and(l_returnflag = 'R') THEN 'failed' WHEN bool_or(l_returnflag = 'R') THEN 'partial' ELSE 'succeeded' END AS status FROM lineitem GROUP BY l_orderkey)
SELECT method, status, count(*) AS orders FROM o GROUP BY ALL""",
    "label_counts": "SELECT quality, count(*) AS n, bool_and(toxic = 0) AS all_clean FROM labels GROUP BY 1",
}
