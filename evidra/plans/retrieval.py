"""Retrieval queries: ``documents`` stand for chunks, ``embeddings`` for their vectors (vec_id is a doc_id)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions.text import STOPWORDS, fold, tokenize
from evidra.operators import dense as vectors
from evidra.operators import fusion
from evidra.operators.lexical import bm25, terms

QUESTIONS = {1: "the erea and thing of outhe", 2: "la de mente y ción", 3: "der und ung keit license version 2.0"}
DIM = 64
PROBES = {k: [round(math.sin(k * (i + 1)), 6) for i in range(DIM)] for k in (1, 2, 3)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def questions(spark: SparkSession) -> DataFrame:
    q = spark.createDataFrame(list(QUESTIONS.items()), "query_id long, query string")
    return q.select("query_id", F.explode(tokenize(fold(F.col("query")))).alias("term"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), fold(F.col("text")).alias("folded"))
    return terms(docs, F.col("folded"), "id")


def lexical_hits(spark: SparkSession, sf_dir: str, allowed=None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id")
    return bm25(corpus(spark, sf_dir), questions(spark), allowed=None if allowed is None else docs.where(allowed))


def probes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PROBES.items()), "query_id long, vector array<double>")


def dense_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return vectors.dense(own.join(docs, "id", "left_semi"), probes(spark))


def bm25_topk(spark, sf_dir):
    return lexical_hits(spark, sf_dir).select("query_id", F.col("id").alias("doc_id"), "score", "rank")


def bm25_topk_filtered(spark, sf_dir):
    """Statistics of all documents, hits of some."""
    return lexical_hits(spark, sf_dir, F.col("lang").isin("es", "de") & (F.col("source") != "src0")).select("query_id", F.col("id").alias("doc_id"), "score", "rank")


def _shown(df):
    return df.select("query_id", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


def dense_topk(spark, sf_dir):
    return _shown(dense_hits(spark, sf_dir).where("query_id = 1"))


def dense_topk_batch(spark, sf_dir):
    return _shown(dense_hits(spark, sf_dir))


def rrf_fusion(spark, sf_dir):
    return _shown(fusion.fuse([dense_hits(spark, sf_dir), lexical_hits(spark, sf_dir)]))


def rrf_weighted(spark, sf_dir):
    return _shown(fusion.fuse([dense_hits(spark, sf_dir), lexical_hits(spark, sf_dir)], weights=[1.0, 0.25]))


def crosslang_imputed_fusion(spark, sf_dir):
    """English questions: a dense hit in another language takes its dense rank for the lexical one it can't have."""
    dense, lexical = dense_hits(spark, sf_dir), lexical_hits(spark, sf_dir)
    lang = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    ranks = fusion.impute_ranks(lexical, dense, lang, F.lit("en"))
    fused = fusion.fuse([dense, ranks])
    told = fused.join(ranks.select("query_id", "id", "imputed"), ["query_id", "id"], "left")
    return told.select("query_id", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), "rank", F.coalesce("imputed", F.lit(False)).alias("imputed"))


def fused_deduped(spark, sf_dir):
    """Of fused hits with equal text the best-ranked one."""
    fused = fusion.fuse([dense_hits(spark, sf_dir), lexical_hits(spark, sf_dir)])
    sha = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("sha"))
    return fusion.first_of_equal(fused.join(sha, "id"), "sha").select("query_id", F.col("id").alias("doc_id"), "rank", "sha")


def dedupe_content_hash(spark, sf_dir):
    """Of all documents with equal text the first one, and their count, by one aggregation with partial sums."""
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


def lexical_fallback(spark, sf_dir):
    """A model without embeddings: the lexical hits of questions that dense retrieval has nothing for."""
    own = table(spark, sf_dir, "embeddings").where(F.size("embedding") == 8).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    dense = vectors.dense(own, probes(spark)).withColumn("retriever", F.lit("dense"))
    lexical = lexical_hits(spark, sf_dir).withColumn("retriever", F.lit("lexical"))
    rest = lexical.join(dense.select("query_id").distinct(), "query_id", "left_anti")
    return dense.unionByName(rest).select("query_id", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), "rank", "retriever")


def posting_stats(spark, sf_dir):
    """Per term of the corpus its documents, occurrences and idf: the inverted index's statistics."""
    n = table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"))
    tf = corpus(spark, sf_dir).where("term is not null").groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"))
    stats = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("occurrences"))
    return stats.crossJoin(F.broadcast(n)).select("term", "df", "occurrences", F.round(F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6).alias("idf"))


QUERIES = {f.__name__: f for f in (bm25_topk, bm25_topk_filtered, dense_topk, dense_topk_batch, rrf_fusion, rrf_weighted, crosslang_imputed_fusion, fused_deduped, dedupe_content_hash, lexical_fallback, posting_stats)}

_STOP = "(" + ", ".join(f"'{w}'" for w in STOPWORDS) + ")"


def _terms(name: str, source: str, key: str, text: str) -> str:
    """CTEs that make name(key, term) of a relation with text."""
    number = r"regexp_matches(raw, '^\p{Nd}')"
    return rf"""
{name}_raw AS (SELECT {key}, unnest(regexp_extract_all(lower({text}), '\p{{Nd}}+(?:\.\p{{Nd}}+)*|\p{{L}}+')) AS raw FROM {source}),
{name} AS (
  SELECT {key}, raw AS term FROM {name}_raw WHERE {number}
  UNION ALL SELECT {key}, split_part(raw, '.', 1) FROM {name}_raw WHERE {number} AND contains(raw, '.')
  UNION ALL SELECT {key}, term FROM (
    SELECT {key}, CASE WHEN length(raw) > 4 AND regexp_matches(raw, '[^s]s$') THEN left(raw, length(raw) - 1) ELSE raw END AS term
    FROM {name}_raw WHERE NOT {number} AND raw NOT IN {_STOP}) WHERE term NOT IN {_STOP}
)"""


_QUESTIONS = "asked(query_id, query) AS (VALUES " + ", ".join(f"({k}::BIGINT, '{v}')" for k, v in QUESTIONS.items()) + ")"
_PROBES = "probe(query_id, v) AS (VALUES " + ", ".join(f"({k}::BIGINT, {v}::DOUBLE[])" for k, v in PROBES.items()) + ")"


def _lexical(where: str = "TRUE") -> str:
    return f"""{_QUESTIONS}, {_terms("term", "documents", "doc_id", "text")}, {_terms("query_term", "asked", "query_id", "query")},
sized AS (SELECT doc_id, count(term) AS length FROM (SELECT doc_id FROM documents) LEFT JOIN term USING (doc_id) GROUP BY doc_id),
corpus AS (SELECT count(*) AS n, avg(length) AS mean FROM sized),
tf AS (SELECT doc_id, term, count(*) AS tf FROM term GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
lexical_all AS (
  SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score
  FROM (SELECT DISTINCT query_id, term FROM query_term) JOIN tf USING (term) JOIN df USING (term) JOIN sized USING (doc_id) JOIN documents USING (doc_id), corpus
  WHERE {where} GROUP BY ALL),
lexical AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM lexical_all QUALIFY rank <= 40)"""


_DENSE = f"""{_PROBES},
dense_all AS (SELECT query_id, vec_id AS doc_id, list_cosine_similarity(embedding::DOUBLE[], v) AS score FROM embeddings, probe WHERE vec_id IN (SELECT doc_id FROM documents)),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM dense_all QUALIFY rank <= 40)"""


def _fused(lists: list[tuple[str, float]]) -> str:
    parts = " UNION ALL ".join(f"SELECT query_id, doc_id, rank, {w} / (60 + rank) AS part FROM {t}" for t, w in lists)
    return f"""part AS ({parts}),
summed AS (SELECT query_id, doc_id, sum(part) AS score, min(rank) AS best FROM part GROUP BY ALL),
fused AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, best, doc_id) AS rank FROM summed)"""


_SHOW = "SELECT query_id, doc_id, round(score, 6) AS score, rank"
ORACLE = {
    "bm25_topk": f"WITH {_lexical()} SELECT * FROM lexical",
    "bm25_topk_filtered": f"WITH {_lexical("lang IN ('es', 'de') AND source <> 'src0'")} SELECT * FROM lexical",
    "dense_topk": f"WITH {_DENSE} {_SHOW} FROM dense WHERE query_id = 1",
    "dense_topk_batch": f"WITH {_DENSE} {_SHOW} FROM dense",
    "rrf_fusion": f"WITH {_lexical()}, {_DENSE}, {_fused([('dense', 1.0), ('lexical', 1.0)])} {_SHOW} FROM fused",
    "rrf_weighted": f"WITH {_lexical()}, {_DENSE}, {_fused([('dense', 1.0), ('lexical', 0.25)])} {_SHOW} FROM fused",
    "crosslang_imputed_fusion": f"""WITH {_lexical()}, {_DENSE},
far AS (SELECT query_id, doc_id, rank FROM dense JOIN documents USING (doc_id) WHERE lang NOT IN ('en', 'mixed')),
ranks AS (SELECT coalesce(l.query_id, f.query_id) AS query_id, coalesce(l.doc_id, f.doc_id) AS doc_id, coalesce(l.rank, f.rank) AS rank, l.rank IS NULL AS imputed
  FROM lexical l FULL JOIN far f ON l.query_id = f.query_id AND l.doc_id = f.doc_id),
{_fused([('dense', 1.0), ('ranks', 1.0)])}
SELECT query_id, doc_id, round(score, 6) AS score, fused.rank AS rank, coalesce(imputed, FALSE) AS imputed FROM fused LEFT JOIN ranks USING (query_id, doc_id)""",
    "fused_deduped": f"""WITH {_lexical()}, {_DENSE}, {_fused([('dense', 1.0), ('lexical', 1.0)])}
SELECT query_id, doc_id, rank, sha256(text) AS sha FROM fused JOIN documents USING (doc_id) QUALIFY row_number() OVER (PARTITION BY query_id, sha256(text) ORDER BY rank) = 1""",
    "dedupe_content_hash": "SELECT sha256(text) AS sha, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
    "lexical_fallback": f"WITH {_lexical()} SELECT query_id, doc_id, score, rank, 'lexical' AS retriever FROM lexical",
    "posting_stats": f"""WITH {_terms("term", "documents", "doc_id", "text")}, tf AS (SELECT term, doc_id, count(*) AS tf FROM term GROUP BY ALL)
SELECT term, count(*) AS df, sum(tf)::BIGINT AS occurrences, round(ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM tf GROUP BY term""",
}
