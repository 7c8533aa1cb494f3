"""Documents as legal texts: chunked, embedded, searched with context, all in memory."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidra.functions.text import fold
from evidra.operators import documents, expansion
from evidra.operators.dense import hashing_embedder
from evidra.operators.search import Options, packages, search
from evidra.plans.retrieval import QUESTIONS, table

LAW = """قانون الاستيراد
المادة 1
يكون للكلمات والعبارات التالية المعاني المخصصة لها :
الوزارة : وزارة الصناعة
الرخصة : رخصة الاستيراد
المادة 2
يقدم طلب الرخصة الى الوزارة وفق المادة (3) من هذا القانون
المادة 3
1- تصدر الرخصة خلال عشرة ايام
2- ترفض الرخصة بقرار
-هكذا اصبحت هذه المادة بموجب القانون المعدل
المادة 3 مكرر
تسري احكام المادة 2"""
BYLAW = """CHAPTER One Licensing
Article 1 Definitions
For this bylaw the following definitions apply:
Permit : an import permit
Goods : any movable thing
Article 2
A permit is needed for goods under Article 1 of this Regulation.
Article 3
The fee of a permit follows Article 2."""
ASKED = {"q1": "المادة 3 من قانون الاستيراد", "q2": "permit for goods", "q3": "Article 3 of the Licensing Bylaw", "q4": "طلب الرخصة"}


def _corpus(spark, rows):
    docs = spark.createDataFrame(rows, "document_id string, title string, title_en string, language string, text string")
    docs = docs.withColumn("sha256", F.sha2("text", 256)).withColumn("pages", F.array(F.struct(F.lit(1).alias("page"), "text"))).withColumn("tables", F.array().cast("array<struct<page:int,rows:array<array<string>>>>"))
    # Two short texts, which every step of a search reads.
    chunks = documents.chunked(docs).persist()
    versions = docs.select(F.xxhash64("document_id", "sha256").alias("version_id"), F.concat(F.lit("sha256:"), F.substring("sha256", 1, 12)).alias("version_label"), F.lit("plain_text").alias("extraction_method"), F.lit(None).cast("array<struct<page_number:int,method:string,needs_review:boolean>>").alias("page_methods"), F.lit(True).alias("is_active"))
    kind = F.when(F.col("document_id") == "law", "law").otherwise("bylaw")
    sources = docs.select(F.col("document_id").alias("id"), F.col("title").alias("title_original"), "title_en", F.lit("Ministry").alias("issuing_authority"), kind.alias("document_type"), F.lit("binding").alias("binding_nature"), F.lit("unknown").alias("legal_status"), F.array(F.lit("goods")).alias("product_categories"), F.lit(None).cast("string").alias("official_url"), F.lit(None).cast("timestamp").alias("retrieved_at"), F.lit("original").alias("translation_provenance"))
    return chunks, versions, sources


def _laws(spark):
    return _corpus(spark, [("law", "قانون الاستيراد رقم 5", "Import Law No. 5", "ar", LAW), ("bylaw", "Licensing Bylaw 2004", None, "en", BYLAW)])


def law_chunks(spark, sf_dir):
    chunks, _, _ = _laws(spark)
    return chunks.select("chunk_id", "chunk_type", "article_number", "number_source", "definition_term", "part_index", "part_count", "parent_key", "language", "token_count", F.size("cross_references").cast("long").alias("references"), F.size("caveats").cast("long").alias("caveats"))


def law_search(spark, sf_dir):
    """Dense search with explicit references and context, as one package for each question."""
    chunks, versions, sources = _laws(spark)
    embed = hashing_embedder(64)
    vectors = chunks.select("chunk_id", embed(F.col("text_retrieval")).alias("embedding"))
    asked = spark.createDataFrame(list(ASKED.items()), "query_id string, query string")
    items = search(asked, chunks, versions, sources, vectors, embed, options=Options(top_k=3))
    return packages(asked, items).select("query_id", "query_language", F.transform("items", lambda i: F.concat_ws("|", i["chunk_id"], i["relation"])).alias("items"), "warnings").withColumn("items", F.array_join("items", ";")).withColumn("warnings", F.array_join("warnings", ";"))


def law_search_hybrid(spark, sf_dir):
    chunks, versions, sources = _laws(spark)
    embed = hashing_embedder(64)
    vectors = chunks.select("chunk_id", embed(F.col("text_retrieval")).alias("embedding"))
    asked = spark.createDataFrame(list(ASKED.items()), "query_id string, query string")
    return search(asked, chunks, versions, sources, vectors, embed, options=Options(mode="hybrid", top_k=3, context=False)).select("query_id", "position", "chunk_id", "relation", F.col("signal.fused_score").alias("fused_score"), F.col("signal.exact_reference").alias("exact_reference"))


def document_chunks(spark, sf_dir):
    """Every document cut into citable chunks; its language is one that is read as Arabic unless it is English."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("document_id"), F.sha2("text", 256).alias("sha256"), F.col("source").alias("title"), F.when(F.col("lang") == "en", "en").otherwise("unknown").alias("language"), F.array(F.struct(F.lit(1).alias("page"), "text")).alias("pages"), F.array().cast("array<struct<page:int,rows:array<array<string>>>>").alias("tables"))
    return documents.chunked(docs).select("chunk_id", "chunk_type", "language", "token_count", "content_sha256")


def hashing_embed(spark, sf_dir):
    """Every document's vector by hashed 3-grams, as a checksum of its rounded components."""
    docs = table(spark, sf_dir, "documents")
    v = docs.select("doc_id", hashing_embedder(64)(fold(F.col("text"))).alias("v"))
    return v.select("doc_id", F.size("v").alias("dimension"), F.md5(F.array_join(F.transform("v", lambda x: F.round(x.cast("double"), 4).cast("string")), ",")).alias("checksum"))


def _parts(spark, sf_dir):
    """Documents as chunks of a version (their source): parts of an article by language, references by length."""
    docs = table(spark, sf_dir, "documents")
    article = (F.col("n_chars") % 50).cast("string")
    refs = F.array(F.struct(F.lit("r").alias("raw"), ((F.col("n_chars") + 1) % 50).cast("string").alias("article_number"), (F.col("n_chars") % 7 == 0).alias("external")), F.struct(F.lit("r").alias("raw"), article.alias("article_number"), F.lit(False).alias("external")))
    return docs.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("version_id"), F.concat("lang", F.lit("-"), article).alias("parent_key"), F.when(F.col("n_chars") % 11 == 0, "amendment_history").otherwise("article_part").alias("chunk_type"), article.alias("article_number"), (F.col("doc_id") % 100).cast("int").alias("part_index"), refs.alias("cross_references"), F.lit(None).cast("string").alias("definition_term"), F.lit(None).cast("string").alias("folded_term"), F.lit("").alias("folded_text"))


def _every(parts):
    return parts.select(F.lit(1).cast("long").alias("query_id"), "chunk_id", F.col("chunk_id").alias("rank"))


def sibling_expand(spark, sf_dir):
    """All other parts of each document's article."""
    parts = _parts(spark, sf_dir)
    return expansion.siblings(_every(parts), parts).where("chunk_id <> related_to").select("related_to", "chunk_id", "place")


def crossref_expand(spark, sf_dir):
    """The first part of the articles that each document refers to."""
    parts = _parts(spark, sf_dir)
    return expansion.references(_every(parts), parts).select("related_to", "chunk_id", "place")


def definition_expand(spark, sf_dir):
    """Short documents as terms of their source: two longest that stand in each longer one."""
    docs = table(spark, sf_dir, "documents")
    term = F.when(F.col("n_chars") <= 40, F.regexp_replace(F.col("text"), "[.,]", ""))
    parts = docs.select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("version_id"), F.when(F.col("n_chars") > 40, "article").otherwise("definitions").alias("chunk_type"), term.alias("definition_term"), F.lower(term).alias("folded_term"), F.lower("text").alias("folded_text"))
    return expansion.definitions(_every(parts).distinct(), parts, whole=True).select("related_to", "chunk_id", "place")


QUERIES = {f.__name__: f for f in (law_chunks, law_search, law_search_hybrid, document_chunks, hashing_embed, sibling_expand, crossref_expand, definition_expand)}
_PARTS = """p AS (SELECT doc_id AS chunk_id, source AS version_id, lang || '-' || (n_chars % 50) AS parent_key, n_chars % 11 = 0 AS history, (n_chars % 50)::VARCHAR AS article, doc_id % 100 AS part, ((n_chars + 1) % 50)::VARCHAR AS ref, n_chars % 7 = 0 AS outside FROM documents)"""
ORACLE = {
    "sibling_expand": f"WITH {_PARTS} SELECT a.chunk_id AS related_to, b.chunk_id AS chunk_id, b.part::BIGINT AS place FROM p a JOIN p b USING (version_id, parent_key) WHERE NOT a.history AND NOT b.history AND a.chunk_id <> b.chunk_id",
    "crossref_expand": f"""WITH {_PARTS}, first AS (SELECT version_id, article, chunk_id AS found FROM p WHERE NOT history QUALIFY row_number() OVER (PARTITION BY version_id, article ORDER BY part, chunk_id) = 1)
SELECT p.chunk_id AS related_to, found AS chunk_id, 0::BIGINT AS place FROM p JOIN first ON first.version_id = p.version_id AND first.article = p.ref WHERE NOT outside""",
    "definition_expand": """WITH t AS (SELECT doc_id AS found, lang, lower(regexp_replace(text, '[.,]', '', 'g')) AS term, regexp_replace(text, '[.,]', '', 'g') AS shown FROM documents WHERE n_chars <= 40)
SELECT doc_id AS related_to, found AS chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY length(term) DESC, found) AS place FROM documents JOIN t USING (lang) WHERE n_chars > 40 AND trim(shown) <> '' AND contains(lower(text), term) QUALIFY place <= 2""",
    # Texts without headings: one chunk, or windows of 450 words that share 60.
    "document_chunks": r"""WITH l AS (SELECT doc_id, text, lang, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS x, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT *, unnest(CASE WHEN len(w) > 450 THEN range(0, len(w), 390) ELSE [0] END) AS i FROM l WHERE len(w) > 0),
c AS (SELECT doc_id, lang, text AS whole, CASE WHEN len(w) > 450 THEN array_to_string(list_slice(w, i + 1, i + 450), ' ') ELSE array_to_string(x, chr(10)) END AS text, least(len(w) - i, 450) AS tokens, i // 390 + 1 AS n FROM s WHERE i = 0 OR i - 390 + 450 < len(w)),
k AS (SELECT *, length(regexp_replace(text, '[^ء-يٱ-ۓ]', '', 'g')) AS a, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS b FROM c)
SELECT 'doc-' || doc_id || '@' || left(sha256(whole), 12) || '#text-' || n AS chunk_id, 'text' AS chunk_type, CASE WHEN a + b < 3 THEN CASE WHEN lang = 'en' THEN 'en' ELSE 'unknown' END WHEN a / (a + b) >= 0.8 THEN 'ar' WHEN b / (a + b) >= 0.8 THEN 'en' ELSE 'mixed' END AS language, tokens::BIGINT AS token_count, sha256(text) AS content_sha256 FROM k""",
}
