"""A batch of questions to evidence: candidates, fusion, explicit references, context, citations.

A question is a row (query_id, query), an answer its items; all questions of a batch are answered by one plan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidra.functions.references import INSTRUMENT_WORDS, article_reference
from evidra.functions.text import detect_language, fold, tokenize, with_retrieval_text
from evidra.operators import dense as vectors
from evidra.operators.evidence import assemble
from evidra.operators.expansion import expand
from evidra.operators.filters import Filters, active_chunks
from evidra.operators.fusion import first_of_equal, fuse, impute_ranks
from evidra.operators.lexical import bm25, terms, top


@dataclass
class Options:
    mode: str = "dense"
    top_k: int = 10
    dense_top_k: int = 40
    lexical_top_k: int = 40
    rrf_k: int = 60
    lexical_weight: float = 1.0
    references: bool = True
    context: bool = True
    filters: Filters = field(default_factory=Filters)

    def __post_init__(self):
        if self.mode not in ("dense", "hybrid", "lexical") or self.top_k < 1:
            raise ValueError("mode is dense, hybrid or lexical, and top_k at least 1")


def resolve_instrument(remainders: DataFrame, titles: DataFrame, least: int = 2) -> DataFrame:
    """query_id and document_id of the one title that shares most terms with a remainder.

    remainders: query_id, tokens; titles: document_id, tokens. A title counts only if a shared term is a word for a kind of
    instrument or begins with a digit; ties resolve nothing.
    """
    kinds = tokenize(fold(F.lit(INSTRUMENT_WORDS)))
    pairs = remainders.crossJoin(F.broadcast(titles.select("document_id", F.col("tokens").alias("title_tokens")).withColumn("kinds", kinds)))
    shared = pairs.withColumn("shared", F.array_intersect(F.array_distinct("tokens"), F.array_distinct("title_tokens")))
    named = F.exists("shared", lambda t: F.array_contains(F.col("kinds"), t) | t.rlike("^\\p{Nd}"))
    scored = shared.where(named & (F.size("shared") >= least)).select("query_id", "document_id", F.size("shared").alias("n"))
    best = Window.partitionBy("query_id")
    top_ = scored.withColumn("most", F.max("n").over(best)).where("n = most")
    return top_.groupBy("query_id").agg(F.min("document_id").alias("document_id"), F.count(F.lit(1)).alias("ties")).where("ties = 1").drop("ties")


def referenced(questions: DataFrame, chunks: DataFrame, sources: DataFrame, allowed: Column, document_ids: list[str]) -> DataFrame:
    """query_id, chunk_id and order of the chunks of articles that questions name with their instrument."""
    asked = questions.select("query_id", article_reference(F.col("query")).alias("r")).where("r is not null")
    rest = with_retrieval_text(asked.select("query_id", "r.article_number", "r.remainder"), "remainder", "folded").withColumn("tokens", tokenize(F.col("folded")))
    titles = sources.where(F.col("id").isin(document_ids)) if document_ids else sources
    titled = titles.select(F.col("id").alias("document_id"), F.concat_ws(" ", "title_original", F.coalesce("title_en", F.lit(""))).alias("title"))
    titled = with_retrieval_text(titled, "title", "folded").withColumn("tokens", tokenize(F.col("folded")))
    hit = resolve_instrument(rest, titled).join(rest.select("query_id", "article_number"), "query_id")
    own = chunks.where(allowed).select("document_id", "article_number", "chunk_id", "part_index")
    order = Window.partitionBy("query_id").orderBy("part_index", "chunk_id")
    return own.join(F.broadcast(hit), ["document_id", "article_number"]).withColumn("pinned", F.row_number().over(order).cast("long")).select("query_id", "chunk_id", "pinned")


def search(questions: DataFrame, chunks: DataFrame, versions: DataFrame, sources: DataFrame, embeddings: DataFrame | None = None, embed: Callable[[Column], Column] | None = None, rerank: Callable[[Column, Column], Column] | None = None, options: Options | None = None) -> DataFrame:
    """Items of each question in order.

    embeddings: chunk_id, embedding of one model; embed: a Column function of folded text that makes its vectors; rerank: a
    Column function of query and text, applied to the best three times top_k.
    """
    o = options or Options()
    active = active_chunks(chunks, versions, sources)
    allowed = o.filters.condition()
    asked = with_retrieval_text(questions.select("query_id", F.trim("query").alias("query")), "query", "folded").withColumn("query_language", detect_language(F.col("query")))
    there = active.where(allowed)
    dense = None
    if o.mode != "lexical" and embeddings is not None and embed is not None:
        own = embeddings.join(there.select("chunk_id"), "chunk_id", "left_semi").select(F.col("chunk_id").alias("id"), F.col("embedding").alias("vector"))
        dense = vectors.dense(own, asked.select("query_id", embed(F.col("folded")).alias("vector")), o.dense_top_k)
        # Forty rows a question, which fusion, signals and context all read.
        dense = dense.persist()
    fallback = o.mode == "dense" and (dense is None or dense.isEmpty())
    lexical = None
    if o.mode != "dense" or fallback:
        # Statistics come from all active chunks, history included; the filter only limits what is returned.
        docs = terms(active.select(F.col("chunk_id").alias("id"), "text_retrieval"), F.col("text_retrieval"), "id")
        lexical = bm25(docs, asked.select("query_id", F.explode(tokenize(F.col("folded"))).alias("term")), o.lexical_top_k, allowed=there.select(F.col("chunk_id").alias("id"))).persist()
    empty = asked.select("query_id", F.lit("").alias("id"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("rank")).limit(0)
    dense, lexical = (empty if x is None else x for x in (dense, lexical))
    ranks = lexical.select("query_id", "id", "rank", F.lit(False).alias("imputed"))
    if o.mode == "hybrid":
        far = dense.join(asked.select("query_id", "query_language"), "query_id")
        ranks = impute_ranks(lexical, far, active.select(F.col("chunk_id").alias("id"), F.col("language").alias("lang")), F.col("query_language"))
    fused = fuse([dense, ranks], o.rrf_k, [1.0, o.lexical_weight])
    fused = first_of_equal(fused.join(active.select(F.col("chunk_id").alias("id"), "content_sha256"), "id"), "content_sha256")
    signal = lambda df, name: df.select("query_id", "id", F.col("rank").alias(f"{name}_rank"), F.round("score", 6).alias(f"{name}_score"))
    found = fused.join(signal(dense, "dense"), ["query_id", "id"], "left").join(signal(lexical, "lexical"), ["query_id", "id"], "left").join(ranks.select("query_id", "id", F.col("imputed").alias("lexical_rank_imputed")), ["query_id", "id"], "left")
    found = found.select("query_id", F.col("id").alias("chunk_id"), F.col("rank").alias("place"), F.round("score", 6).alias("fused_score"), "dense_rank", "dense_score", "lexical_rank", "lexical_score", F.coalesce("lexical_rank_imputed", F.lit(False)).alias("lexical_rank_imputed"))
    found = found.withColumn("rerank_score", F.lit(None).cast("double"))
    if rerank is not None:
        pool = top(found.withColumnRenamed("chunk_id", "id"), 3 * o.top_k, F.asc("place")).withColumnRenamed("id", "chunk_id").drop("rank")
        texts = active.select("chunk_id", F.col("embedding_input").alias("text"))
        scored = pool.join(texts, "chunk_id").join(asked.select("query_id", "query"), "query_id").withColumn("rerank_score", F.round(rerank(F.col("query"), F.col("text")), 6)).drop("text", "query")
        found = scored.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "place")).cast("long"))
    exact = F.lit(None).cast("long")
    if o.references:
        named = referenced(asked, active, sources, allowed, o.filters.document_ids)
        found = found.join(named, ["query_id", "chunk_id"], "full")
        exact = F.col("pinned")
    ordered = Window.partitionBy("query_id").orderBy(F.col("pinned").asc_nulls_last(), "place", "chunk_id")
    found = found.withColumn("pinned", exact).withColumn("position", F.row_number().over(ordered).cast("long")).where(F.col("position") <= o.top_k)
    signals = [F.coalesce("fused_score", F.lit(0.0)).alias("fused_score"), "dense_rank", "dense_score", "lexical_rank", "lexical_score", F.coalesce("lexical_rank_imputed", F.lit(False)).alias("lexical_rank_imputed"), "rerank_score", F.col("pinned").isNotNull().alias("exact_reference")]
    items = found.select("query_id", "position", "chunk_id", F.lit("retrieved").alias("relation"), F.lit(None).cast("string").alias("related_to"), F.struct(*signals).alias("signal"))
    if o.context:
        items = items.persist()
        texts = active.withColumn("folded_term", fold(F.col("definition_term")))
        texts = with_retrieval_text(texts, "text_original", "folded_text")
        added = expand(items.select("query_id", "chunk_id", F.col("position").alias("rank")), texts, o.filters.include_history)
        added = added.withColumn("position", F.col("position") + o.top_k).withColumn("signal", F.lit(None).cast(items.schema["signal"].dataType))
        items = items.unionByName(added.select(items.columns))
    return assemble(items, active)


def packages(questions: DataFrame, items: DataFrame) -> DataFrame:
    """One row a question: its language, its items in order, and warnings."""
    own = F.struct("position", "chunk_id", "relation", "related_to", "signal", "text_original", "chunk_type", "citation", "caveats")
    grouped = items.groupBy("query_id").agg(F.sort_array(F.collect_list(own)).alias("items"))
    out = questions.join(grouped, "query_id", "left")
    none = F.when(F.col("items").isNull(), F.array(F.lit("no evidence found for this query and these filters"))).otherwise(F.array().cast("array<string>"))
    return out.select("query_id", "query", detect_language(F.col("query")).alias("query_language"), F.array("query").alias("query_variants"), F.coalesce("items", F.array().cast(items_type(items))).alias("items"), none.alias("warnings"))


def items_type(items: DataFrame) -> str:
    return items.select(F.array(F.struct("position", "chunk_id", "relation", "related_to", "signal", "text_original", "chunk_type", "citation", "caveats")).alias("x")).schema["x"].dataType.simpleString()
