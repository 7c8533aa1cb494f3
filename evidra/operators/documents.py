"""Documents to chunks, and the versioned tables they go to.

Tables are Parquet: sources, versions, chunks (partitioned by document_id) and embeddings (partitioned by model).
A snapshot of a table is computed as a whole from the one before and what has arrived.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.functions.text import clean_original, embedding_input, with_retrieval_text
from evidra.operators import structure

PIPELINE = "evidra-1"
REFERENCES = "array<struct<raw:string,article_number:string,external:boolean>>"
CHUNK = (
    "document_id string, sha256 string, chunk_id string, key string, chunk_type string, article_number string, number_source string, "
    "section_path array<string>, heading string, definition_term string, page_start int, page_end int, language string, "
    f"text_original string, context_header string, part_index int, part_count int, parent_key string, cross_references {REFERENCES}, "
    "caveats array<string>, content_sha256 string, token_count long"
)
COLUMNS = [c.strip().split(" ")[0] for c in CHUNK.replace(REFERENCES, "x").split(",")]


def from_files(files: DataFrame) -> DataFrame:
    """path, sha256, size and one page of text, of binary files of UTF-8 text."""
    text = clean_original(F.decode("content", "UTF-8"))
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), F.array(F.struct(F.lit(1).alias("page"), text.alias("text"))).alias("pages"))


def chunked(documents: DataFrame, limits: structure.Limits = structure.Limits()) -> DataFrame:
    """Chunks with the folded text, and ``warnings`` of their document.

    documents: document_id, sha256, title, language, pages (array of page, text) and tables (array of page, rows).
    """
    out = structure.chunks(documents.select("document_id", "sha256", "title", "language", "pages", "tables"), limits)
    out = out.withColumn("embedding_input", embedding_input(F.col("context_header"), F.col("text_original")))
    out = with_retrieval_text(out, "embedding_input", "text_retrieval")
    return out.withColumn("version_id", F.xxhash64("document_id", "sha256"))


def ingest(arrived: DataFrame, versions: DataFrame, made: DataFrame, pipeline: str = PIPELINE, force: bool = False) -> DataFrame:
    """The versions after arrivals, with ``status`` of those that arrived.

    arrived: document_id, sha256; versions: version_id, document_id, sha256, pipeline_version, is_active, failed; made: chunks of
    arrived documents (document_id, sha256). A version that is there with the same pipeline is skipped or reactivated, another
    pipeline reprocesses it, a new one is created; one without chunks fails and isn't activated. Exactly one
    version of a document with a version that hasn't failed stays active.
    """
    key = ["document_id", "sha256"]
    counts = made.groupBy(*key).agg(F.count(F.lit(1)).alias("chunks"))
    news = arrived.select(*key).distinct().join(counts, key, "left").withColumn("arrived", F.lit(True))
    both = versions.join(news, key, "full")
    known, same = F.col("version_id").isNotNull(), F.col("pipeline_version") == pipeline
    untouched = known & same & F.lit(not force)
    empty = F.coalesce(F.col("chunks"), F.lit(0)) == 0
    status = F.when(untouched & (F.col("is_active") | F.col("failed")), "skipped").when(untouched, "reactivated").when(empty, "failed").when(known, "reprocessed").otherwise("created")
    told = both.withColumn("status", F.when(F.col("arrived"), status))
    wins = F.col("status").isin("reactivated", "reprocessed", "created")
    # A document whose arrival wins gives up its other versions; a failed one only its own.
    winner = told.where(wins).groupBy("document_id").agg(F.max("sha256").alias("winner"))
    after = told.join(winner, "document_id", "left")
    active = F.when(F.col("winner").isNotNull(), F.col("sha256") == F.col("winner")).when(F.col("status") == "failed", False).otherwise(F.coalesce("is_active", F.lit(False)))
    redone = F.col("status").isin("created", "reprocessed", "failed")
    return after.select(
        F.coalesce("version_id", F.xxhash64(*key)).alias("version_id"), *key, F.when(redone, pipeline).otherwise(F.col("pipeline_version")).alias("pipeline_version"),
        active.alias("is_active"), F.when(F.col("arrived") & redone, F.col("status") == "failed").otherwise(F.coalesce("failed", F.lit(False))).alias("failed"), "status",
    )


def check_one_active(versions: DataFrame) -> None:
    """Raise if a document has more than one active version."""
    bad = versions.where("is_active").groupBy("document_id").count().where("count > 1").limit(5).collect()
    if bad:
        raise ValueError(f"more than one active version: {[r['document_id'] for r in bad]}")
