"""Citations and caveats of evidence, from stored metadata only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The caveats that evidence carries.
STATUS_UNKNOWN = "Legal status not verified: whether this text is current, and complete with all amendments, has not been confirmed against the Official Gazette or the issuing authority."
SUPERSEDED = "This document is recorded as superseded."
FONT_RECOVERY = "Text was recovered from the embedded fonts of a PDF whose text layer is corrupted, and verified against OCR. Confirm the exact wording against the source PDF before quoting it."
OCR = "Text was produced by OCR. Confirm the exact wording against the source PDF before quoting it."
MIXED = "Text on these pages comes from different extraction methods (text layer, font recovery or OCR). Confirm the exact wording against the source PDF before quoting it."
TRANSLATION = "This text is a translation that has not been verified as official."

CITATION = ["chunk_id", "document_id", "title_original", "issuing_authority", "document_type", "binding_nature", "legal_status", "version_id", "version_label", "content_sha256", "article_number", "section_path", "page_start", "page_end", "official_url", "retrieved_at", "extraction", "language", "translation_provenance"]


def pages_between(pages: Column, start: Column, end: Column) -> Column:
    """The pages (page_number, method, needs_review) of a chunk."""
    low = F.coalesce(start, F.lit(1))
    high = F.coalesce(end, start, F.lit(1))
    return F.filter(pages, lambda p: p["page_number"].between(low, high))


def one_or_mixed(values: Column, default: Column) -> Column:
    """The single value of an array, mixed if it has several, the default if it has none."""
    distinct = F.array_distinct(values)
    return F.when(F.size(distinct) == 0, default).when(F.size(distinct) == 1, distinct[0]).otherwise("mixed")


def caveats(own: Column, status: Column, binding: Column, method: Column, review: Column, provenance: Column) -> Column:
    """The caveats of an item in their order."""
    more = F.array(
        F.when(status == "unknown", STATUS_UNKNOWN).when(status == "superseded", SUPERSEDED),
        F.when(binding != "binding", F.concat(F.lit("Source binding nature is '"), binding, F.lit("', not a binding legal instrument."))),
        F.when(method == "font_recovery", FONT_RECOVERY).when(method == "ocr", OCR).when(method == "mixed", MIXED),
        F.when(F.size(review) > 0, F.concat(F.lit("Extraction of page(s) "), F.array_join(review.cast("array<string>"), ", "), F.lit(" is flagged for human review."))),
        F.when(provenance.isin("machine_translation", "unverified_translation"), TRANSLATION),
    )
    return F.concat(F.coalesce(own, F.array().cast("array<string>")), F.array_compact(more))


def assemble(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """items (query_id, position, chunk_id, ...) with their text, type, citation and caveats.

    chunks: active chunks with the columns of their version (page_methods, extraction_method) and source; only the few
    chunks of items are joined, so wide columns are read last.
    """
    own = pages_between(F.col("page_methods"), F.col("page_start"), F.col("page_end"))
    wide = chunks.join(F.broadcast(items.select("chunk_id").distinct()), "chunk_id", "left_semi").withColumn("pages_of", own)
    wide = wide.withColumn("extraction", one_or_mixed(F.transform("pages_of", lambda p: p["method"]), F.col("extraction_method")))
    review = F.transform(F.filter("pages_of", lambda p: p["needs_review"]), lambda p: p["page_number"])
    told = caveats(F.col("caveats"), F.col("legal_status"), F.col("binding_nature"), F.col("extraction"), review, F.col("translation_provenance"))
    wide = wide.select("chunk_id", "text_original", "chunk_type", F.struct(*CITATION).alias("citation"), told.alias("caveats"))
    return items.join(wide, "chunk_id")


def shared_caveats(caveat_lists: Column) -> Column:
    """Caveats that all items of a package have (an array of arrays)."""
    return F.aggregate(F.slice(caveat_lists, 2, F.size(caveat_lists)), caveat_lists[0], lambda a, b: F.array_intersect(a, b))
