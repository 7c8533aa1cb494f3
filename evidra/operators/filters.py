"""Metadata filters of a search."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Filters:
    """Empty lists don't filter. Amendment history is left out unless asked for."""

    document_ids: list[str] = field(default_factory=list)
    document_types: list[str] = field(default_factory=list)
    binding_natures: list[str] = field(default_factory=list)
    legal_statuses: list[str] = field(default_factory=list)
    languages: list[str] = field(default_factory=list)
    product_categories: list[str] = field(default_factory=list)
    include_history: bool = False

    def condition(self):
        """One Column that Catalyst can push to the scans of the joined tables."""
        told = F.lit(True)
        for column, wanted in (("document_id", self.document_ids), ("document_type", self.document_types), ("binding_nature", self.binding_natures), ("legal_status", self.legal_statuses), ("language", self.languages)):
            if wanted:
                told = told & F.col(column).isin(wanted)
        if self.product_categories:
            told = told & F.arrays_overlap("product_categories", F.array(*map(F.lit, self.product_categories)))
        if not self.include_history:
            told = told & (F.col("chunk_type") != "amendment_history")
        return told


def active_chunks(chunks: DataFrame, versions: DataFrame, sources: DataFrame) -> DataFrame:
    """Chunks of active versions with the columns of their version and source that searches need."""
    v = versions.where("is_active").select("version_id", "version_label", "extraction_method", "page_methods")
    s = sources.select(F.col("id").alias("document_id"), "title_original", "title_en", "issuing_authority", "document_type", "binding_nature", "legal_status", "product_categories", "official_url", "retrieved_at", "translation_provenance")
    return chunks.join(v, "version_id").join(s, "document_id")
