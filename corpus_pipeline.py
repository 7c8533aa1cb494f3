"""A training-data pipeline of five stages over ``documents``.

Each stage takes the session, the documents that its predecessor kept and the folder of the tables, and
returns a DataFrame; all but the last return the columns of documents. ``run`` writes every stage's result as
Parquet in the shared folder and reads it back for the next one.

Defined cases, of every stage: null and empty texts have no words, so the quality rules reject them, and the later stages, called by
themselves, keep them (they have no line, link with nothing, have no token, and are one end id); very long texts are read whole;
repeated rows are judged one by one, and of rows that share a doc_id the join leaves one; a null doc_id never links; ties go to the
smaller doc_id; an empty table gives an empty table with the same columns; further columns pass through whatever their names, but
through the last stage, which returns its own. A table without labels has no quality model: the base rules alone decide.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.llm import line_dedup, mixing, ngram_join, quality_rules, sentencepiece_codec
from evidra.llm.shared import Scratch, unused

PIECE_MODEL = "piece_bpe_32k.model"
#: Share of the tokens that the mix may take.
BUDGET = 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.keep(docs, quality_rules.train(docs, labels))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source, where copies count once; n_chars follows the text."""
    cleaned = line_dedup.dedup(docs, F.col("source").cast("string"), copies_once=True, counts=False)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, similarity 0.8 or more."""
    return ngram_join.first_of_each(docs, 5, 80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix of domains, languages and sources takes, once at most."""
    domain = unused("__evidra_domain", docs.columns)
    placed = docs.withColumn(domain, mixing.domain_of(F.col("source").cast("string")))
    return mixing.mix(placed, mixing.production_plan(1, BUDGET, domain)).select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: count and digest of its piece ids, and the digest of the text they decode to."""
    return sentencepiece_codec.digests(docs, PIECE_MODEL)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", pieces),
]

#: The quality model and the tokenizer can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.split()[0])
    return docs
