"""The curated registry of documents, and evaluation cases: YAML lists with checked fields."""

from __future__ import annotations

import datetime as dt
import re

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# What fields may hold.
LANGUAGES = ["ar", "en", "mixed", "unknown"]
DOCUMENT_TYPES = ["law", "bylaw", "instructions", "technical_regulation", "standard", "decision", "circular", "agreement", "procedure_guide", "guidance", "tariff", "other"]
BINDING = ["binding", "guidance", "secondary", "unknown"]
STATUS = ["current", "superseded", "unknown"]
PROVENANCE = ["original", "official_translation", "verified_human_translation", "unverified_translation", "machine_translation"]
POLICY = ["auto", "text_layer", "ocr"]
REVIEW = ["draft", "reviewed"]
ID = re.compile(r"^[a-z0-9][a-z0-9\-]{2,120}$")

#: Field: (type, default or ... where it is required, values it may have or None).
FIELDS: dict[str, tuple] = {
    "id": (str, ..., None), "title_original": (str, ..., None), "title_en": (str, None, None), "issuing_authority": (str, ..., None), "jurisdiction": (str, "JO", None),
    "original_language": (str, ..., LANGUAGES), "translation_provenance": (str, "original", PROVENANCE), "official_url": (str, None, None), "discovered_via": (str, None, None),
    "document_type": (str, ..., DOCUMENT_TYPES), "binding_nature": (str, "unknown", BINDING), "legal_status": (str, "unknown", STATUS), "status_note": (str, None, None),
    "publication_date": (dt.date, None, None), "effective_date": (dt.date, None, None), "gazette_reference": (str, None, None), "amendment_info": (str, None, None),
    "usage_restrictions": (str, None, None), "provenance_note": (str, None, None), "product_categories": (list, [], None), "extraction_policy": (str, "auto", POLICY),
    "local_file": (str, ..., None), "retrieved_at": (dt.datetime, None, None),
}
_SPARK = {str: T.StringType(), dt.date: T.DateType(), dt.datetime: T.TimestampType(), list: T.ArrayType(T.StringType())}
SCHEMA = T.StructType([T.StructField(n, _SPARK[k]) for n, (k, _, _) in FIELDS.items()])


def _distinct(ids: list[str]) -> None:
    twice = sorted({i for i in ids if ids.count(i) > 1})
    if twice:
        raise ValueError(f"duplicate ids: {twice}")


def _entry(raw: dict) -> dict:
    if extra := sorted(set(raw) - set(FIELDS)):
        raise ValueError(f"{raw.get('id')}: unknown fields {extra}")
    out = {}
    for name, (kind, default, values) in FIELDS.items():
        v = raw.get(name, None if default is ... else default)
        if v is None and default is ...:
            raise ValueError(f"{raw.get('id')}: {name} is missing")
        if v is not None and values and v not in values:
            raise ValueError(f"{raw.get('id')}: {name} can't be {v!r}")
        if v is not None and not isinstance(v, kind):
            raise ValueError(f"{raw.get('id')}: {name} must be a {kind.__name__}")
        out[name] = v
    if not ID.match(out["id"]):
        raise ValueError(f"not an id: {out['id']!r}")
    if out["official_url"] is not None and not re.match(r"https?://\S+$", out["official_url"]):
        raise ValueError(f"{out['id']}: not an address: {out['official_url']!r}")
    return out


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """The registry as a table; it must be a list, its ids distinct, its fields known and valid."""
    with open(path, encoding="utf-8") as f:
        raw = yaml.safe_load(f)
    if not isinstance(raw, list):
        raise ValueError("a registry is a list")
    rows = [_entry(x) for x in raw]
    _distinct([r["id"] for r in rows])
    return spark.createDataFrame([tuple(r[n] for n in FIELDS) for r in rows], SCHEMA)


def load_cases(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Evaluation cases as three tables: cases, targets (case_id, document_id, article_number, grade) and tags."""
    with open(path, encoding="utf-8") as f:
        raw = yaml.safe_load(f)
    if extra := sorted(set(raw) - {"version", "description", "cases"}):
        raise ValueError(f"unknown fields {extra}")
    cases, targets, tags = [], [], []
    for c in raw["cases"]:
        if extra := sorted(set(c) - {"id", "query", "query_language", "relevant", "answerable", "tags", "review_status", "notes"}):
            raise ValueError(f"{c.get('id')}: unknown fields {extra}")
        relevant, answerable, status = c.get("relevant") or [], c.get("answerable", True), c.get("review_status", "draft")
        if c["query_language"] not in ("ar", "en"):
            raise ValueError(f"{c['id']}: query_language is ar or en")
        if answerable != bool(relevant):
            raise ValueError(f"{c['id']}: answerable cases have relevant targets, others have none")
        if status not in REVIEW:
            raise ValueError(f"{c['id']}: review_status can't be {status!r}")
        cases.append((c["id"], c["query"], c["query_language"], answerable, status, c.get("notes")))
        for t in relevant:
            grade = t.get("grade", 1)
            if not 1 <= grade <= 3 or set(t) - {"document_id", "article_number", "grade"}:
                raise ValueError(f"{c['id']}: not a target: {t}")
            targets.append((c["id"], t["document_id"], None if t.get("article_number") is None else str(t["article_number"]), grade))
        tags += [(c["id"], x) for x in c.get("tags") or []]
    _distinct([c[0] for c in cases])
    return {
        "cases": spark.createDataFrame(cases, "case_id string, query string, query_language string, answerable boolean, review_status string, notes string"),
        "targets": spark.createDataFrame(targets, "case_id string, document_id string, article_number string, grade int"),
        "tags": spark.createDataFrame(tags, "case_id string, tag string"),
    }
