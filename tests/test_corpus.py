import pytest
import yaml
from pyspark.sql import functions as F

from evidra.operators.corpus import Corpus, format_report
from evidra.operators.filters import Filters
from evidra.operators.search import Options
from evidra.plans.evidence import BYLAW, LAW
from evidra.sources.registry import load_cases, load_registry

ENTRIES = [
    {"id": "import-law", "title_original": "قانون الاستيراد رقم 5", "title_en": "Import Law No. 5", "issuing_authority": "M", "original_language": "ar", "document_type": "law", "binding_nature": "binding", "legal_status": "current", "local_file": "law.txt", "product_categories": ["goods"]},
    {"id": "licensing-bylaw", "title_original": "Licensing Bylaw 2004", "issuing_authority": "M", "original_language": "en", "document_type": "bylaw", "local_file": "bylaw.txt"},
    {"id": "absent-law", "title_original": "Absent", "issuing_authority": "M", "original_language": "en", "document_type": "law", "local_file": "absent.txt"},
]


def registry(spark, path, entries=ENTRIES):
    path.write_text(yaml.safe_dump(entries, allow_unicode=True), encoding="utf-8")
    return load_registry(spark, str(path))


def test_path(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "law.txt").write_text(LAW, encoding="utf-8")
    (raw / "bylaw.txt").write_text(BYLAW, encoding="utf-8")
    table = registry(spark, tmp_path / "r.yaml")
    c = Corpus(spark, str(tmp_path / "store"), 64)
    status = lambda: {r["document_id"]: r["status"] for r in c.ingest(table, str(raw)).collect()}
    assert status() == {"import-law": "created", "licensing-bylaw": "created", "absent-law": "missing_file"}
    assert c.health() == {"active_versions": 2, "chunks": 11}
    assert status() == {"import-law": "skipped", "licensing-bylaw": "skipped", "absent-law": "missing_file"}
    (raw / "bylaw.txt").write_text(BYLAW + "\nArticle 4\nnew", encoding="utf-8")
    assert status()["licensing-bylaw"] == "created" and c.health() == {"active_versions": 2, "chunks": 12}
    (raw / "bylaw.txt").write_text(BYLAW, encoding="utf-8")
    assert status()["licensing-bylaw"] == "reactivated" and c.health()["chunks"] == 11
    (raw / "bylaw.txt").write_text(" \n", encoding="utf-8")
    assert status()["licensing-bylaw"] == "failed" and c.health()["chunks"] == 11
    assert c.update_embeddings() == {"embedded": 11, "up_to_date": 0}
    assert c.update_embeddings() == {"embedded": 0, "up_to_date": 11}
    assert {r["document_id"]: r["chunks"] for r in c.overview().collect()} == {"import-law": 7, "licensing-bylaw": 4, "absent-law": 0}
    asked = spark.createDataFrame([("q", "Article 3 of the Licensing Bylaw")], "query_id string, query string")
    items = c.search(asked, Options(top_k=2)).orderBy("position").collect()
    assert items[0]["signal"]["exact_reference"] and items[0]["citation"]["article_number"] == "3" and len([i for i in items if i["relation"] == "retrieved"]) == 2
    assert c.search(asked, Options(filters=Filters(document_types=["tariff"]))).count() == 0
    cases = {"cases": [
        {"id": "c1", "query": "Article 3 of the Licensing Bylaw", "query_language": "en", "relevant": [{"document_id": "licensing-bylaw", "article_number": "3", "grade": 2}], "tags": ["identifier"]},
        {"id": "c2", "query": "quantum gardening", "query_language": "en", "answerable": False},
    ]}
    (tmp_path / "c.yaml").write_text(yaml.safe_dump(cases))
    report = c.evaluate(load_cases(spark, str(tmp_path / "c.yaml")), [1, 3])
    assert report["summary"]["all"]["mrr"] == 1.0 and list(report["summary"]) == ["en->en", "tag:identifier", "all"] and not report["validated"]
    assert "DRAFT" in format_report(report)


def test_registry_is_checked(spark, tmp_path):
    for change, message in (({"id": "X"}, "not an id"), ({"document_type": "poem"}, "can't be"), ({"colour": "red"}, "unknown fields"), ({"issuing_authority": None}, "missing"), ({"official_url": "ftp://x"}, "address")):
        with pytest.raises(ValueError, match=message):
            registry(spark, tmp_path / "r.yaml", [{**ENTRIES[0], **change}])
    with pytest.raises(ValueError, match="duplicate"):
        registry(spark, tmp_path / "r.yaml", [ENTRIES[0], ENTRIES[0]])
    table = registry(spark, tmp_path / "r.yaml")
    assert table.where(F.col("legal_status") == "unknown").count() == 2 and table.first()["jurisdiction"] == "JO"


def test_cases_are_checked(spark, tmp_path):
    base = {"id": "c", "query": "q", "query_language": "en", "relevant": [{"document_id": "d"}]}
    for change in ({"query_language": "fr"}, {"answerable": False}, {"relevant": []}, {"relevant": [{"document_id": "d", "grade": 4}]}, {"x": 1}):
        (tmp_path / "c.yaml").write_text(yaml.safe_dump({"cases": [{**base, **change}]}))
        with pytest.raises(ValueError):
            load_cases(spark, str(tmp_path / "c.yaml"))
