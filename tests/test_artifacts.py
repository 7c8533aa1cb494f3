import os

from evidra.sources.files import write_artifacts


def test_a_second_ingest_keeps_earlier_artifacts(spark, tmp_path):
    """Documents that the second call doesn't have, and earlier versions, stay; a version written again is replaced."""

    def write(*versions):
        docs = spark.createDataFrame([(d, sha, [(1, f"{d} {sha}")]) for d, sha in versions], "document_id string, sha256 string, pages array<struct<page: int, text: string>>")
        chunks = spark.createDataFrame([(d, sha, "text-1", None) for d, sha in versions], "document_id string, sha256 string, key string, warnings array<string>")
        write_artifacts(chunks, docs, str(tmp_path))

    write(("a", "1" * 64), ("b", "2" * 64))
    write(("a", "3" * 64), ("a", "1" * 64))
    for name in ("pages", "chunks", "manifest"):
        assert sorted(d for d in os.listdir(tmp_path / name) if d.startswith("document_id")) == ["document_id=a", "document_id=b"]
        assert len([d for d in os.listdir(tmp_path / name / "document_id=a") if d.startswith("sha12")]) == 2
        assert spark.read.json(str(tmp_path / name)).count() == 3
