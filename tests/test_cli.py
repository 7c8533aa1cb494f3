import io
import json

import yaml

from evidra import cli
from evidra.operators.corpus import Corpus
from evidra.plans.evidence import BYLAW
from evidra.sources.registry import load_registry
from evidra.streaming.ingest import watch
from tests.test_corpus import ENTRIES


def test_stream_then_commands(spark, tmp_path):
    raw, root, registry = tmp_path / "raw", str(tmp_path / "store"), tmp_path / "r.yaml"
    raw.mkdir()
    (raw / "bylaw.txt").write_text(BYLAW, encoding="utf-8")
    registry.write_text(yaml.safe_dump([ENTRIES[1]]), encoding="utf-8")
    corpus = Corpus(spark, root, 64)
    watch(corpus, load_registry(spark, str(registry)), str(raw), str(tmp_path / "checkpoint")).awaitTermination(300)
    assert corpus.health() == {"active_versions": 1, "chunks": 4}

    def call(*argv):
        out = io.StringIO()
        assert cli.run(spark, ["--root", root, "--dimension", "64", *argv], out) == 0
        return out.getvalue()

    assert json.loads(call("ingest", str(registry), str(raw))) == {"document_id": "licensing-bylaw", "status": "skipped"}
    assert json.loads(call("embed")) == {"embedded": 4, "up_to_date": 0}
    assert "Licensing Bylaw 2004 | 3" in call("search", "Article 3 of the Licensing Bylaw", "--no-context")
    assert cli.run(spark, ["--root", root, "search", " "]) == 2
