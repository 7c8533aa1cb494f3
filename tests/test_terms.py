"""Definitions in every text of a corpus: the one pass against plain comparisons and the SQL."""

import random

import duckdb
import pytest

from evidra.operators import expansion, terms
from evidra.plans import evidence

SCHEMA = "chunk_id string, version_id long, chunk_type string, definition_term string, folded_term string, folded_text string"


def _rows(seed):
    r = random.Random(seed)
    word = lambda n: "".join(r.choice("abةé 日") for _ in range(r.randint(0, n)))
    texts = [(f"t{k}", r.choice([1, 2, 3, None]), "article", None, None, r.choice([word(400), word(8), "", None])) for k in range(300)]
    cut = lambda t: t[(a := r.randint(0, len(t))) : a + r.randint(0, 70)]
    own = [r.choice([cut(r.choice(texts)[5] or ""), word(6), word(70)]) for _ in range(150)]
    # Terms that fold to nothing, ones that are blank and don't count, equal ones of one version and of several.
    own += ["", " ", None, "ab", "ab", "ab"]
    return texts + [(f"d{k}", r.choice([1, 2, 4, None]), "definitions", w and w + ".", w, None) for k, w in enumerate(own)]


@pytest.mark.parametrize("parts", [1, 4])
@pytest.mark.parametrize("window", [5, 1 << 16])
def test_a_pass_finds_what_comparisons_find(spark, monkeypatch, parts, window):
    monkeypatch.setattr(terms, "WINDOW", window)
    monkeypatch.setattr(terms, "TERMS", 500_000 if parts == 1 else 20)
    chunks = spark.createDataFrame(_rows(parts), SCHEMA)
    asked = chunks.where("chunk_id <> 't7'").selectExpr("1L AS query_id", "chunk_id", "1L AS rank")
    asked = asked.unionByName(chunks.where("version_id = 1").selectExpr("2L AS query_id", "chunk_id", "2L AS rank"))
    got, want = (sorted(map(tuple, expansion.definitions(asked, chunks, whole).collect())) for whole in (True, False))
    assert got == want and len(got) > 50


def test_no_text_meets_every_term(spark):
    plan = evidence.definition_expand(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Contains" not in plan and "Join" in plan and "[version_id" not in "".join(x for x in plan.splitlines() if "Join" in x)


def test_repeated_ids_and_unknown_lengths_as_in_the_sql(spark, tmp_path):
    long = "x" * 41
    rows = [(1, f"Fee, {long}", "en", "s", 46), (1, f"duty {long}", "en", "s", 46), (2, "fee.", "en", "s", 4), (3, "duty", "en", "s", 4), (4, "fee", "en", "s", 3), (5, f"fee duty {long}", "de", "s", 50)]
    rows += [(6, f"fee {long}", "en", "s", None), (7, f"fee {long}", None, "s", 45), (8, None, "en", "s", None), (9, "...", "en", "s", 3), (2, "fee", "en", "s", 3), (10, f"a fee {long}", "en", "s", 47)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = evidence.definition_expand(spark, str(tmp_path)).select("related_to", "chunk_id", "place").collect()
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(c.sql(evidence.ORACLE["definition_expand"]).fetchall())
