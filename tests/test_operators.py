import math

import numpy as np
from pyspark.sql import functions as F

from evidra.operators import assessment, dense, evidence, expansion, fusion, measures, versions
from evidra.operators.lexical import bm25
from evidra.operators.search import resolve_instrument


def test_bm25_by_hand(spark):
    docs = {"a": ["x", "x", "y"], "b": ["x"], "c": ["z", "z"], "d": []}
    rows = [(i, t) for i, ts in docs.items() for t in (ts or [None])]
    corpus = spark.createDataFrame(rows, "id string, term string")
    asked = spark.createDataFrame([(1, "x"), (1, "x"), (1, "q"), (2, "y"), (2, "z")], "query_id long, term string")
    got = {(r["query_id"], r["id"]): (r["score"], r["rank"]) for r in bm25(corpus, asked).collect()}
    mean = 6 / 4

    def score(tf, length, df):
        return round(math.log(1 + (4 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)), 6)

    assert {k: v[0] for k, v in got.items()} == {(1, "a"): score(2, 3, 2), (1, "b"): score(1, 1, 2), (2, "c"): score(2, 2, 1), (2, "a"): score(1, 3, 1)}
    only = bm25(corpus, asked, allowed=spark.createDataFrame([("b",)], "id string")).collect()
    assert [(r["id"], r["score"]) for r in only] == [("b", score(1, 1, 2))]


def test_dense_ties_zero_and_dimensions(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("c", [0.0, 0.0]), ("d", [1.0, 0.0, 0.0]), ("e", [0.0, 1.0])], "id string, vector array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    assert [(r["id"], r["score"]) for r in dense.dense(v, q, 3).orderBy("rank").collect()] == [("a", 1.0), ("b", 1.0), ("e", 0.0)]


def test_hashing_embedder(spark):
    df = spark.createDataFrame([("import licence",), ("",), (None,)], "t string")
    rows = [r["v"] for r in df.select(dense.hashing_embedder(32)(F.col("t")).alias("v")).collect()]
    assert abs(np.linalg.norm(rows[0]) - 1) < 1e-6 and not any(rows[1]) and rows[2] is None
    assert np.allclose(rows[0], dense._hashed("import licence", 32, False), atol=1e-6)


def test_fusion(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id long, id string, rank long")
    b = spark.createDataFrame([(1, "y", 1), (1, "x", 2), (1, "z", 3)], "query_id long, id string, rank long")
    got = [(r["id"], round(r["score"], 9)) for r in fusion.fuse([a, b]).orderBy("rank").collect()]
    assert got == [("x", round(1 / 61 + 1 / 62, 9)), ("y", round(1 / 61 + 1 / 62, 9)), ("z", round(1 / 63, 9))]
    assert [r["id"] for r in fusion.fuse([a, b], weights=[1.0, 0.25]).orderBy("rank").collect()] == ["x", "y", "z"]


def test_imputed_ranks_and_equal_texts(spark):
    dense_ = spark.createDataFrame([(1, "ar1", 1), (1, "en1", 2), (1, "mix", 3), (1, "ar2", 4)], "query_id long, id string, rank long")
    lexical = spark.createDataFrame([(1, "en1", 1), (1, "ar2", 9)], "query_id long, id string, rank long")
    lang = spark.createDataFrame([("ar1", "ar"), ("en1", "en"), ("mix", "mixed"), ("ar2", "ar")], "id string, lang string")
    got = {r["id"]: (r["rank"], r["imputed"]) for r in fusion.impute_ranks(lexical, dense_, lang, F.lit("en")).collect()}
    assert got == {"ar1": (1, True), "en1": (1, False), "ar2": (9, False)}
    assert {r["id"] for r in fusion.impute_ranks(lexical, dense_, lang, F.lit("mixed")).collect()} == {"en1", "ar2"}
    same = dense_.withColumn("sha", F.when(F.col("id").startswith("ar"), "s").otherwise(F.col("id")))
    assert {r["id"] for r in fusion.first_of_equal(same, "sha").collect()} == {"ar1", "en1", "mix"}


def test_instrument_needs_a_unique_best_title(spark):
    rest = spark.createDataFrame([(1, ["law", "trade", "good"]), (2, ["permit", "good"]), (3, ["law", "import"]), (4, [])], "query_id long, tokens array<string>")
    titles = spark.createDataFrame([("a", ["law", "trade", "good"]), ("b", ["law", "trade"]), ("c", ["import", "law"]), ("d", ["law", "import"])], "document_id string, tokens array<string>")
    assert {r["query_id"]: r["document_id"] for r in resolve_instrument(rest, titles).collect()} == {1: "a"}


def test_measures(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3), ("r", "x", 1)], "query_id string, unit string, rank int")
    relevant = spark.createDataFrame([("q", "b", 3), ("q", "d", 1), ("r", "y", 1)], "query_id string, unit string, grade int")
    got = {r["query_id"]: r.asDict() for r in measures.ranking_measures(ranked, relevant, [2]).collect()}
    ideal = 7 / math.log2(2) + 1 / math.log2(3)
    assert got["q"] == {"query_id": "q", "mrr": 0.5, "recall_2": 0.5, "precision_2": 0.5, "ndcg_2": round(7 / math.log2(3) / ideal, 4)}
    assert got["r"] == {"query_id": "r", "mrr": 0.0, "recall_2": 0.0, "precision_2": 0.0, "ndcg_2": 0.0}


def test_auroc(spark):
    rows = [(0.9, True), (0.4, True), (0.9, False), (0.5, False), (None, True), (-3.0, False), (1e9, True)]
    got = measures.auroc(spark.createDataFrame(rows, "score double, positive boolean")).first()
    pos, neg = [0.9, 0.4, 1e9], [0.9, 0.5, -3.0]
    want = sum(1 if p > n else 0.5 if p == n else 0 for p in pos for n in neg) / 9
    assert got["auroc"] == round(want, 4) and (got["positives"], got["negatives"]) == (3, 3)


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 1)], "id long, x string, y long")
    new = spark.createDataFrame([(1, "a", None), (2, "b", 2), (4, "d", 1)], "id long, x string, y long")
    got = {r["id"]: (r["y"], r["change"]) for r in versions.upsert(old, new, "id").collect()}
    assert got == {1: (None, "unchanged"), 2: (2, "updated"), 3: (1, "kept"), 4: (1, "created")}


def test_stale(spark):
    chunks = spark.createDataFrame([(1, "h1"), (2, "h2"), (3, None)], "id long, h string")
    held = spark.createDataFrame([(1, "h1"), (2, "old"), (3, None)], "id long, sha string")
    assert {r["id"]: r["state"] for r in versions.stale(chunks, held, ["id"], {"sha": F.col("h")}).collect()} == {1: "current", 2: "stale", 3: "current"}


def test_expansion_limits(spark):
    refs = "array<struct<raw:string,article_number:string,external:boolean>>"
    schema = f"chunk_id string, version_id long, parent_key string, chunk_type string, article_number string, part_index int, cross_references {refs}, definition_term string, folded_term string, folded_text string"
    ref = lambda *ns: [("r", n, False) for n in ns]
    rows = [("p1", 1, "art-1", "article_part", "1", 0, ref("1", "2", "3"), None, None, "uses permit and goods and fee"), ("p2", 1, "art-1", "article_part", "1", 1, [], None, None, ""), ("h", 1, "art-1", "amendment_history", "1", 0, [], None, None, ""), ("a2", 1, None, "article", "2", 0, [("r", "3", True)], None, None, "permit"), ("a3", 1, None, "article", "3", 0, [], None, None, "")]
    rows += [(f"d{k}", 1, "art-9", "definitions", "9", k, [], w, w, w) for k, w in enumerate(["fee", "goods", "permit", " "])]
    chunks = spark.createDataFrame(rows, schema)
    got = expansion.expand(spark.createDataFrame([(7, "p1", 1), (7, "a2", 2)], "query_id long, chunk_id string, rank long"), chunks)
    assert [(r["chunk_id"], r["relation"], r["related_to"]) for r in got.orderBy("position").collect()] == [("p2", "sibling_part", "p1"), ("d2", "definition", "p1"), ("d1", "definition", "p1")]


def test_caveats(spark):
    none = "array<string>"
    df = spark.createDataFrame([(["own"], "unknown", "guidance", "mixed", [2, 3], "machine_translation"), (None, "current", "binding", "text_layer", [], "original")], f"c {none}, s string, b string, m string, r array<int>, p string")
    got = [r[0] for r in df.select(evidence.caveats(*(F.col(x) for x in "csbmrp"))).collect()]
    assert got[0] == ["own", evidence.STATUS_UNKNOWN, "Source binding nature is 'guidance', not a binding legal instrument.", evidence.MIXED, "Extraction of page(s) 2, 3 is flagged for human review.", evidence.TRANSLATION] and got[1] == []


def test_power(spark):
    df = spark.createDataFrame([("23",), ("24,5 ",), ("abc",), ("",), (None,), ("61",), ("-10",)], "t string")
    got = [r[0] for r in df.select(assessment.parse_power(F.col("t"))).collect()]
    assert [(r["ok"], r["value"], r["error"] is None) for r in got] == [(True, 23.0, True), (True, 24.5, True), (False, None, False), (False, None, True), (False, None, True), (False, None, False), (True, -10.0, True)]
