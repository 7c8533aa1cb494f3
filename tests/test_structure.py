import random

from pyspark.sql import functions as F

from evidra.functions import legal
from evidra.operators import documents, structure, windows

PAGES = "array<struct<page:int,text:string>>"
TABLES = "array<struct<page:int,rows:array<array<string>>>>"


def document(spark, pages, language, tables=None, key="doc-1", sha="a" * 64, title="Law"):
    return spark.createDataFrame([(key, sha, title, language, pages, tables)], f"document_id string, sha256 string, title string, language string, pages {PAGES}, tables {TABLES}")


def segments(spark, text, language="ar"):
    row = structure.structured(document(spark, [(1, text)], language)).collect()[0]
    return [(s.kind, s.number, s.source, len(s.lines), len(s.history)) for s in row.segments], row.warnings


def marks(spark, lines):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, x string")
    return [r.m for r in df.select("k", legal.arabic_mark(F.col("x")).alias("m")).orderBy("k").collect()]


def lines(spec):
    return [(page, text) for text, page in spec]


def told(spark, column, value):
    """A Column over an array of lines, or of arrays of lines."""
    kind = structure.LINES if not value or not isinstance(value[0], list) else f"array<{structure.LINES}>"
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("x")).collect()[0].x


def test_arabic_articles(spark):
    got, warn = segments(spark, "مقدمة\nالمادة 1\nنص\nالمادة (٢)\nنص\nالمـادة 3 مكرر\nنص\nالمادة 5\nنص\nالمادة 50\nنص")
    assert got == [("preamble", None, None, 1, 0), ("article", "1", "parsed", 1, 0), ("article", "2", "parsed", 1, 0), ("article", "2 مكرر", "inferred", 1, 0), ("article", "5", "parsed", 1, 0), ("article", "6", "inferred", 1, 0)]
    assert len(warn) == 2 and "jumps from 2 to 5" in warn[0] and "inferred as 6" in warn[1]


def test_arabic_headings(spark):
    got = marks(spark, ["المادة 12 :", "المادة ٦٣ مكرر", "المادة ؟؟", "المادة باشراف اجهزة الوزارة", "المادة (5): يقدم الطلب", "المادة :)١١( أ- نص طويل", "المادة (٦) من هذا القانون", "الفصل الاول"])
    assert [(m.heading, m.read, m.bis, m.body, m.section) for m in got] == [
        (True, 12, False, None, None), (True, 63, True, None, None), (True, None, False, None, None), (False, None, False, "", None),
        (True, 5, False, "يقدم الطلب", None), (True, 11, False, "أ- نص طويل", None), (False, None, False, "", None), (False, None, False, None, "الفصل الاول"),
    ]


def test_cross_references(spark):
    df = spark.createDataFrame([("وفق المادة (35) والمادة 4 من قانون الزراعة و المادة 2 من هذا القانون",), ("none",)], "t string")
    got = [[tuple(x) for x in r.r] for r in df.select(legal.cross_references(F.col("t")).alias("r")).collect()]
    assert got == [[("المادة (35)", "35", False), ("المادة 4", "4", True), ("المادة 2 من هذا القانون", "2", False)], []]


def test_english(spark):
    got, _ = segments(spark, "Title\nANNEX A\nArticle 1 Scope\ntext\nArticle 2.1\nbody", "en")
    assert got == [("preamble", None, None, 1, 0), ("article", "1", "parsed", 2, 0), ("article", "2.1", "parsed", 1, 0)]
    got, _ = segments(spark, "Title\n1. First\n3. not next\n2. Second\nPART Two\n1. Again", "en")
    assert [g[:2] for g in got] == [("preamble", None), ("paragraph", "1"), ("paragraph", "2"), ("paragraph", "1")]
    got, warn = segments(spark, "only text", "en")
    assert got == [("text", None, None, 1, 0)] and len(warn) == 1


def test_history_definitions_title(spark):
    text = "المادة 1\nالانتاج النباتي :\nنص\n-هكذا اصبحت هذه المادة\nقديم"
    found = structure.structured(document(spark, [(1, text)], "ar")).collect()[0].segments
    assert (found[0].title, len(found[0].lines), len(found[0].history)) == ("الانتاج النباتي", 2, 2)


def test_clauses_and_packing(spark):
    cut = told(spark, lambda v: structure.cut_at(v, lambda x, i: legal.is_clause(x["text"])), lines([("intro", 1), ("1. one", 1), ("more", 1), ("أ- two", 2), ("(ii) three", 2)]))
    assert [tuple(x) for x in cut.lead] == [(1, "intro")] and [len(p) for p in cut.groups] == [2, 1, 1]
    limits = structure.Limits(max_tokens=10, overlap=3)
    words = lambda n, p=1: [(p, " ".join(["w"] * n))]
    size = lambda part: sum(len(x.text.split()) for x in part)
    parts = told(spark, lambda v: structure.packed(v, limits), [words(4), words(5), words(2), words(25), words(1), words(1)])
    assert [size(p) for p in parts] == [9, 2, 10, 10, 10, 4, 2]
    cut = told(spark, lambda v: structure.windowed(v, limits), words(6, 1) + words(8, 2))
    assert [[(len(x.text.split()), x.page) for x in w] for w in cut] == [[(6, 1), (4, 2)], [(7, 2)]]


def test_chunks(spark):
    body = "\n".join(f"{k}. " + "word " * 40 for k in range(1, 6))
    pages = [(1, f"Intro\nArticle 1 Duties\nlead in\n{body}"), (2, "Article 1\nsame number")]
    own = document(spark, pages, "en", [(3, [["h|1", "h2"], ["a", "b"], ["c"], ["d", "e\nf"]])])
    out = {r.key: r for r in structure.chunks(own, structure.Limits(100, 10, 2)).collect()}
    assert sorted(out) == ["art-1", "art-1.p1", "art-1.p2", "art-1.p3", "preamble", "table-1.p1", "table-1.p2"] and not out["art-1"].warnings
    assert out["art-1.p1"].chunk_id == "doc-1@aaaaaaaaaaaa#art-1.p1" and out["art-1.p2"].context_header.endswith("\nDuties\nlead in")
    assert out["table-1.p1"].text_original == "| h\\|1 | h2 |\n| --- | --- |\n| a | b |\n| c |  |" and out["table-1.p2"].text_original.endswith("| d | e f |")
    again = structure.chunks(document(spark, pages, "en")).collect()
    assert sorted(r.key for r in again) == ["art-1", "art-1~2", "preamble"] and all("disambiguated as art-1~2" in r.warnings[0] for r in again)


def test_chunks_of_terms_and_history(spark):
    text = "المادة 1\nيكون للكلمات والعبارات التالية المعاني المخصصة لها :\nالوزارة : وزارة الصناعة\nتابع\nالرخصة : رخصة\nالمادة 9\nنص\n-هكذا اصبحت هذه المادة\nقديم\nالمادة 3"
    out = {r.key: r for r in structure.chunks(document(spark, [(1, text)], "ar")).collect()}
    assert sorted(out) == ["art-1.def-1", "art-1.def-2", "art-2", "art-2.hist"]
    assert out["art-1.def-1"].definition_term == "الوزارة" and out["art-1.def-1"].text_original.endswith("الصناعة\nتابع") and out["art-1.def-2"].context_header.endswith("المخصصة لها :")
    assert out["art-2"].number_source == "inferred" and out["art-2"].caveats == [structure.INFERRED_CAVEAT]
    assert out["art-2.hist"].caveats == [structure.HISTORY_CAVEAT, structure.INFERRED_CAVEAT] and out["art-2.hist"].parent_key == "art-2"
    assert any(w == "art-3: heading without body text" for w in out["art-2"].warnings)


def test_chunking_stays_in_the_jvm(spark):
    plan = structure.chunks(document(spark, [(1, "Article 1\nbody")], "en"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_chunked_rows(spark):
    page = "array<struct<page:int,text:string>>"
    tables = "array<struct<page:int,rows:array<array<string>>>>"
    df = spark.createDataFrame([("d1", "a" * 64, "T", "en", [(1, "Article 1\nbody")], []), ("d2", "b" * 64, "T", "ar", None, None)], f"document_id string, sha256 string, title string, language string, pages {page}, tables {tables}")
    got = documents.chunked(df).collect()
    assert [(r["chunk_id"], r["article_number"], r["text_retrieval"]) for r in got] == [("d1@aaaaaaaaaaaa#art-1", "1", "t | article 1\nbody")]


def test_greedy_pack_like_the_fold(spark):
    rng = random.Random(1)
    cases = [[rng.randint(1, 500) for _ in range(rng.randint(0, 12))] for _ in range(50)]
    df = spark.createDataFrame(list(enumerate(cases)), "k long, s array<long>")
    got = {r["k"]: r["p"] for r in df.select("k", windows.greedy_pack(F.col("s"), 450).alias("p")).collect()}
    for k, sizes in enumerate(cases):
        part, held, want = 0, 0, []
        for s in sizes:
            if held and held + s > 450:
                part, held = part + 1, 0
            held += s
            want.append(part)
        assert got[k] == want
