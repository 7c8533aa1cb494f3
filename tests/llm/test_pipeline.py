import inspect

import corpus_pipeline
from evidra.llm import queries


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert list(inspect.signature(stage).parameters) == ["spark", "docs", "sf_dir"]
        docs = stage(spark, docs, sf).persist()
        assert docs.count() <= n
        n = docs.count()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    stepwise = sorted(map(tuple, docs.collect()))
    assert 0 < len(stepwise) and sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == stepwise


def test_one_query_for_each_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 11)) and set(queries.ORACLE) <= set(queries.QUERIES)


def test_a_hot_group_of_copies_keeps_one_text(spark):
    """Line dedup doesn't empty the copies, so that the join leaves one of them."""
    copy = "\n".join(f"a line {k} of the copied page with words of its own" for k in range(6))
    rows = [(i, "\n".join(f"page {i} has words {i + k} and line {k}" for k in range(6)), f"s{i % 2}") for i in range(200)] + [(1000 + i, copy, f"s{i % 2}") for i in range(100)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.near_duplicates(spark, corpus_pipeline.lines(spark, docs, ""), "")
    assert [(r["doc_id"], r["text"]) for r in left.where("doc_id >= 1000").collect()] == [(1000, copy)]


ODD = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, host string, component_id long, `__evidra_domain` string, tokens array<int>"


def odd(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), None, "h", 9, "d", [1]) for i, t, s in rows], ODD)


def test_stages_on_odd_rows(spark):
    """Null and empty texts, a null id and source, repeated rows, a very long text, and columns with the names of results."""
    words = " ".join(f"word{k}" for k in range(60_000))
    rows = [(None, None, "s0"), (1, "", "s0"), (2, "one two three four five six", "s1"), (2, "one two three four five six", "s1"), (3, words, None), (4, " \n\t", "s1"), (5, "short", "s0")]
    docs = odd(spark, rows)
    key = lambda r: (r["doc_id"] is not None, r["doc_id"], r["text"] or "")
    whole = lambda df: sorted(map(tuple, df.collect()), key=str)
    kept = corpus_pipeline.quality(spark, docs, "/root/testdata/sf0.001")
    assert kept.columns == docs.columns and not {r["doc_id"] for r in kept.collect()} & {None, 1, 2, 4, 5}
    lined = corpus_pipeline.lines(spark, docs, "")
    assert lined.columns == docs.columns and sorted((key(r) for r in lined.collect()), key=str) == sorted((key(r) for r in docs.collect()), key=str)
    single = corpus_pipeline.near_duplicates(spark, docs, "")
    assert single.columns == docs.columns and sorted(str(r["doc_id"]) for r in single.collect()) == ["1", "2", "3", "4", "5", "None"]
    assert {r["doc_id"]: r["text"] for r in single.collect()}[3] == words
    mixed = corpus_pipeline.mix(spark, docs, "")
    left = whole(docs)
    assert mixed.columns == docs.columns
    for r in whole(mixed):
        left.remove(r)
    told = corpus_pipeline.pieces(spark, docs, "").collect()
    assert len(told) == len(rows) and {r["n_tokens"] for r in told if r["doc_id"] in (None, 1)} == {1}
    assert [r["n_tokens"] for r in told if r["doc_id"] == 3][0] > 60_000


def test_stages_on_an_empty_table(spark):
    none = odd(spark, [])
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, none, "/root/testdata/sf0.001")
        assert out.count() == 0, name
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == none.columns, name
