from collections import Counter, defaultdict

from pyspark.sql import functions as F

from evidra.llm import line_dedup


def test_against_brute_force(spark):
    lines = ["Menu", " menu\t", "About us", "x", ""]
    rows = []
    for i in range(60):
        own = [lines[0] if i % 2 else lines[1], f"text {i}", lines[2] if i % 30 == 0 else "", f"more {i}"]
        rows.append((i, "\n".join(own), "a" if i < 40 else "b" if i < 58 else None))
    rows += [(100, None, "a"), (101, "", "a"), (0, rows[0][1], "a"), (102, "Menu\n" * 3 + "tail", "b")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, __evidra_key int")
    ratio, least = 0.2, 3
    pages, held = Counter(), defaultdict(int)
    key = lambda s: s.strip(" \t\r").lower()
    for _, t, h in rows:
        pages[h] += 1
        for k in {key(x) for x in (t or "").split("\n")} - {""}:
            held[h, k] += 1
    drop = {hk for hk, n in held.items() if n >= least and n > ratio * pages[hk[0]]}
    want = sorted((i, None if t is None else "\n".join(x for x in t.split("\n") if (h, key(x)) not in drop)) for i, t, h in rows if t is not None)
    done = line_dedup.dedup(df, F.col("source"), ratio=ratio, least=least)
    got = done.collect()
    assert sorted((r["doc_id"], r["text"]) for r in got if r["text"] is not None) == want
    assert [r["__evidra_dropped"] for r in got if r["doc_id"] == 102] == [3]
    assert len(got) == len(rows) and ("a", "menu") in drop and (None, "menu") not in drop


def test_odd_tables(spark):
    assert line_dedup.report(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    one = line_dedup.report(spark.createDataFrame([(None, None, None)], "doc_id long, text string, source string")).collect()
    assert [(r["n_lines"], r["n_dropped"]) for r in one] == [(1, 0)]


def test_long_texts_and_names_of_its_own(spark):
    rows = [(i, "menu\n" + f"t{i}\n" * (100_000 if i == 3 else 1) + f"x{i}" * (500_000 if i == 4 else 1), "h", 5, 6) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, __evidra_host int, __evidra_lines int")
    out = line_dedup.dedup(df, F.col("source"), ratio=0.9, counts=False)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect())) == sorted((i, t.split("\n", 1)[1], h, 5, 6) for i, t, h, _, _ in rows)


def test_host(spark):
    df = spark.createDataFrame([("https://u:p@Www.Example.com:80/x",), ("http://a.b?q",), ("nothing",), (None,)], "u string")
    assert [r[0] for r in df.select(line_dedup.host_of(F.col("u"))).collect()] == ["www.example.com", "a.b", None, None]


def test_plan_is_native(spark):
    df = spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string")
    plan = line_dedup.report(df)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))


def test_copies_are_one_page(spark):
    """A third of all rows are copies, but for case and blanks: their lines stay, the line of all pages goes."""
    copy = "menu\nfirst line\nsecond line"
    rows = [(i, f"Menu\ntext {i}\nmore {i}", f"s{i % 2}") for i in range(200)] + [(1000 + i, copy.upper() + " " if i % 2 else copy, f"s{i % 2}") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(df, F.col("source"), copies_once=True).collect()}
    assert got == {i: "\n".join(t.split("\n")[1:]) for i, t, _ in rows}
    plain = {r["doc_id"]: r["text"] for r in line_dedup.dedup(df, F.col("source")).collect()}
    assert plain[1000] == "" and plain[0] == got[0]
