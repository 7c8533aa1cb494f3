import random

import pytest
from pyspark.sql import functions as F

from evidra.llm import mixing


def test_shortages_stay_among_siblings_first():
    room = {("a", "x"): 10.0, ("a", "y"): 100.0, ("b", "z"): 1000.0}
    got = mixing.allot(room, 100.0, {})
    assert got == {("a", "x"): 10.0, ("a", "y"): 40.0, ("b", "z"): 50.0}
    # What a's children can't take together goes to b.
    assert mixing.allot(room, 400.0, {}) == {("a", "x"): 10.0, ("a", "y"): 100.0, ("b", "z"): 290.0}
    assert mixing.allot(room, 5000.0, {}) == room
    assert mixing.allot(room, 100.0, {("a",): 3.0})[("b", "z")] == 25.0
    assert mixing.allot(room, 5000.0, {("b",): 0.0})[("b", "z")] == 0.0
    assert mixing.allot({}, 10.0, {}) == {}


def rows(n):
    return [(i, " ".join(["w"] * (1 + i % 7)), "en" if i % 3 else None, f"s{min(i % 10, 6)}") for i in range(n)]


@pytest.mark.parametrize("epochs, ranges", [(1, 10), (3, 2000)])
def test_prefixes(spark, monkeypatch, epochs, ranges):
    monkeypatch.setattr(mixing, "RANGE_ROWS", ranges)
    plan = mixing.Plan(["lang", "source"], 900.0 * epochs, {("en",): 3.0}, epochs)
    df = spark.createDataFrame(rows(700), "doc_id long, text string, lang string, source string").repartition(4)
    got = mixing.select(df, plan).collect()
    assert len(got) == 700
    room, leaves = {}, {}
    for r in got:
        path = (r["__evidra_level_0"], r["__evidra_level_1"])
        room[path] = room.get(path, 0) + epochs * r["__evidra_tokens"]
        leaves.setdefault(path, []).append(r)
    given = mixing.allot({p: float(n) for p, n in room.items()}, plan.budget, plan.weights)
    for path, own in leaves.items():
        took = sum(r["__evidra_tokens"] * r["__evidra_copies"] for r in own)
        assert given[path] - 1 <= took < given[path] + 7
        assert max(r["__evidra_copies"] for r in own) - min(r["__evidra_copies"] for r in own) <= 1
        assert max(r["__evidra_copies"] for r in own) <= epochs
        # Exactly a prefix of the seeded order of the last epoch.
        times = min(r["__evidra_copies"] for r in own)
        order = {r["k"]: r["o"] for r in spark.createDataFrame([(r["__evidra_id"],) for r in own], "__evidra_id long").select(F.col("__evidra_id").alias("k"), mixing._order(plan.seed, times).alias("o")).collect()}
        more = [order[r["__evidra_id"]] for r in own if r["__evidra_copies"] > times]
        less = [order[r["__evidra_id"]] for r in own if r["__evidra_copies"] == times]
        assert not more or not less or max(more) < min(less)


def test_mix_repeats_epochs_and_keeps_columns(spark):
    df = spark.createDataFrame([(*r, 1) for r in rows(50)], "doc_id long, text string, lang string, source string, copies int")
    out = mixing.mix(df, mixing.Plan(["lang"], 1.0, {}, 2))
    assert out.columns == df.columns
    total = sum(len(r[1].split()) for r in rows(50))
    assert abs(sum(len(r["text"].split()) for r in out.collect()) - total) < 16


def test_odd_tables(spark):
    odd = [(None, None, None, None), (1, "", "en", "s1"), (1, "a b", "en", "s1"), (1, "a b", "en", "s1")]
    df = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string")
    assert mixing.report(df).count() == 4
    assert mixing.report(df.limit(0)).count() == 0 and mixing.mix(df.limit(0), mixing.Plan(["lang"])).count() == 0


def test_domains(spark):
    df = spark.createDataFrame([("src7",), ("x",), (None,)], "s string")
    assert [r[0] for r in df.select(mixing.domain_of(F.col("s"))).collect()] == ["domain3", "other", "other"]


def poured(room, budget, weights):
    """Brute force: a token's thousandth after the other goes to the open child that is furthest behind its weight, from the root down."""
    left, got = dict(room), {p: 0.0 for p in room}
    depth = len(next(iter(room)))
    weight = lambda p: weights.get(p, 1.0)
    step = 0.05
    had = {}

    def open_(prefix):
        return any(left[p] > 1e-9 and all(weight(p[:k]) > 0 for k in range(len(prefix) + 1, depth + 1)) for p in room if p[: len(prefix)] == prefix)

    while budget > 1e-9 and open_(()):
        path = ()
        for k in range(depth):
            below = sorted({p[: k + 1] for p in room if p[:k] == path and weight(p[: k + 1]) > 0 and open_(p[: k + 1])}, key=repr)
            path = min(below, key=lambda c: had.get(c, 0.0) / weight(c))
        n = min(step, left[path], budget)
        for k in range(1, depth + 1):
            had[path[:k]] = had.get(path[:k], 0.0) + n
        left[path] -= n
        got[path] += n
        budget -= n
    return got


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_budgets_against_pouring(spark, seed):
    rng = random.Random(seed)
    room = {(rng.choice("ab"), rng.choice(["x", "y", None]), f"s{i}"): rng.choice([0.0, 1.0, 3.0, 20.0]) for i in range(9)}
    weights = {("a",): 2.0, ("b", "x"): 3.0, ("a", None): 0.5, **{p: float(rng.randint(0, 3)) for p in list(room)[:3]}}
    for budget in (5.0, 30.0, 1000.0):
        leaves = spark.createDataFrame([(["n" if v is None else f"v{v}" for v in p], r) for p, r in room.items()], "path array<string>, room double")
        got = {tuple(None if v == "n" else v[1:] for v in r["path"]): r["given"] for r in mixing.budgets(leaves, 3, budget, weights).collect()}
        want, plain = poured(room, budget, weights), mixing.allot(room, budget, weights)
        assert got.keys() == want.keys()
        for p in want:
            assert abs(got[p] - plain[p]) < 1e-6 and abs(got[p] - want[p]) < 0.3, (p, budget)


def test_many_leaves_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST", 0)
    df = spark.createDataFrame([(i, "w " * (1 + i % 3), "en", f"s{i % 150}") for i in range(900)], "doc_id long, text string, lang string, source string")
    plan = mixing.Plan(["lang", "source"], 0.5)
    took = mixing.select(df, plan).groupBy().agg(F.sum(F.col("__evidra_tokens") * F.col("__evidra_copies"))).first()[0]
    assert 900 <= took <= 900 + 150 * 3 and mixing.mix(df, plan).count() > 300


def test_leaves_of_equal_rows_and_clashing_names(spark):
    """Rows of one id and text in two leaves, one of them without weight; a very long text; columns with names of the operator's own."""
    rows = [(1, "a b", "en", 1, 2), (1, "a b", "fr", 1, 2), (2, "w " * 300_000, "en", 3, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, __evidra_text long, `__evidra_copies` long")
    out = mixing.mix(df, mixing.Plan(["lang"], 1.0, {("fr",): 0.0}))
    assert out.columns == df.columns and sorted((r["doc_id"], r["lang"], r["__evidra_text"]) for r in out.collect()) == [(1, "en", 1), (2, "en", 3)]
