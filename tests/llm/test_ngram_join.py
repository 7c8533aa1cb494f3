import random
import re

import numpy as np
import pytest

from evidra.llm import ngram_join
from evidra.llm.components import components
from evidra.llm.shared import Scratch


def brute(rows, width, percent):
    sets = {}
    for i, t in rows:
        if i is not None:
            w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
            sets.setdefault(i, set()).update({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(200)]
    bases = [[rng.choice(words) for _ in range(rng.choice([1, 2, 5, 9, 10, 12, 20, 40, 120]))] for _ in range(25)]
    passage = [rng.choice(words) for _ in range(30)]
    rows = []
    for i in range(n):
        b = list(rng.choice(bases))
        for _ in range(rng.randint(0, 6)):
            r = rng.random()
            if b and r < 0.4:
                b[rng.randrange(len(b))] = rng.choice(words)
            elif b and r < 0.6:
                del b[rng.randrange(len(b))]
            elif r < 0.7:
                b += passage
            else:
                b.insert(rng.randint(0, len(b)), rng.choice(words))
        rows.append((i * 7 % (n + 3), rng.choice([" ", "\n", "  "]).join(x.upper() if rng.random() < 0.1 else x for x in b)))
    return rows + [(90000, None), (90001, ""), (90002, " \t"), (None, rows[0][1]), rows[3], rows[3]]


@pytest.mark.parametrize("width, percent, chunk", [(3, 90, 2_000_000), (5, 80, 3000)])
def test_components_are_exact(spark, monkeypatch, width, percent, chunk):
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    rows = corpus(width, 600)
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n int").repartition(4)
    got = ngram_join.join(df, width, percent).collect()
    assert len(got) == len(rows)
    want = brute(rows, width, percent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == want
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]


@pytest.mark.parametrize("width, percent, known", [(3, 90, 20), (5, 80, 0), (3, 70, 5)])
def test_hot_ways_are_exact(spark, monkeypatch, width, percent, known):
    """Slices of cells and of nodes, broadcast classes and few told counts, each forced by a small bound."""
    for name, value in (("SLICE", 3), ("CELL", 4), ("CHUNK", 500), ("CLASS_ROWS", 3), ("KNOWN", known)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = corpus(width + percent, 250)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(df, width, percent).collect() if r["doc_id"] is not None}
    assert got == brute(rows, width, percent)


def test_many_salted_classes_are_exact(spark, monkeypatch):
    for name, value in (("CLASS_ROWS", 0), ("BROADCAST", 0)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = corpus(4, 120)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["doc_id"] is not None}
    assert got == brute(rows, 3, 90)


def test_links_that_no_hub_has(spark):
    """Texts in a row, each linked with the next ones only, and a very long text among them."""
    w = [f"w{k}" for k in range(400)]
    rows = [(i, " ".join(w[3 * i : 3 * i + 100])) for i in range(60)] + [(100, " ".join(w) + " z" * 60_000), (101, " ".join(w) + " z" * 60_001 + " y")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, 3, 90) and got[59][1] == 0 and got[101][1] == 100


def test_group_pairs_that_link_pass_the_filters():
    """The bound of the intersection by sizes and positions, and the sketch, against sets by brute force."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(2, 400))
        x = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < rng.uniform(0.8, 1)], rng.integers(0, 2**64, int(rng.integers(0, 30)), dtype=np.uint64)]))
        differ = len(np.setxor1d(x, y))
        bits = sum(int(a).bit_count() for a in (ngram_join.sketch(x) ^ ngram_join.sketch(y)).view(np.uint64))
        assert bits <= differ
        known = rng.integers(0, 3, 1 << 16).astype(np.uint8)
        both = len(np.intersect1d(x, y))
        if both and 100 * both >= 80 * (len(x) + len(y) - both):
            prefix = [ngram_join.in_order(s, known, len(s) - ngram_join._least(len(s), 80) + 1) for s in (x, y)]
            assert len(np.intersect1d(*prefix))


def test_first_of_each(spark):
    rows = corpus(9, 150)
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, rows string")
    kept = ngram_join.first_of_each(df).collect()
    want = brute(rows, 5, 80)
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted(i for i, (_, c) in want.items() if i == c)
    assert sum(r["doc_id"] is None for r in kept) == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_texts_of_one_id_are_one_set(spark, seed):
    """Two texts of an id are linked by their union, whatever the order of rows; each row has the result of its id."""
    w = [f"w{k}" for k in range(60)]
    long, start, rest = " ".join(w), " ".join(w[:32]), " ".join(w[28:])
    rows = [(1, start), (1, rest), (2, long), (3, start), (4, None), (4, "x y z"), (5, "X y z"), (None, start), (6, "p q r"), (6, "p q r"), (7, rest)]
    random.Random(seed).shuffle(rows)
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = brute(rows, 3, 90)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None) == sorted((i, *want[i]) for i, _ in rows if i is not None)
    assert [want[i][1] for i in range(1, 8)] == [1, 1, 3, 4, 4, 6, 7] and len(got) == len(rows)
    kept = ngram_join.first_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == [1, 3, 4, 6, 7]


def test_fewer_words_in_all_than_the_width():
    """A slice of texts may have fewer words together than an n-gram."""
    assert [len(s) for s in ngram_join.shingles(["a b c"], 5)] == [1] and [len(s) for s in ngram_join.shingles(["a", "", "b c"], 5)] == [1, 0, 1]


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.join(empty).count() == 0 and ngram_join.first_of_each(empty).count() == 0


def test_small_sets_at_the_limit(spark):
    """9 n-grams within 10 are exactly 90 percent; sizes of one band and of two."""
    w = [f"a{k}" for k in range(40)]
    rows = [(1, " ".join(w[:11])), (2, " ".join(w[:12])), (3, " ".join(w[20:28])), (4, " ".join(w[20:29])), (5, "x y"), (6, "X Y"), (7, "x y z")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (9, 1), 2: (10, 1), 3: (6, 3), 4: (7, 4), 5: (1, 5), 6: (1, 5), 7: (1, 7)}


def test_long_chain(spark):
    """A path is the worst case for labels."""
    edges = spark.createDataFrame([((i * 17) % 301, ((i + 1) * 17) % 301) for i in range(300)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r["node"]: r["label"] for r in components(edges, Scratch(spark, "test")).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {1001: 1000}
