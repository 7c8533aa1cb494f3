import random
import re
from collections import Counter

import numpy as np

from evidra.llm import boosted_trees, quality_rules, weak_label

def docs(n=240):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    good = [(i, ". ".join(" ".join(rng.choice(words) for _ in range(9)).capitalize() for _ in range(rng.randint(7, 12))) + ".", 1) for i in range(n)]
    bad = [(n + i, " ".join(f"{w}***" for w in good[i][1].split()), 0) for i in range(n // 3)]
    bad += [(2 * n + i, (f"spam{i} " * 90).strip(), 0) for i in range(n // 3)]
    return good + bad


def test_statistics_by_brute_force():
    texts = ["", "a", "a b c a b c d", "x y\nx y\n \n \nz", "é é é é", "A b c\x1cd", "#*$ %&|<>", "one two three " * 40, "\t\n\x0b\x0c\r x"]
    s = quality_rules.statistics(texts)
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        twice = Counter(zip(w, w[1:], w[2:]))
        covered = {k + j for k in range(len(w) - 2) if twice[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines, seen, dups = t.split("\n"), set(), 0
        for x in lines:
            if re.search(r"[^\x20\x09-\x0D]", x):
                dups += x in seen
                seen.add(x)
        assert tuple(s.loc[i, quality_rules.COUNTS]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dups, len(covered)), t


def test_trees_are_monotone_and_flat():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 3))
    y = ((x[:, 0] + 0.1 * rng.standard_normal(2000) < 0.5) | (x[:, 1] > 0.9)).astype(float)
    trees = boosted_trees.fit(x, y, np.array([-1, 0, 1]), trees=30)
    grid = np.repeat(rng.random((50, 3)), 21, axis=0)
    for j, sign in ((0, -1), (2, 1)):
        g = grid.copy()
        g[:, j] = np.tile(np.linspace(0, 1, 21), 50)
        assert (sign * np.diff(trees.score(g).reshape(50, 21), axis=1) >= -1e-12).all()
    assert ((trees.score(x) > 0.5) == (y > 0)).mean() > 0.8

    def walk(row, node):
        while trees.left[node] != node:
            node = trees.left[node] if row[trees.feature[node]] <= trees.cut[node] else trees.right[node]
        return trees.value[node]

    raw = trees.base + sum(walk(x[0], r) for r in trees.roots)
    assert abs(1 / (1 + np.exp(-raw)) - trees.score(x[:1])[0]) < 1e-12


def test_rules(spark):
    rows = docs()
    df = spark.createDataFrame([(i, t, "e") for i, t, _ in rows], "doc_id long, text string, score string").repartition(3)
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows if i % 3] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    trees = quality_rules.train(df, labels)
    got = {r["doc_id"]: r for r in quality_rules.judge(df, trees).collect()}
    held = [(i, q) for i, _, q in rows if not i % 3]
    assert sum(got[i]["kept"] == bool(q) for i, q in held) >= 0.98 * len(held)
    kept = quality_rules.keep(df, trees)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}


def test_rules_on_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_rules.train(empty, labels) is None
    assert quality_rules.judge(empty, None).count() == 0
    odd = spark.createDataFrame([(None, None), (1, ""), (1, "w " * 90000), (2, " ".join(f"w{i}" for i in range(60)))], "doc_id long, text string")
    got = sorted((r["n_words"], r["base_failed"], r["kept"]) for r in quality_rules.judge(odd, None).collect())
    assert got == [(0, True, False), (0, True, False), (60, False, True), (90000, True, False)]


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(2)
    truth = rng.random(20000) < 0.7
    rates = [0.95, 0.9, 0.7, 0.6, 0.85]
    v = np.stack([np.where(rng.random(20000) < 0.2, -1, np.where(rng.random(20000) < r, truth, ~truth)) for r in rates], axis=1).astype(np.int8)
    patterns, inverse = np.unique(v, axis=0, return_inverse=True)
    model = weak_label.fit_labels(patterns, np.bincount(inverse.ravel()).astype(float))
    for j, r in enumerate(rates):
        assert abs(model.says[j, 1, 2] / (1 - model.says[j, 1, 0]) - r) < 0.05
    assert ((model.posterior(v) > 0.5) == truth).mean() > 0.9


def test_classifier_without_labels(spark):
    rows = docs()
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["kept"] for r in weak_label.classify(df, weak_label.train(df)).collect()}
    assert sum(got[i] == bool(q) for i, _, q in rows) >= 0.97 * len(rows)


def test_classifier_on_odd_tables(spark):
    assert weak_label.train(spark.createDataFrame([], "doc_id long, text string")) is None
    assert weak_label.classify(spark.createDataFrame([], "doc_id long, text string"), None).count() == 0
    odd = spark.createDataFrame([(None, None), (1, ""), (1, "a b"), (1, "a b"), (2, "z" * 100000)], "doc_id long, text string")
    assert weak_label.classify(odd, weak_label.train(odd)).count() == 5


def plain_labels(votes, rounds=100):
    """Expectation-maximisation document by document, in plain Python."""
    n, n_l = len(votes), len(votes[0])
    free = [min(max(sum(v[j] < 0 for v in votes) / n, 0.01), 0.99) for j in range(n_l)]
    says = [[[free[j]] + [(1 - free[j]) * (0.8 if v == c else 0.2) for v in (0, 1)] for c in (0, 1)] for j in range(n_l)]
    prior = 0.7
    for _ in range(rounds):
        good = []
        for v in votes:
            a, b = 1 - prior, prior
            for j in range(n_l):
                a, b = a * says[j][0][v[j] + 1], b * says[j][1][v[j] + 1]
            good.append(b / (a + b))
        before, says = says, []
        for j in range(n_l):
            rows = []
            for c in (0, 1):
                sums = [0.5 + sum((g if c else 1 - g) for g, v in zip(good, votes) if v[j] + 1 == k) for k in range(3)]
                rows.append([x / sum(sums) for x in sums])
            says.append(rows)
        prior = min(max(sum(good) / n, 0.02), 0.98)
        if max(abs(says[j][c][k] - before[j][c][k]) for j in range(n_l) for c in (0, 1) for k in range(3)) < 1e-7:
            break
    return prior, says


def test_label_model_by_brute_force():
    rng = np.random.default_rng(3)
    truth = rng.random(300) < 0.6
    votes = np.stack([np.where(rng.random(300) < 0.3, -1, np.where(rng.random(300) < r, truth, ~truth)) for r in (0.9, 0.8, 0.7, 0.85)], axis=1)
    patterns, inverse = np.unique(votes, axis=0, return_inverse=True)
    got = weak_label.fit_labels(patterns, np.bincount(inverse.ravel()).astype(float))
    prior, says = plain_labels(votes.tolist())
    assert abs(got.prior - prior) < 1e-9 and np.abs(got.says - np.array(says)).max() < 1e-9


def test_scores_by_brute_force():
    rng = np.random.default_rng(5)
    weights = rng.normal(size=weak_label.BUCKETS + 1)
    texts = ["a b", "", "Word word WORD 12 end.", "x", "same same same other", " \n ", "z" * 5000]
    got = weak_label.rate(texts, weights)
    for text, p in zip(texts, got):
        total = 0.0
        for t in ([text] if text.split() else []):
            # One text at a time: what stands beside it in a batch must not change its score.
            row, bucket, value = weak_label.hashed([t])
            assert set(row) == {0} and len(row) == 4 * len(t.split())
            total = sum(weights[b] * v for b, v in zip(bucket.tolist(), value.tolist()))
        assert abs(p - 1 / (1 + np.exp(-(total + weights[-1])))) < 1e-12


def test_classifier_keeps_columns_of_any_name(spark):
    rows = docs(60)
    plain = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = weak_label.train(plain)
    want = {r["doc_id"]: r["kept"] for r in weak_label.classify(plain, model).collect()}
    named = spark.createDataFrame([(i, t, "mine", 7) for i, t, _ in rows], "doc_id long, text string, votes string, Kept_ int")
    assert {r["doc_id"]: r["kept"] for r in weak_label.classify(named, model).collect()} == want
