import numpy as np

from evidra.llm import nearest


def vectors(rng, n, dim):
    centres = rng.standard_normal((12, dim))
    return (centres[rng.integers(0, 12, n)] + 0.4 * rng.standard_normal((n, dim))).astype(np.float32)


def brute(ids, x, q, k):
    d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
    own = np.flatnonzero(ids != ids[q])
    own = own[np.lexsort((ids[own], d[own]))]
    return [(int(ids[i]), d[i]) for i in own[:k]]


def test_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    x = vectors(rng, 3000, 24)
    x[2000:2300] = x[0]  # a vector that is very common
    ids = rng.permutation(3000)
    rows = [(int(i), v.tolist(), 0) for i, v in zip(ids, x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int").repartition(4)
    nearest.LIST_ROWS, kept = 200, nearest.LIST_ROWS
    try:
        got = nearest.search(df, sample=1500).collect()
    finally:
        nearest.LIST_ROWS = kept
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(by) == set(range(0, 3000, 100))
    hits = 0
    for q, found in by.items():
        found.sort()
        want = brute(ids, x, int(np.flatnonzero(ids == q)[0]), 10)
        assert [f[0] for f in found] == list(range(1, 11))
        hits += len({f[1] for f in found} & {w[0] for w in want})
        for _, v, score in found:
            a, b = x[ids == q][0].astype(float), x[ids == v][0].astype(float)
            assert abs(score - np.sqrt(((a - b) ** 2).sum())) < 1e-9
    assert hits >= 0.9 * 10 * len(by)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (8, [1.0, 0.0]), (8, [1.0, 0.0])]
    got = [tuple(r) for r in nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("rank").collect()]
    assert [(q, r, v) for q, r, v, _ in got] == [(0, 1, 8), (0, 2, 1)] and got[0][3] == 0
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest.search(empty).count() == 0
    alone = spark.createDataFrame([(100, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert nearest.search(alone).count() == 0


def test_scan_abandons_only_the_far():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((4000, 64)).astype(np.float32)
    q, turn = x[0], np.linalg.qr(rng.standard_normal((64, 64)))[0]
    d = nearest.exact(q, x)
    bound = float(np.sort(d)[10])
    found, score = nearest.scan_list(q, bound, x @ turn, q @ turn, x, np.arange(4000), 0, 10)
    want = np.argsort(d, kind="stable")[1:11]
    assert len(set(found) & set(want)) >= 9 and np.all(np.diff(score) >= 0)


def test_lists_alone_find_the_neighbours(spark):
    """A sample far below the table, two levels of lists, and far fewer lists probed than there are."""
    rng = np.random.default_rng(5)
    x = (rng.standard_normal((120, 16))[rng.integers(0, 120, 12_000)] + 0.15 * rng.standard_normal((12_000, 16))).astype(np.float32)
    index = nearest.fit(x[:400], 12_000, 10)
    lists = len(index.centroids) * len(index.further)
    assert len(index.further) > 1 and lists >= 90 and index.probes <= lists // 3
    ids = np.arange(12_000)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")
    by = {}
    for r in nearest.search(df, sample=400).collect():
        by.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert sum(len(by[q] & {v for v, _ in brute(ids, x, q, 10)}) for q in range(0, 12_000, 100)) >= 0.9 * 1200
