"""Approximate nearest neighbours by an adaptive dimension scan.

Centroids of a bounded sample (``SAMPLE`` vectors with the smallest hashes of their ids, a documented parameter)
part all vectors into about sqrt(n) lists; every vector is indexed. Where the sample can't carry so many centroids, a
second level of centroids, of the differences from the first, cuts each list further. The vectors are turned
by a random rotation and scanned in blocks of columns: after each block the distance so far is
an estimate of the whole one, and a candidate is abandoned as soon as a test rejects, at the error that ``EPSILON`` sets,
that it is within the bound. What is left is measured in double precision on the original vectors.

A query first scans its nearest list, whose k-th distance is its bound for the other lists that it probes; within
a list without a bound the k-th of some candidates that look near gives one. The result comes from the probed
lists alone: the sample's vectors are found as any others.

The number of lists to probe isn't guessed: on the sample, the least one that holds ``RECALL`` of the true neighbours of
held-out sample vectors is taken.

A list of more than ``LIST_ROWS`` rows is dealt out over several tasks by hashes of vec_id, so that a list of very common
vectors is no hot group; the queries of a list are cut into blocks of ``LIST_QUERIES``.

Defined cases: vectors that are null, zero or hold null or non-finite components take no part, nor do those whose
length isn't the most frequent one (the shorter of equals) or whose vec_id is null; a vec_id that is repeated is one
candidate with its smallest distance and one query with the smallest rank first; ties go to the smaller vec_id; an empty
table gives an empty result; where the probed lists hold fewer than k others, so many are found; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidra.llm.shared import Scratch

#: Vectors that centroids and probes are fitted on, at most.
SAMPLE = 20_000
LIST_ROWS = 4096
LIST_QUERIES = 4096
RECALL = 0.95
#: Lists whose sizes may be broadcast.
BROADCAST = 500_000
#: Standard errors of the rejection test.
EPSILON = 2.1
BLOCK = 16


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part, but for their lengths."""
    e = F.col("embedding")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    return own.where(F.col("vec_id").isNotNull() & e.isNotNull() & fine)


@dataclass
class Index:
    """What searching needs: centroids, the centroids of differences from them, the rotation, and lists to probe.

    A list's number is that of its centroid times the number of differences, and its difference's.
    """

    centroids: np.ndarray
    further: np.ndarray
    rotation: np.ndarray
    probes: int

    def lists(self, x: np.ndarray) -> np.ndarray:
        """The list of each vector."""
        own = _squares(x, self.centroids).argmin(axis=1)
        return own * len(self.further) + _squares(x - self.centroids[own], self.further).argmin(axis=1)

    def nearest(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The lists nearest to each vector, of those of its nearest centroids."""
        near = np.argsort(_squares(x, self.centroids), axis=1, kind="stable")[:, :probes]
        if len(self.further) == 1:
            return near
        rest = x[:, None, :] - self.centroids[near]
        d = _squares(rest.reshape(-1, x.shape[1]), self.further).reshape(len(x), -1)
        lists = (near[:, :, None] * len(self.further) + np.arange(len(self.further))).reshape(len(x), -1)
        return np.take_along_axis(lists, np.argsort(d, axis=1, kind="stable")[:, :probes], axis=1)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :], 0)


def exact(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision."""
    d = rows.astype(np.float64) - query.astype(np.float64)
    return np.sqrt((d * d).sum(axis=1))


def _centroids(x: np.ndarray, lists: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's rounds from distinct vectors."""
    distinct = np.unique(x, axis=0)
    centroids = distinct[rng.choice(len(distinct), min(lists, len(distinct)), replace=False)]
    for _ in range(8):
        own = _squares(x, centroids).argmin(axis=1)
        count = np.bincount(own, minlength=len(centroids))
        sums = np.stack([np.bincount(own, weights=x[:, j], minlength=len(centroids)) for j in range(x.shape[1])], axis=1)
        centroids = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centroids)
    return centroids


def fit(sample: np.ndarray, n_rows: int, k: int, seed: int = 42) -> Index:
    """Centroids of one or two levels, a random rotation, and calibrated probes."""
    rng = np.random.default_rng(seed)
    dim, x = sample.shape[1], sample.astype(np.float64)
    wanted = max(1, round(np.sqrt(n_rows)))
    centroids = _centroids(x, min(wanted, max(1, len(np.unique(sample, axis=0)) // 8)), rng)
    further = np.zeros((1, dim))
    if wanted >= 2 * len(centroids):
        further = _centroids(x - centroids[_squares(x, centroids).argmin(axis=1)], wanted // len(centroids), rng)
    index = Index(centroids, further, np.linalg.qr(rng.standard_normal((dim, dim)))[0], 1)
    test = rng.choice(len(x), min(len(x), 256), replace=False)
    d = _squares(x[test], x)
    d[np.arange(len(test)), test] = np.inf
    near = np.argsort(d, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    own, most = index.lists(x), len(centroids) * len(further)
    probes = 1
    while near.size and probes < most:
        held = index.nearest(x[test], probes)
        if np.mean((held[:, None, :] == own[near][:, :, None]).any(axis=2)) >= RECALL:
            break
        probes = min(most, max(probes + 1, probes * 9 // 8))
    index.probes = probes
    return index


def _kth(ids: np.ndarray, score: np.ndarray, k: int) -> float:
    """The k-th least score of distinct ids, infinite if there are fewer."""
    order = np.argsort(score, kind="stable")
    first = np.sort(np.unique(ids[order], return_index=True)[1])
    return float(score[order[first[k - 1]]]) if len(first) >= k else float("inf")


def scan_list(query: np.ndarray, bound: float, turned: np.ndarray, turned_query: np.ndarray, rows: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances of the nearest of a list that are within the bound, k at most, ties to the smaller id."""
    dim = turned.shape[1]
    alive, partial = np.flatnonzero(ids != own), None
    partial = np.zeros(len(alive))
    for a in range(0, dim, BLOCK):
        b = min(a + BLOCK, dim)
        d = turned[alive, a:b] - turned_query[a:b]
        partial += np.einsum("ij,ij->i", d, d)
        if a == 0 and len(alive) > 8 * k:
            # Any k candidates bound the k-th distance; those that look near bound it best.
            some = alive[np.argpartition(partial, 4 * k)[: 4 * k]]
            bound = min(bound, _kth(ids[some], exact(query, rows[some]), k))
        # At the last block this is the distance itself, with room for rounding.
        slack = 1 + EPSILON / np.sqrt(b) if b < dim else 1 + 1e-5
        stay = partial * (dim / b) <= (slack * bound) ** 2 + 1e-12
        alive, partial = alive[stay], partial[stay]
    score = exact(query, rows[alive])
    fit_ = score <= bound
    alive, score = alive[fit_], score[fit_]
    order = np.lexsort((ids[alive], score))
    found, seen = [], set()
    for i in order:
        if (v := int(ids[alive[i]])) not in seen:
            seen.add(v)
            found.append(i)
            if len(found) == k:
                break
    return ids[alive[found]], score[found]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False) if len(column) else np.zeros(0, np.float32)
    return flat.astype(np.float32).reshape(len(column), dim)


def search(vectors: DataFrame, k: int = 10, query_every: int = 100, sample: int = SAMPLE) -> DataFrame:
    """The k nearest found of each row whose vec_id is divisible by query_every: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "nearest")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    own = valid(vectors)
    sizes = own.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not sizes:
        return empty
    dim, n_rows = sizes[0]["dim"], sizes[0]["n"]
    own = own.where(F.size("embedding") == dim)
    # A fixed bound of vectors reaches the driver.
    rows = own.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(sample).toPandas()
    index = spark.sparkContext.broadcast(fit(np.stack(rows["embedding"].to_numpy()).astype(np.float32), n_rows, k))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("embedding"), dim)
            own_list = index.value.lists(x.astype(np.float64)) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(own_list.astype(np.int64))], names=["vec_id", "raw", "list"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("embedding"), dim)
            for a in range(0, len(x), 512):
                part = x[a : a + 512]
                to = index.value.nearest(part.astype(np.float64), index.value.probes)
                arrays = [batch.column("vec_id").slice(a, len(part)), pa.array([r.tobytes() for r in part], pa.binary()), pa.array(to.astype(np.int64).tolist(), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["query_id", "raw", "lists"])

    placed = scratch.keep(own.mapInArrow(place, "vec_id long, raw binary, list long"), "lists")
    sizes = scratch.keep(placed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / LIST_ROWS).cast("int").alias("parts")), "sizes")
    few = sizes.count() <= BROADCAST
    with_parts = lambda df: df.join(F.broadcast(sizes) if few else sizes, "list")
    asked = own.where(F.col("vec_id") % query_every == 0).mapInArrow(ask, "query_id long, raw binary, lists array<long>")
    asked = scratch.keep(asked.withColumn("bound", F.lit(float("inf"))), "queries")

    def scan(key, cands: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = ([], [], [])
        if len(cands) and len(asks):
            matrix = lambda c: np.frombuffer(b"".join(c), np.float32).reshape(-1, dim)
            x, q, ids = matrix(cands["raw"]), matrix(asks["raw"]), cands["vec_id"].to_numpy()
            turned, turned_q = x @ index.value.rotation, q @ index.value.rotation
            for i, (name, bound) in enumerate(zip(asks["query_id"], asks["bound"])):
                found, score = scan_list(q[i], bound, turned, turned_q[i], x, ids, name, k)
                out[0].extend([name] * len(found))
                out[1].extend(found.tolist())
                out[2].extend(score.tolist())
        return pd.DataFrame({"query_id": np.array(out[0], np.int64), "vec_id": np.array(out[1], np.int64), "score": np.array(out[2], np.float64)})

    def found_in(goes: DataFrame) -> DataFrame:
        """query_id, vec_id and score of the nearest in the lists that queries go to; goes: query_id, raw, bound, list."""
        blocks = goes.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / LIST_QUERIES).cast("int").alias("blocks"))
        asks = goes.join(F.broadcast(blocks) if few else blocks, "list")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = with_parts(placed).join(F.broadcast(blocks) if few else blocks, "list").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).withColumn("block", every("blocks"))
        right = with_parts(asks).withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).withColumn("part", every("parts"))
        by = ["list", "part", "block"]
        met = left.select(*by, "vec_id", "raw").groupBy(*by).cogroup(right.select(*by, "query_id", "raw", "bound").groupBy(*by))
        return met.applyInPandas(scan, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))

    def best(found: DataFrame) -> DataFrame:
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
        return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    # The nearest list that isn't empty gives the bound for the others.
    there = asked.select("query_id", "raw", "bound", F.posexplode("lists").alias("place", "list")).join(F.broadcast(sizes.select("list")) if few else sizes.select("list"), "list", "left_semi")
    there = scratch.keep(there, "probes")
    nearest = there.groupBy("query_id").agg(F.min("place").alias("nearest"))
    there = there.join(nearest, "query_id").withColumn("first", F.col("place") == F.col("nearest"))
    first = scratch.keep(best(found_in(there.where("first").select("query_id", "raw", "bound", "list"))), "first")
    bounds = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("told"))
    others = there.where("not first").join(bounds, "query_id", "left").select("query_id", "raw", F.coalesce("told", "bound").alias("bound"), "list")
    return best(first.drop("rank").unionByName(found_in(others)).groupBy("query_id", "vec_id").agg(F.min("score").alias("score")))
