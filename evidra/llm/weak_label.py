"""Quality classifier from weak labels.

Several heuristic labellers vote good (1), bad (0) or nothing (-1) on each document. Their votes over the whole
corpus are counted by pattern, and expectation-maximisation over the counted patterns estimates each labeller's
accuracies without any true label. The posteriors of a bounded sample of documents (``SAMPLE``, a documented
parameter, those with the smallest hashes of id and text) train a linear scorer on hashed features of the whole text,
and the scorer rates every document, also where all labellers abstain.

Defined cases: a null or empty text gets no bad vote and is scored by the bias alone; a document without id
is scored; repeated rows are scored one by one; texts with equal hashes are sampled together and cut at
the bound; an empty table gives an empty table and needs no model; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm.quality_rules import statistics
from evidra.llm.shared import map_batches, text_parts

#: Documents whose posteriors train the scorer, at most.
SAMPLE = 4000
BUCKETS = 1 << 16
#: Least score of a kept document.
LEAST = 0.5
#: Detectors: each votes bad above its limit and says nothing otherwise.
DETECTORS = {"symbol_share": 0.04, "dup_line_share": 0.4, "repeat_share": 0.5, "same_share": 0.15, "upper_share": 0.4, "point_share": 0.2, "word_length": 14.0}
#: Two general labellers overlap with them: ``plain`` looks at characters, ``clean`` at everything. Each votes bad if one
#: of its statistics is above the detector's limit, good if all are below this share of it, and else nothing.
CALM = 0.6
#: Below so many words no detector votes.
LEAST_WORDS = 8
PLAIN = ("symbol_share", "upper_share", "point_share")
LABELLERS = [*DETECTORS, "plain", "clean"]


def votes(s: pd.DataFrame) -> np.ndarray:
    """Documents by labellers: 1, 0, or -1 for none."""
    out = np.full((len(s), len(LABELLERS)), -1, np.int8)
    # Shares of a few words say little.
    enough = (s["n_words"] >= LEAST_WORDS).to_numpy()
    over = {f: (s[f] > limit).to_numpy() & enough for f, limit in DETECTORS.items()}
    calm = {f: (s[f] <= CALM * limit).to_numpy() for f, limit in DETECTORS.items()}
    for j, f in enumerate(DETECTORS):
        out[over[f], j] = 0
    for j, own in ((len(DETECTORS), PLAIN), (len(DETECTORS) + 1, tuple(DETECTORS))):
        out[np.logical_and.reduce([calm[f] for f in own]), j] = 1
        out[np.logical_or.reduce([over[f] for f in own]), j] = 0
    return out


@dataclass
class LabelModel:
    """prior: of good; says[j, c, v]: the chance that labeller j votes v - 1 on a document of class c."""

    prior: float
    says: np.ndarray

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """The probability of good for each row of votes."""
        each = np.stack([np.log(self.says[np.arange(v.shape[1]), c, v + 1]).sum(axis=1) for c in (0, 1)], axis=1)
        odds = each[:, 1] - each[:, 0] + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> LabelModel:
    """Expectation-maximisation over distinct vote patterns with their counts.

    It begins from labellers that are right in 8 of 10 votes, so that class 1 stays the one they call good.
    """
    n_l = patterns.shape[1]
    cast = (patterns >= 0).T * counts
    free = 1 - cast.sum(axis=1) / max(counts.sum(), 1)
    says = np.empty((n_l, 2, 3))
    says[:, :, 0] = np.clip(free, 0.01, 0.99)[:, None]
    for c in (0, 1):
        for v in (0, 1):
            says[:, c, v + 1] = (1 - says[:, c, 0]) * (0.8 if v == c else 0.2)
    model = LabelModel(0.7, says)
    for _ in range(rounds):
        good = model.posterior(patterns)
        before, says = model.says, np.empty((n_l, 2, 3))
        for c, w in ((0, counts * (1 - good)), (1, counts * good)):
            for v in (-1, 0, 1):
                says[:, c, v + 1] = ((patterns == v) * w[:, None]).sum(axis=0) + 0.5
            says[:, c] /= says[:, c].sum(axis=1, keepdims=True)
        model = LabelModel(float(np.clip((counts * good).sum() / max(counts.sum(), 1), 0.02, 0.98)), says)
        if np.abs(says - before).max() < 1e-7:
            break
    return model


def hashed(texts: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each text as (row, bucket, weight): its words, their shapes and pairs of shapes, by frequency."""
    words: list[str] = []
    counts = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        found = t.split()
        counts[i] = len(found)
        words += found
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    codes, distinct = pd.factorize(np.array(words, object))
    word_hash = pd.util.hash_array(distinct.astype(object), categorize=False)
    shapes = np.array([_shape(w) for w in distinct], np.uint64)
    doc = np.repeat(np.arange(len(texts)), counts)
    shape = shapes[codes]
    pair = np.r_[np.uint64(0), shape[:-1] * np.uint64(64) + shape[1:] + np.uint64(1 << 20)]
    first = np.r_[True, doc[1:] != doc[:-1]]
    pair[first] = shape[first] + np.uint64(1 << 30)
    same = np.r_[False, (codes[1:] == codes[:-1]) & ~first[1:]]
    kinds = [word_hash[codes], shape, pair, np.where(same, np.uint64(3), np.uint64(5)) + np.uint64(1 << 31)]
    mixed = np.concatenate([(k * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i)) >> np.uint64(64 - int(np.log2(buckets))) for i, k in enumerate(kinds)]).astype(np.int64)
    return np.tile(doc, len(kinds)), mixed, np.tile(1.0 / counts[doc], len(kinds))


def _shape(word: str) -> int:
    """Letters, digits, capitals, a symbol and a point as the bits of a number, with the length in steps."""
    kind = 1 * word.isupper() + 2 * any(c.isdigit() for c in word) + 4 * (not word[-1].isalnum())
    return kind * 8 + min(len(word) // 3, 7)


def rate(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """The scorer's probability of good for each text; the last weight is the bias."""
    row, bucket, value = hashed(texts, len(weights) - 1)
    raw = np.bincount(row, weights=value * weights[bucket], minlength=len(texts)) + weights[-1]
    return 1 / (1 + np.exp(-raw))


def summed(row: np.ndarray, bucket: np.ndarray, value: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal features of a text added up, by row and bucket."""
    key, inverse = np.unique(row * buckets + bucket, return_inverse=True)
    return key // buckets, key % buckets, np.bincount(inverse, weights=value, minlength=len(key))


def fit_scorer(row: np.ndarray, bucket: np.ndarray, value: np.ndarray, good: np.ndarray, buckets: int = BUCKETS, rounds: int = 300, pace: float = 0.3, ridge: float = 1e-6) -> np.ndarray:
    """Logistic regression on soft labels by AdaGrad over the whole sample in each round.

    Both classes weigh the same, so that a rare class isn't drowned.
    """
    w, seen = np.zeros(buckets + 1), np.full(buckets + 1, 1e-8)
    weight = good / max(good.sum(), 1e-9) + (1 - good) / max((1 - good).sum(), 1e-9)
    weight *= len(good) / weight.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(np.bincount(row, weights=value * w[bucket], minlength=len(good)) + w[-1])))
        slip = (p - good) * weight
        grad = np.r_[np.bincount(bucket, weights=value * slip[row], minlength=buckets), slip.sum()] / len(good) + ridge * w
        seen += grad * grad
        w -= pace * grad / np.sqrt(seen)
    return w


@dataclass
class Model:
    labels: LabelModel
    weights: np.ndarray


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Label model from the votes on all documents, scorer from a bounded sample; None for an empty table."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_parts(batches):
            v = votes(statistics(texts)).astype(np.int64) + 1
            key = v @ (3 ** np.arange(v.shape[1], dtype=np.int64))
            found, n = np.unique(key, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], names=["pattern", "n"])

    # At most 3 ** 9 patterns.
    rows = map_batches(own.select("text"), run, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    if not rows:
        return None
    keys = np.array(sorted(r["pattern"] for r in rows))
    by = {r["pattern"]: r["n"] for r in rows}
    counts = np.array([by[k] for k in keys], float)
    labels = fit_labels((keys[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1).astype(np.int8), counts)
    # The sample has a fixed bound of ids; only their texts are then read.
    place = F.xxhash64("doc_id", F.xxhash64("text"))
    chosen = own.select(place.alias("place")).orderBy("place").limit(sample).distinct()
    told = docs.sparkSession.sparkContext.broadcast(labels)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_parts(batches):
            row, bucket, value = summed(*hashed(texts))
            ends = pa.array(np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32))
            good = told.value.posterior(votes(statistics(texts)))
            yield pa.RecordBatch.from_arrays([part.column("place"), pa.array(good), pa.ListArray.from_arrays(ends, pa.array(bucket.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(value.astype(np.float32)))], names=["place", "good", "bucket", "value"])

    some = own.join(F.broadcast(chosen), place == F.col("place"), "left_semi").select(place.alias("place"), "text").dropDuplicates(["place"])
    rows = map_batches(some, features, "place long, good double, bucket array<int>, value array<float>").toPandas().sort_values("place")
    size = rows["bucket"].map(len).to_numpy()
    flat = lambda c, kind: np.concatenate([*rows[c], np.zeros(0)]).astype(kind)
    return Model(labels, fit_scorer(np.repeat(np.arange(len(rows)), size), flat("bucket", np.int64), flat("value", float), rows["good"].to_numpy()))


def classify(docs: DataFrame, model: Model | None, least: float = LEAST) -> DataFrame:
    """Per document: the labellers' posterior, the scorer's score and whether the document is kept."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_parts(batches):
            score = rate(texts, held.value.weights)
            post = held.value.labels.posterior(votes(statistics(texts)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(post), pa.array(score), pa.array(score >= least)], names=["doc_id", "posterior", "score", "kept"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(own, run, "doc_id long, posterior double, score double, kept boolean")
