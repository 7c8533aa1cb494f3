"""Quality rules: base limits on document statistics, then gradient-boosted trees over them.

Words are runs of characters other than space and U+0009 to U+000D. The trees are trained on a bounded sample
of labelled documents (``SAMPLE`` documents with the smallest hashes of their ids, a documented parameter) and
shipped as numpy node arrays; every document is scored. Shares of symbols, repeated lines, repeated words and
words equal to the one before may only lower a document's score.

Defined cases: a null or empty text has no word and fails the base limits; a document without id is judged like
any other; repeated rows are judged one by one; null labels are left out, of several labels of one document
the least counts; without labels of both classes the trees are left out and the base limits decide; an empty
table gives an empty table; other columns pass through ``keep`` untouched and are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm.boosted_trees import BoostedTrees, fit
from evidra.llm.shared import map_batches, text_parts

#: Labelled documents to train on, at most.
SAMPLE = 6000
#: Least probability of good quality that a kept document has.
LEAST = 0.3
MIN_WORDS = 50
SPACE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
FEATURES = {
    # statistic: how the score may follow it
    "log_words": 0,
    "word_length": 0,
    "symbol_share": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "same_share": -1,
    "upper_share": 0,
    "digit_share": 0,
    "point_share": 0,
    "words_per_line": 0,
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated(codes: np.ndarray, counts: np.ndarray, width: int = 3) -> np.ndarray:
    """Per text, the words in windows of so many words that the text has twice or more.

    codes: an integer for each word, of all texts in order; counts: words of each text.
    """
    n = len(codes)
    doc = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
    if n < width:
        return np.zeros(len(counts), np.int64)
    top = int(codes.max()) + 1
    key = doc[: n - width + 1]
    for k in range(width):
        key = pd.factorize(key * top + codes[k : n - width + 1 + k])[0].astype(np.int64)
    whole = doc[: n - width + 1] == doc[width - 1 :]
    twice = np.zeros(len(key), bool)
    at = np.flatnonzero(whole)
    twice[at] = pd.Series(key[at]).duplicated(keep=False).to_numpy()
    covered = np.zeros(n, bool)
    for k in range(width):
        covered[k : n - width + 1 + k] |= twice
    return np.bincount(doc[covered], minlength=len(counts))


def statistics(texts: list[str]) -> pd.DataFrame:
    """The five counts and the features of each text."""
    raw = [t.encode() for t in texts]
    words: list[bytes] = []
    counts = np.zeros(len(raw), np.int64)
    for i, r in enumerate(raw):
        found = r.split()
        counts[i] = len(found)
        words += found
    codes = pd.factorize(np.array(words, object))[0].astype(np.int64) if words else np.zeros(0, np.int64)
    less = lambda drop: np.array([len(r) - len(r.translate(None, drop)) for r in raw], np.int64)
    chars = np.array([len(t) for t in texts], np.int64)
    lines, dups = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64)
    for i, r in enumerate(raw):
        own = r.split(b"\n")
        lines[i] = len(own)
        seen = set(own)
        if len(seen) < len(own):
            blank = [x for x in seen if not x.strip(SPACE)]
            dups[i] = len(own) - len(seen) - sum(own.count(x) - 1 for x in blank)
    doc = np.repeat(np.arange(len(counts)), counts)
    same = np.r_[False, (codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])] if len(codes) else np.zeros(0, bool)
    out = pd.DataFrame({"n_words": counts, "word_chars": chars - less(SPACE), "n_symbols": less(SYMBOLS), "n_dup_lines": dups, "n_repeat_words": repeated(codes, counts)})
    n, c = np.maximum(counts, 1), np.maximum(out["word_chars"].to_numpy(), 1)
    out["log_words"], out["word_length"] = np.log1p(counts), out["word_chars"] / n
    out["symbol_share"], out["dup_line_share"], out["repeat_share"] = out["n_symbols"] / c, dups / np.maximum(lines, 1), out["n_repeat_words"] / n
    out["same_share"] = np.bincount(doc[same], minlength=len(counts)) / n
    out["upper_share"], out["digit_share"], out["point_share"] = less(bytes(range(65, 91))) / c, less(b"0123456789") / c, less(b"!?.,;:") / c
    out["words_per_line"] = counts / np.maximum(lines, 1)
    return out


def base_failed(s: pd.DataFrame) -> np.ndarray:
    return ((s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > 50 * s["n_words"])).to_numpy()


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> BoostedTrees | None:
    """Trees that tell quality 1 from 0, or None where the labels don't hold both."""
    clean = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null")
    # The sample has a fixed bound, so that it may be broadcast and what comes of it be collected.
    chosen = clean.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = texts.join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, held in text_parts(batches):
            s = statistics(held)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), *(pa.array(s[f].to_numpy(float)) for f in FEATURES)], names=["doc_id", "quality", *FEATURES])

    schema = "doc_id long, quality int, " + ", ".join(f"{f} double" for f in FEATURES)
    rows = map_batches(own, run, schema).groupBy("doc_id").agg(F.min("quality").alias("quality"), *(F.min(f).alias(f) for f in FEATURES)).toPandas().sort_values("doc_id")
    y = (rows["quality"].to_numpy() > 0).astype(float)
    if len(np.unique(y)) < 2:
        return None
    return fit(rows[list(FEATURES)].to_numpy(), y, np.array(list(FEATURES.values())))


def verdict(s: pd.DataFrame, trees: BoostedTrees | None, least: float = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """The probability of good quality, and whether the document is kept."""
    score = trees.score(s[list(FEATURES)].to_numpy()) if trees is not None else np.ones(len(s))
    return score, ~base_failed(s) & (score >= least)


def judge(docs: DataFrame, trees: BoostedTrees | None) -> DataFrame:
    """Per document: the five counts, base_failed, kept and the trees' score."""
    held = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_parts(batches):
            s = statistics(texts)
            score, kept = verdict(s, held.value)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(s[c].to_numpy(np.int64)) for c in COUNTS), pa.array(base_failed(s)), pa.array(kept), pa.array(score)], names=["doc_id", *COUNTS, "base_failed", "kept", "score"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, score double"
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, schema)


def keep(docs: DataFrame, trees: BoostedTrees | None) -> DataFrame:
    """The rows of docs whose text is kept, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_parts(batches):
            _, kept = verdict(statistics(texts), held.value)
            yield part.filter(pa.array(kept))

    return map_batches(docs, run, docs.schema)
