"""Dense retrieval by cosine similarity, and the dependency-free hashing embedder."""

from __future__ import annotations

import hashlib
import math
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidra.operators.lexical import top


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two double arrays; null if either is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms)


def dense(vectors: DataFrame, questions: DataFrame, top_k: int = 40) -> DataFrame:
    """query_id, id, score and rank. vectors: id, vector; questions: query_id, vector (a batch of questions, broadcast).

    Norms are computed once for each side, only vectors of the question's dimension take part, and the top of each
    partition is cut before the shuffle.
    """
    norm = lambda c: F.sqrt(dot(c, c))
    v = vectors.select("id", F.col("vector").cast("array<double>").alias("v")).withColumn("v_norm", norm(F.col("v")))
    q = questions.select("query_id", F.col("vector").cast("array<double>").alias("q")).withColumn("q_norm", norm(F.col("q")))
    pairs = v.join(F.broadcast(q), F.size("v") == F.size("q"))
    scored = pairs.select("query_id", "id", F.try_divide(dot(F.col("v"), F.col("q")), F.col("v_norm") * F.col("q_norm")).alias("score"))
    return top(scored.where("score is not null"), top_k)


@lru_cache(maxsize=100_000)
def _grams(word: str, dimension: int, own_sign: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of a word's 3-grams."""
    padded = f" {word} "
    found = [int.from_bytes(hashlib.blake2b(padded[i : i + 3].encode(), digest_size=4).digest(), "big") for i in range(max(1, len(padded) - 2))]
    return np.array([h % dimension for h in found]), np.array([1.0 if (h >> 31 if own_sign else h) & 1 else -1.0 for h in found])


def _hashed(text: str, dimension: int, own_sign: bool) -> np.ndarray:
    grams = [_grams(w, dimension, own_sign) for w in re.findall(r"\w+", text)]
    if not grams:
        return np.zeros(dimension)
    places, signs = (np.concatenate(x) for x in zip(*grams))
    out = np.bincount(places, weights=signs, minlength=dimension)
    return out / (math.sqrt(float(out @ out)) or 1.0)


def hashing_embedder(dimension: int = 256, own_sign: bool = False):
    """A Column function that embeds folded text by hashed character 3-grams.

    With own_sign the sign is a bit of its own rather than the parity of the bucket.
    """

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else _hashed(t, dimension, own_sign).astype(np.float32))

    return embed
