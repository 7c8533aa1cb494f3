"""Connected components of an edge table, by star contractions.

Each round writes its edges to the shared folder, so lineage stays short and a lost executor costs one round at
most. Neither edges nor nodes are ever collected.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm.shared import Scratch


def labels_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (a, b), and for each the least node of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        # The root of each side takes the least label, then paths are halved until they are flat.
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while not np.array_equal(flat := new[new], new):
            new = flat
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def components(edges: DataFrame, scratch: Scratch, most: int = 60) -> DataFrame:
    """Every node of the edges (a, b: long) that isn't the least of its component, and that least node as label."""
    e = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(most):
        # Stars, in which no centre is a ray, are components: each has all its nodes on one centre.
        rays = e.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("a").alias("distinct")).first()
        if rays["n"] == rays["distinct"] and e.select(F.col("b").alias("a")).join(e.select("a"), "a", "left_semi").isEmpty():
            return e.select(F.col("a").alias("node"), F.col("b").alias("label"))
        # Every larger neighbour of a node goes to the least node near it ...
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # ... then every smaller neighbour and the node itself.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        before = scratch.last
        e = scratch.keep(small.distinct(), "edges")
        scratch.drop(before)
    raise RuntimeError(f"components didn't settle in {most} rounds")
