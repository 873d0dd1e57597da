"""Connected components of links between documents, as DataFrame steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same nodes as (a, b), at most one for each node: from the smallest to each other one."""
    if not a.size:
        return a, b
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: a.size], at[a.size :]
    label = np.arange(ids.size)
    while True:
        low = np.minimum(label[u], label[v])
        if (label[u] == low).all() and (label[v] == low).all():
            break
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        while (label[label] != label).any():
            label = label[label]
    out = label != np.arange(ids.size)
    return ids[label[out]], ids[out]


def connected_components(links: DataFrame) -> DataFrame:
    """``node``, ``component`` (smallest node reachable) of every node in ``links`` (a, b).

    Large-star and small-star steps in turn, each round written to the shared folder, until nothing changes.
    The smallest neighbours are written before the join, so that the rows of a node with very many links can
    be split over tasks.
    """
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs, before = written(pairs, "links"), None
    while True:
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if state == before or not state[0]:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(pairs.select("b", "b").distinct()) if state[0] else pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = state
        both = pairs.union(pairs.select("b", "a"))
        least = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, "large")
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = written(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "links")
