"""Operator 2: nearest neighbours by a permutation index.

Every vector is represented by the order of its nearest pivots and posted once, in the pivot inverted files of one
shard (pivot -> the vectors that rank it among their nearest, with its rank). A query reads only the files of its
own nearest pivots there: what they hold adds up to Spearman's footrule distances (a pivot that is missing counts as
ranked after the last). The vectors of least distance, ties included, are reranked by inner products in double
precision, and the best of all shards are merged.

Pivots are a bounded sample of the rows, in order of a hash; every row is indexed. A shard has a bounded number of
rows, and queries pass through it as a stream. The share of the rows that is reranked falls as rows become more
(``rerank_share``, read off recall curves: see the README).

Cases: vectors that are null, zero or hold a null or non-finite component take no part, nor do rows with a
null vec_id; vectors are compared with those of equal length only, without an index where most pivots have another
length; a vec_id with several embeddings counts once, by the nearest; equal scores go to the smaller
vec_id; fewer rows than ``k`` give all of them; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

PIVOTS, PREFIX = 192, 64
#: Rows of a shard at most (on average), and the number of shards at least.
SHARD_ROWS, SHARDS = 1 << 16, 16


def rerank_share(rows: int) -> float:
    """Share of the rows that is reranked: 0.26 of 1,000, 0.11 of 50,000, 0.013 of 1,000,000,000."""
    return min(1.0, 0.22 * (max(rows, 1) / 2000) ** -0.214)


def usable(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """vec_id and v (array of double) of the rows that take part, each once."""
    v = F.col(vec).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    return rows.where(finite & F.exists("v", lambda x: x != 0)).dropDuplicates(["vec_id", "v"])


def pivots_of(rows: DataFrame, pivots: int = PIVOTS) -> np.ndarray:
    """At most ``pivots`` different vectors among the first rows by a hash of vec_id, of the length that most of these have."""
    sample = [np.asarray(r[0]) for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(8 * pivots).select("v").collect()]
    if not sample:
        return np.zeros((0, 0))
    lengths = [len(v) for v in sample]
    common = max(set(lengths), key=lambda n: (lengths.count(n), n))
    p = np.stack(list({v.tobytes(): v for v in sample if len(v) == common}.values())[:pivots])
    return p / np.linalg.norm(p, axis=1, keepdims=True)


def permutation(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Numbers of the ``prefix`` nearest pivots of each vector, nearest first."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :prefix]


class Shard:
    """Vectors of one length with their pivot inverted files."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray, prefix: int, share: float):
        self.ids, self.x, self.pivots, self.share = ids, x, pivots, share
        self.repeats = np.unique(ids).size < ids.size
        self.prefix = min(prefix, len(pivots)) if x.shape[1] == pivots.shape[1] else 0
        if self.prefix:
            near = np.concatenate([permutation(x[lo : lo + 8192], pivots, self.prefix) for lo in range(0, len(x), 8192)]).astype(np.int16).ravel()
            order = np.argsort(near, kind="stable")
            self.rows, self.ranks = (order // self.prefix).astype(np.int32), (order % self.prefix).astype(np.int16)
            self.begin = np.searchsorted(near[order], np.arange(len(pivots) + 1)).tolist()

    def gain(self, near: np.ndarray) -> np.ndarray:
        """How far the footrule distances of all rows lie below that of permutations that share no pivot, halved.

        With l ranks kept, a shared pivot at ranks a and b saves 2 * (l - max(a, b)).
        """
        files = [slice(self.begin[p], self.begin[p + 1]) for p in near.tolist()]
        at = np.repeat(np.arange(self.prefix, dtype=np.int16), [f.stop - f.start for f in files])
        saves = self.prefix - np.maximum(np.concatenate([self.ranks[f] for f in files]), at)
        return np.bincount(np.concatenate([self.rows[f] for f in files]), saves, len(self.x))

    def search(self, q_ids: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query_id, vec_id, score) of each query's k best among the rows of least footrule distance."""
        keep = min(len(self.x), max(k + 1, int(np.ceil(self.share * len(self.x)))))
        near = permutation(q, self.pivots, self.prefix) if self.prefix else None
        for i in range(len(q)):
            at = np.arange(len(self.x))
            if near is not None and keep < len(self.x):
                gain = self.gain(near[i])
                at = np.flatnonzero(gain >= np.partition(gain, len(gain) - keep)[len(gain) - keep])  # with ties
            at = at[self.ids[at] != q_ids[i]]
            rough = self.x[at] @ q[i]
            if at.size > k and not self.repeats:  # summed in one fixed order below, as near ties are ordered by the last bits
                kth = np.partition(rough, at.size - k)[at.size - k]
                at = at[rough >= kth - 1e-9 * (1 + abs(kth))]
            score = (self.x[at] * q[i]).sum(axis=1)
            best = np.lexsort((self.ids[at], -score))
            if self.repeats:
                best = best[np.sort(np.unique(self.ids[at][best], return_index=True)[1])]
            best = best[:k]
            yield np.full(best.size, q_ids[i]), self.ids[at][best], score[best]


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, pivots: int = PIVOTS, prefix: int = PREFIX, rerank: float | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k nearest found. Both frames: ``usable`` rows.

    Vectors are shuffled once, to their shards; queries are sent to all shards. ``rerank``: the share of the rows that
    is reranked, by ``rerank_share`` if not given.
    """
    rows, asked = written(vectors, "vectors"), written(queries, "queries")
    p, n = pivots_of(rows, pivots), rows.count()
    share = rerank_share(n) if rerank is None else rerank
    shards = max(SHARDS, -(-n // shard_rows))
    on = ["size", "shard"]
    mine = F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int")
    data = rows.select(F.size("v").alias("size"), mine.alias("shard"), F.lit(False).alias("asks"), "vec_id", "v")
    ask = asked.select(F.size("v").alias("size"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), "vec_id", "v")
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), shards)
    dealt = data.unionByName(ask).repartition(parts, *on).sortWithinPartitions(*on, "asks")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, shard = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            names = [b.column(c).to_numpy(zero_copy_only=False) for c in [*on, "asks"]]
            change = np.flatnonzero(np.any([x[1:] != x[:-1] for x in names], axis=0)) + 1
            ids, v = b.column("vec_id").to_numpy(), b.column("v")
            for lo, hi in zip([0, *change.tolist()], [*change.tolist(), b.num_rows]):
                size, number, asks = (x[lo] for x in names)
                if (size, number) != now:
                    now, held, shard = (size, number), [], None
                x = v.slice(lo, hi - lo).flatten().to_numpy().reshape(hi - lo, size)
                if not asks:
                    held.append((ids[lo:hi], x))
                    continue
                if not held:  # no vectors of that length here
                    continue
                shard = shard or Shard(*map(np.concatenate, zip(*held)), p, prefix, share)
                for at in range(0, hi - lo, 1024):
                    found = list(shard.search(ids[lo:hi][at : at + 1024], x[at : at + 1024], k))
                    columns = [np.concatenate([f[c] for f in found]) for c in range(3)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

    best = dealt.mapInArrow(match, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
