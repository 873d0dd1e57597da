"""Operator 11: k-means over integer vectors, with heap-ordered bounds.

Rows are cut into blocks of bounded size where they are read (no shuffle, so that no key can be hot); a block is a
row with its vectors and, for each cluster, a binary heap of them. A vector enters the heap of its cluster under

    second distance - first distance + the drift that the cluster has accumulated so far.

When centroids move, the gap of a cluster's vectors shrinks by at most the movement of its own centroid plus the
largest movement of another one; that sum is added to the cluster's drift, once for all its vectors. A vector may have
another nearest centroid only when its key is not above the drift: then it is popped, compared with all centroids, and
pushed into the heap of the nearest. All other vectors are neither looked at nor moved. Sums of clusters change by the
vectors that moved, so that a round passes k * size numbers through the driver, whatever the number of vectors.

Distances are exact integers; the bounds are square roots in double precision, taken a little too narrow, so that
rounding leads to a needless comparison but never to a missed one. A round's state is a table in the shared folder,
from which a lost task is run again; the one before it is removed once the next is complete.

Cases: vectors that are null, have another length, or hold a null or non-finite component take no part, nor do those
with a component of 2^19 or more in size (their squared distances need not fit a long); each row counts, repeated ones
too; a null vec_id is clustered, and comes last in the choice of centroids; rows that tie there are ordered by their
components; equal distances go to the smaller centroid; fewer vectors than ``k`` give as many centroids; an empty
table gives an empty result; an inertia beyond a long is null; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

#: Vectors of a block at most.
BLOCK = 4096
#: Components of kept vectors, in size, are less than this (before they are multiplied).
LARGEST = 1 << 19
#: Up to this size, sums of 64 products of components are exact in double precision.
EXACT = 1 << 22

_STATE = pa.schema(
    [
        ("vec_id", pa.list_(pa.int64())), ("x", pa.binary()),  # components as little-endian 32-bit integers
        ("sizes", pa.list_(pa.int32())), ("keys", pa.list_(pa.float64())), ("at", pa.list_(pa.int32())),  # heaps, one after the other
        ("change", pa.list_(pa.int64())), ("scanned", pa.int64()),
    ]
)
_STATE_DDL = "vec_id array<long>, x binary, sizes array<int>, keys array<double>, at array<int>, change array<long>, scanned long"


def usable(df: DataFrame, size: int = 64, scale: int = 256, vec: str = "embedding") -> DataFrame:
    """vec_id and x (array of int: floor(scale * component)) of the rows that take part."""
    fits = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float(LARGEST)))
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vec).cast("array<double>").alias("v")).where(F.size("v") == size)
    return rows.where(fits).select("vec_id", F.transform("v", lambda e: F.floor(e * float(scale)).cast("int")).alias("x"))


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``seed:vec_id``, in that order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    found = rows.orderBy(digest.asc_nulls_last(), "x").limit(k).select("x").collect()
    return np.asarray([r[0] for r in found], np.int64)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of all vectors to all centroids, as exact integers."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT and x.shape[1] <= 64:
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the nearest centroid, its squared distance, and how much farther the second one is, at least."""
    d = distances(x, centroids)
    best, at = d.argmin(axis=1), np.arange(len(x))  # the first of equal ones
    first = d[at, best].copy()
    if d.shape[1] == 1:
        return best, first, np.full(len(x), np.inf)
    d[at, best] = np.iinfo(np.int64).max
    u, second = np.sqrt(first.astype(np.float64)), np.sqrt(d.min(axis=1).astype(np.float64))
    return best, first, second - u - 1e-9 * (1 + second + u)


class Heaps:
    """Positions of a block's vectors in one binary heap for each cluster, ordered by key."""

    def __init__(self, sizes: np.ndarray, keys: np.ndarray, at: np.ndarray):
        self.sizes, self.keys, self.at = sizes, keys, at
        self.begin = np.cumsum(sizes) - sizes
        self.open: dict[int, list[tuple[float, int]]] = {}

    def of(self, cluster: int) -> list[tuple[float, int]]:
        """The heap of a cluster, to be changed; heaps that no round touches stay arrays."""
        if cluster not in self.open:
            part = slice(self.begin[cluster], self.begin[cluster] + self.sizes[cluster])
            self.open[cluster] = list(zip(self.keys[part].tolist(), self.at[part].tolist()))
        return self.open[cluster]

    def expired(self, drift: np.ndarray) -> list[tuple[int, int]]:
        """Pops (position, cluster) of all vectors whose key is not above the drift of their cluster."""
        out = []
        for j in np.flatnonzero(self.sizes).tolist():
            if self.keys[self.begin[j]] <= drift[j]:
                heap = self.of(j)
                while heap and heap[0][0] <= drift[j]:
                    out.append((heapq.heappop(heap)[1], j))
        return out

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes, keys, at = self.sizes.copy(), [], []
        for j in range(len(sizes)):
            part = slice(self.begin[j], self.begin[j] + self.sizes[j])
            if j in self.open:
                sizes[j] = len(self.open[j])
                keys.append(np.asarray([e[0] for e in self.open[j]], np.float64))
                at.append(np.asarray([e[1] for e in self.open[j]], np.int32))
            else:
                keys.append(self.keys[part])
                at.append(self.at[part])
        return sizes, np.concatenate(keys), np.concatenate(at)

    def clusters(self) -> np.ndarray:
        """The cluster of each position, of heaps that are not open."""
        out = np.empty(len(self.at), np.int64)
        out[self.at] = np.repeat(np.arange(len(self.sizes)), self.sizes)
        return out


def _row(ids: list, x: bytes, heaps: Heaps, change: np.ndarray, scanned: int) -> pa.RecordBatch:
    sizes, keys, at = heaps.arrays()
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((ids, x, sizes, keys, at, change.ravel(), scanned), _STATE)], schema=_STATE)


def _changes(x: np.ndarray, to: np.ndarray, away: np.ndarray | None, k: int) -> np.ndarray:
    """For each cluster, the components and the number of vectors it gains, less those it loses."""
    out, with_count = np.zeros((k, x.shape[1] + 1), np.int64), np.column_stack([x, np.ones(len(x), np.int64)])
    np.add.at(out, to, with_count)
    if away is not None:
        np.subtract.at(out, away, with_count)
    return out


def _start(rows: DataFrame, centroids: np.ndarray, block: int) -> DataFrame:
    """Blocks of vectors, each compared with all centroids."""
    k, size = centroids.shape

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def state(ids: list, x: np.ndarray) -> pa.RecordBatch:
            best, _, gap = nearest(x, centroids)
            heaps = Heaps(np.zeros(k, np.int32), np.zeros(0), np.zeros(0, np.int32))
            for j in range(k):
                mine = np.flatnonzero(best == j)
                heaps.open[j] = list(zip(gap[mine].tolist(), mine.tolist()))
                heapq.heapify(heaps.open[j])
            return _row(ids, x.astype("<i4").tobytes(), heaps, _changes(x, best, None, k), len(x))

        ids, parts, n = [], [], 0
        for b in batches:
            keys, x = b.column(0).to_pylist(), b.column(1).flatten().to_numpy().astype(np.int64).reshape(b.num_rows, size)
            ids, parts, n = ids + keys, [*parts, x], n + len(keys)
            if n >= block:
                x = np.concatenate(parts)
                full = n - n % block
                for lo in range(0, full, block):
                    yield state(ids[lo : lo + block], x[lo : lo + block])
                ids, parts, n = ids[full:], [x[full:]], n - full
        if n:
            yield state(ids, np.concatenate(parts))

    return rows.select("vec_id", "x").mapInArrow(make, _STATE_DDL)


def _vectors(block: dict, size: int) -> np.ndarray:
    return np.frombuffer(block["x"], "<i4").astype(np.int64).reshape(-1, size)


def _heaps(block: dict) -> Heaps:
    return Heaps(np.asarray(block["sizes"], np.int32), np.asarray(block["keys"], np.float64), np.asarray(block["at"], np.int32))


def _again(state: DataFrame, centroids: np.ndarray, drift: np.ndarray) -> DataFrame:
    """The state after the expired vectors were compared with the centroids as they are now."""
    k, size = centroids.shape

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                block = b.slice(i, 1).to_pylist()[0]
                heaps = _heaps(block)
                popped = heaps.expired(drift)
                change = np.zeros((k, size + 1), np.int64)
                if popped:
                    at, old = np.asarray(popped).T
                    x = _vectors(block, size)[at]
                    best, _, gap = nearest(x, centroids)
                    for key, where, j in zip((gap + drift[best]).tolist(), at.tolist(), best.tolist()):
                        heapq.heappush(heaps.of(j), (key, where))
                    moved = best != old
                    change = _changes(x[moved], best[moved], old[moved], k)
                yield _row(block["vec_id"], block["x"], heaps, change, len(popped))

    return state.select(*_STATE.names).mapInArrow(step, _STATE_DDL)


def _total(state: DataFrame, k: int, size: int) -> list[list[int]]:
    """The changes of all blocks, added up: k rows of size + 1 integers."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * (size + 1), np.int64)
        for b in batches:
            total += b.column(0).flatten().to_numpy().reshape(b.num_rows, -1).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total)], names=["at", "n"])

    sums = state.select("change").mapInArrow(add, "at long, n long").groupBy("at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
    flat = [0] * (k * (size + 1))
    for at, n in sums.collect():
        flat[at] = int(n)
    return [flat[j * (size + 1) : (j + 1) * (size + 1)] for j in range(k)]


class Clustering:
    """Final centroids, and a row for each vector; ``scanned``: how many vectors each assignment compared."""

    def __init__(self, rows: DataFrame, centroids: np.ndarray, scanned: list[int]):
        self.rows, self.centroids, self.scanned = rows, centroids, scanned


def cluster(rows: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, block: int = BLOCK) -> Clustering:
    """``rounds`` rounds of assignment and update over ``usable`` rows, then a last assignment.

    The rows of the result: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.
    """
    spark = rows.sparkSession
    out_ddl = "vec_id long, cluster int, distance long"
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        empty = spark.createDataFrame([], f"{out_ddl}, cluster_inertia long, inertia long, centroid_sha256 string")
        return Clustering(empty, centroids, [])
    k, size = centroids.shape
    sums, drift, scanned = [[0] * (size + 1) for _ in range(k)], np.zeros(k), []
    state = written(_start(rows, centroids, block), "blocks")
    for i in range(rounds + 1):
        scanned.append(state.agg(F.sum("scanned")).head()[0])
        if i == rounds:
            break
        sums = [[a + b for a, b in zip(*pair)] for pair in zip(sums, _total(state, k, size))]
        new = np.asarray([[s // row[-1] for s in row[:-1]] if row[-1] else c.tolist() for row, c in zip(sums, centroids)], np.int64)
        moved = np.sqrt(((new - centroids) ** 2).sum(axis=1).astype(np.float64)) * (1 + 1e-9)
        others = np.asarray([np.delete(moved, j).max(initial=0.0) for j in range(k)])
        drift, centroids = (drift + moved + others) * (1 + 1e-12), new
        state, before = written(_again(state, centroids, drift), "blocks"), state
        discard(before)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                one = b.slice(i, 1)
                block_ = one.to_pylist()[0]
                x, best = _vectors(block_, size), _heaps(block_).clusters()
                yield pa.RecordBatch.from_arrays([one.column("vec_id").flatten(), pa.array(best.astype(np.int32)), pa.array(((x - centroids[best]) ** 2).sum(axis=1))], names=["vec_id", "cluster", "distance"])

    found = written(state.mapInArrow(rows_of, out_ddl), "clusters")
    discard(state)
    digest = {j: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for j, c in enumerate(centroids.tolist())}
    per = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect()  # a row for each cluster
    long_ = lambda n: n if n < 1 << 63 else None
    total = long_(sum(int(r.n) for r in per))
    facts = spark.createDataFrame([(r.cluster, long_(int(r.n)), total, digest[r.cluster]) for r in per], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return Clustering(out, centroids, scanned)


def sql(k: int = 40, rounds: int = 5, seed: int = 2, size: int = 64, scale: int = 256) -> str:
    """The same rows by plain Lloyd rounds in SQL: every vector is compared with every centroid in each of them."""
    steps = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor({scale} * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e::DOUBLE) AND abs(e::DOUBLE) < {LARGEST})) = {size}),
c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY h NULLS LAST, x) - 1)::INT AS j, x
  FROM (SELECT sha256('{seed}:' || vec_id) AS h, x FROM kept ORDER BY h NULLS LAST, x LIMIT {k}))"""
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT r, any_value(vec_id) AS vec_id, any_value(x) AS x, min(s).d AS d, min(s).j AS j FROM (
    SELECT r, vec_id, kept.x AS x, {{'d': list_sum(list_transform(list_zip(kept.x, c{i}.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, 'j': c{i}.j}} AS s
    FROM kept CROSS JOIN c{i}) GROUP BY r)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c{i}.j AS j, coalesce(m.x, c{i}.x) AS x FROM c{i} LEFT JOIN (
    SELECT j, list(v ORDER BY pos) AS x FROM (
      SELECT j, pos, ((sum(v) - (((sum(v) % count(*)) + count(*)) % count(*))) // count(*))::BIGINT AS v
      FROM (SELECT j, unnest(x) AS v, unnest(range({size})) AS pos FROM a{i}) GROUP BY j, pos) GROUP BY j) m ON m.j = c{i}.j)""")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, a.j AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.j))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.j = c.j"""
