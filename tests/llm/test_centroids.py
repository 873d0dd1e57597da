"""Operator 11 against Lloyd's rounds by hand."""

import hashlib
import math
import random

import numpy as np

from sluice.llm import centroids


def by_hand(rows, k, rounds, size=64):
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == size and all(e is not None and math.isfinite(e) and abs(e) < centroids.LARGEST for e in v):
            kept.append((vec_id, [math.floor(256 * e) for e in v]))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    cs = [x for _, x in order[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        to = [near(x)[1] for _, x in kept]
        mine = [[x for (_, x), j in zip(kept, to) if j == i] for i in range(len(cs))]
        cs = [[sum(col) // len(m) for col in zip(*m)] if m else c for m, c in zip(mine, cs)]
    found = [near(x) for _, x in kept]
    total = sum(d for d, _ in found)
    return sorted(
        (str(i), j, d, sum(e for e, i2 in found if i2 == j), total, hashlib.sha256(",".join(map(str, cs[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, found)
    )


def run(spark, rows, **kw):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = centroids.cluster(centroids.usable(frame), **kw)
    return sorted((str(r[0]), *r[1:]) for r in out.rows.collect()), out


def test_against_hand(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(i % 5, 0.6) for _ in range(64)]) for i in range(160)]
    rows += [(200, None), (201, [1.0] * 63), (202, [float("nan")] * 64), (203, [None] + [1.0] * 63), (204, [float("inf")] * 64), (205, [1e30] + [0.0] * 63), (206, [])]
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1]), (300, [0.0] * 64), (301, [300_000.5] * 64), (302, [-300_000.5] * 64)]
    for block in (7, 4096):
        got, out = run(spark, rows, k=9, rounds=4, block=block)
        assert got == by_hand(rows, 9, 4)
        assert len(out.scanned) == 5


def test_few_rows_and_ties(spark):
    same = [(i, [1.0] * 64) for i in range(6)]
    for rows, k in ((same, 3), (same[:2], 40), (same[:1], 40), ([], 40), ([(1, None)], 40), ([(i, [float(i % 2)] * 64) for i in range(8)], 5)):
        assert run(spark, rows, k=k)[0] == by_hand(rows, k, 5)


def test_only_expired_vectors_are_compared(spark):
    """Later assignments compare a part of the vectors only."""
    rng = random.Random(2)
    rows = [(i, [rng.gauss(40 * (i % 4), 1) for _ in range(64)]) for i in range(400)]
    got, out = run(spark, rows, k=4, rounds=5, block=64)
    assert got == by_hand(rows, 4, 5)
    assert out.scanned[0] == 400 and out.scanned[-1] < 200 and sum(out.scanned[1:]) < 1200, out.scanned


def test_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()]
    got, out = run(spark, rows, k=40, rounds=5, block=128)
    x = np.floor(256 * np.asarray([v for _, v in rows], np.float64)).astype(np.int64)
    d = np.stack([((x - c) ** 2).sum(axis=1) for c in out.centroids], axis=1)
    assert got == sorted((str(i), int(j), int(m), *r[3:]) for (i, _), j, m, r in zip(rows, d.argmin(axis=1), d.min(axis=1), sorted(got, key=lambda r: int(r[0]))))


def test_clashing_names(spark):
    rows = [(i, [float(i % 3)] * 64) for i in range(9)]
    plain = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    wide = plain.selectExpr("*", "'k' AS x", "'k' AS v", "'k' AS cluster", "'k' AS distance", "'k' AS sizes")
    get = lambda d: sorted(map(str, centroids.cluster(centroids.usable(d), k=3).rows.collect()))
    assert get(plain) == get(wide)
