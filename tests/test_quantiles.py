"""Exact percentiles where values leave gaps, repeat, or are not finite."""

import random

import numpy as np
import pytest

from sluice.operators import profile

INF, NAN = float("inf"), float("nan")
P = [0.0, 0.05, 0.25, 0.5, 0.7, 0.75, 0.95, 1.0]


def by_hand(values, p):
    x = sorted((v for v in values if v is not None and v == v)) + [v for v in values if v is not None and v != v]
    if not x:
        return None
    at = p * (len(x) - 1)
    a, b = x[int(at)], x[min(len(x) - 1, int(at) + 1)]
    return a if a == b or at == int(at) else a + (b - a) * (at - int(at))


rng = random.Random(7)
CASES = {
    "gap": [float(v) for v in range(300, 1000)] + [5000.0] * 300,
    "infinite": [float(v) for v in range(300, 1000)] + [INF] * 300,
    "nan": [float(v) for v in range(300, 1000)] + [NAN] * 300,
    "both ends": [-INF] * 60 + [float(v) for v in range(400)] + [INF] * 30 + [NAN] * 10,
    "ties": [1.0] * 500 + [2.0] * 300 + [float(v) for v in range(200)],
    "powers": [2.0**k for k in range(-400, 400)],
    "huge": [-1.7e308, -1e308, 0.0, 1e308, 1.7e308] * 40 + [float(v) for v in range(200)],
    "tiny": [5e-324 * k for k in range(200)],
    "random": [rng.gauss(0, 1) for _ in range(700)] + [None] * 40,
    "only nan": [NAN] * 5,
    "only infinite": [INF, -INF],
    "nulls": [None, None],
    "one": [3.5],
}


@pytest.mark.parametrize("few", [2, 50, 20_000])
def test_against_sorting(spark, monkeypatch, few):
    monkeypatch.setattr(profile, "FEW", few)
    n = max(map(len, CASES.values()))
    names = [c.replace(" ", "_") for c in CASES]
    rows = [[v[i] if i < len(v) else None for v in CASES.values()] for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names))
    got = profile.quantiles(df, names, P)
    for name, values in zip(names, CASES.values()):
        for p, x in zip(P, got[name]):
            y = by_hand(values, p)
            assert (x is None) == (y is None) and (y is None or np.array_equal([x], [y], equal_nan=True) or abs(x - y) <= 1e-12 * abs(y)), (name, p, x, y)


def test_no_rows(spark):
    df = spark.createDataFrame([], "a double, b int")
    assert profile.quantiles(df, ["a", "b"], [0.5]) == {"a": [None], "b": [None]}
    assert profile.quantiles(df, [], [0.5]) == {}
