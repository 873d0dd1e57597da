"""Correlated features: groups, which one stands for a group, how names relate, and what to do about a pair."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from . import profile


def groups(pairs: list[tuple[str, str]]) -> dict[str, str]:
    """column -> first column of its group. Works on names, of which there are as many as columns."""
    head: dict[str, str] = {}

    def find(c: str) -> str:
        while head.setdefault(c, c) != c:
            c = head[c]
        return c

    for a, b in pairs:
        x, y = find(a), find(b)
        head[max(x, y)] = min(x, y)
    return {c: find(c) for c in list(head)}


def relation(a: Column, b: Column) -> Column:
    """How two features are related by name: what a feature made of both would mean."""
    la, lb = F.lower(a), F.lower(b)
    both = lambda x, y: (la.contains(x) & lb.contains(y)) | (lb.contains(x) & la.contains(y))
    prefix = lambda c: F.when(c.contains("_"), F.split_part(c, F.lit("_"), F.lit(1))).otherwise(F.left(c, F.lit(4)))
    return (
        F.when(both("year", "year"), "temporal_difference")
        .when(both("area", "cars"), "area_per_unit")
        .when(both("area", "frontage"), "area_ratio")
        .when(both("room", "room") | both("bed", "room"), "count_difference")
        .when((prefix(la) == prefix(lb)) & (F.length(prefix(la)) > 2), "same_category")
        .otherwise("none")
    )


def representatives(df: DataFrame, columns: Sequence[str], limit: float = 0.9, target: str | None = None) -> DataFrame:
    """column, group, representative, group_size: columns linked by |r| >= limit; the one nearest the target (or of
    greatest variation) stands for its group. Nulls count as the median."""
    filled = df.withColumns({c: F.col(c).cast("double") for c in columns})
    medians = {c: q[0] for c, q in profile.quantiles(filled, columns, [0.5]).items()}
    filled = filled.withColumns({c: F.coalesce(F.col(c), F.lit(m)) for c, m in medians.items() if m is not None})
    linked = [(r["f1"], r["f2"]) for r in profile.correlations(filled, columns).where(F.abs("r") >= limit).collect()]  # pairs of columns
    head = groups(linked)
    if not head:
        return df.sparkSession.createDataFrame([], "`column` string, `group` string, representative string, group_size int")
    names = sorted(head)
    measure = (lambda c: F.abs(F.corr(c, target))) if target else (lambda c: F.abs(F.stddev_samp(c) / F.nullif(F.avg(c), F.lit(0.0))))
    score = filled.agg(*[F.coalesce(measure(c), F.lit(0.0)).alias(c) for c in names]).head().asDict()
    by: dict[str, list[str]] = defaultdict(list)
    for c in names:
        by[head[c]].append(c)
    rows = [(c, head[c], max(sorted(by[head[c]]), key=lambda x: score[x]), len(by[head[c]])) for c in names]
    return df.sparkSession.createDataFrame(rows, "`column` string, `group` string, representative string, group_size int")


def pair_report(df: DataFrame, columns: Sequence[str], limit: float = 0.9) -> DataFrame:
    """f1, f2, r, relation of every strongly correlated pair."""
    return profile.correlations(df, columns).where(F.abs("r") >= limit).withColumn("relation", relation(F.col("f1"), F.col("f2")))


def pair_actions(names: Sequence[str], pairs: DataFrame, family: str, target: str | None = None) -> list[tuple[str, str, str, str]]:
    """(action, column, first, second) for correlated pairs of the columns ``names``: difference, ratio or drop.

    linear: a difference or ratio for related pairs, and the second of a pair of one base name goes above 0.98;
    distance: it goes above 0.95; tree: nothing; other: the second goes. The target and the last column of a base
    name stay.
    """
    actions: list[tuple[str, str, str, str]] = []
    left = list(names)
    rows = sorted(((r["f1"], r["f2"], r["r"], r["relation"]) for r in pairs.collect()), key=lambda p: (-abs(p[2]), p[0], p[1]))  # pairs of columns
    for a, b, r, kind in rows:
        if family == "tree" or a not in left or b not in left:
            continue
        same = _base(a) == _base(b)
        new = {"temporal_difference": ("difference", f"{a}_minus_{b}"), "count_difference": ("difference", f"{a}_minus_{b}"), "area_per_unit": ("ratio", f"{a}_per_{b}"), "area_ratio": ("ratio", f"{a}_per_{b}")}.get(kind)
        if family == "linear" and new:
            left.append(new[1])
            actions.append((*new, a, b))
        drop = {"linear": same and abs(r) > 0.98, "distance": same and abs(r) > 0.95}.get(family, True)
        others = [c for c in left if c != b and _base(c) == _base(b)]
        if drop and b != target and (others or not same):
            left.remove(b)
            actions.append(("drop", b, "", ""))
    return actions


def reduce_features(df: DataFrame, pairs: DataFrame, family: str, target: str | None = None) -> tuple[DataFrame, list[tuple[str, str]]]:
    """``df`` after the ``pair_actions`` for its columns, and what they were (action, column)."""
    actions = pair_actions(df.columns, pairs, family, target)
    make = {"difference": lambda a, b: F.col(a) - F.col(b), "ratio": lambda a, b: scalar.ratio(F.col(a), F.col(b))}
    new = {c: make[what](a, b) for what, c, a, b in actions if what != "drop"}
    return df.withColumns(new).drop(*[c for what, c, _, _ in actions if what == "drop"]), [(what, c) for what, c, _, _ in actions]


def _base(name: str) -> str:
    low = name.lower()
    for s in scalar.SUFFIXES:
        if low.endswith(f"_{s}"):
            return low[: -len(s) - 1]
    return low


def relation_table(spark: SparkSession, pairs: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(pairs, "f1 string, f2 string").withColumn("relation", relation(F.col("f1"), F.col("f2")))
