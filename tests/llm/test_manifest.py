"""Operator 12 against trees by hand."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from sluice.llm import manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def siblings(levels, at):
    out = []
    for level in levels[:-1]:
        out.append((at & 1, level[at ^ 1] if at ^ 1 < len(level) else None))
        at >>= 1
    return out


def by_hand(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in langs:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {g: tree([leaf(r) for r in groups[g]]) for g in langs}
    top = tree([trees[g][-1][0] for g in langs]) if langs else None
    out = []
    for k, g in enumerate(langs):
        for i, r in enumerate(groups[g]):
            path = siblings(trees[g], i) + siblings(top, k)
            told = leaf((*r[:3], r[3] + 1, r[4])) if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else leaf(r)
            for side, other in path:
                told = h(told) if other is None else h(other, told) if side else h(told, other)
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], h(*(o for _, o in path if o)), told, told == top[-1][0]))
    return sorted(out, key=str)


def run(spark, rows, height, extra=()):
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    docs = docs.withColumns({c: F.lit("kept") for c in extra})
    tampers = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    found = manifest.proofs(docs, {"n_chars": F.col("n_chars") + F.when(tampers, 1).otherwise(0)}, height=height)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, found.collect()), key=str)


ROWS = [(i, "web", "en" if i % 3 else ("de", "é", None)[i % 9 // 3], i, f"text {i}") for i in range(75)]
ROWS += [(None, None, None, None, None), (None, None, None, None, None), (5, "web", "en", 5, "text 5"), (5, "web", "en", 5, "other"), (7, "a", "", 7, ""), (200, "x", "zz", None, "\x00é\U0001f600")]
ROWS += [(300 + i, "w", "zz", i, "x" * 100_000 if i == 2 else "y") for i in range(9)]


@pytest.mark.parametrize("height", [1, 3, 10])
def test_against_hand(spark, height):
    got = run(spark, ROWS, height)
    assert got == by_hand(ROWS)
    assert {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 8, 9, 17])
def test_small_trees(spark, n):
    rows = [(i, "s", "en", 1, str(i)) for i in range(n)]
    assert run(spark, rows, 2) == by_hand(rows)


def test_many_groups(spark):
    rows = [(i, "s", f"l{i % 23}", 1, str(i)) for i in range(60)]
    assert run(spark, rows, 1) == by_hand(rows)


def test_clashing_names(spark):
    rows = ROWS[:20]
    assert run(spark, rows, 2, ("grp", "key", "node", "altered", "place", "rank", "n", "leaf", "block", "path")) == by_hand(rows)


def test_fold_follows_the_path():
    nodes = [h(str(i)).encode() for i in range(11)]
    levels = manifest.levels(nodes, manifest.rounds_left(11, 10))
    assert len(levels[-1]) == 1
    for i in range(11):
        assert manifest.fold(nodes[i], manifest.path_of(levels, i))[0] == levels[-1][0]
