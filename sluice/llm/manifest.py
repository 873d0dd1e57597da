"""Operator 12: a Merkle manifest of a dataset, by exchange of subtrees.

Rows become leaves; the leaves of a group, in order of their key, become a tree in which every two consecutive nodes are
hashed into one (the last one of a level alone, where it has no neighbour), and the groups' roots become one more tree.

A level is far too long for one task, so a tree is cut into superblocks: ``1 << height`` consecutive nodes, which one
task can reduce. Superblocks are reduced to their roots, those are the nodes of the next, so much shorter table, and so
on up to the root. On the way down the nodes of a table are cogrouped, by superblock, with what lies outside of it: the
siblings on the path from the superblock to the root. That is all that a task needs to finish the reduction inside,
join both parts of each proof, and fold any leaf up to the root.

No group is hashed to one task: leaves are sorted by range, with their place in the input as the last key, so that
repeated rows can be split; numbered within their partition; and shifted by the counts of the partitions before
(a row for each partition and group).

Cases: a null field is ``-``; a null group comes first and is a group like any other; null keys come first in their
group; rows that share a key are ordered by their leaf; equal rows are leaves of their own; a single leaf is its group's
root, a single group's root is the root; an empty table gives an empty result; other columns are ignored; fields that
``documents`` lacks are an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A superblock has 1 << HEIGHT nodes.
HEIGHT = 10


def leaf_of(fields: Sequence[Column]) -> Column:
    """sha256 (hex) of the fields, each ``-`` if null, else its length in bytes, ``:`` and itself."""

    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(part, fields)).cast("binary"), 256)


def leaves(docs: DataFrame, altered: dict[str, Column] | None = None, fields: Sequence[str] = FIELDS, group: str = "lang", key: str = "doc_id") -> DataFrame:
    """grp (never null, in the order of groups), key, leaf and, where a row is altered, its leaf with those values."""
    name = F.col(group).cast("string")
    plain = [F.col(f) for f in fields]
    leaf, other = leaf_of(plain), leaf_of([(altered or {}).get(f, F.col(f)) for f in fields])
    return docs.select(
        F.coalesce(F.concat(F.lit("="), name), F.lit("-")).alias("grp"),
        F.col(key).cast("long").alias("key"),
        F.unhex(leaf).alias("node"),
        (F.when(other != leaf, F.unhex(other)) if altered else F.lit(None).cast("binary")).alias("altered"),
        F.monotonically_increasing_id().alias("place"),
    )


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` (grp, key, node, altered, place) with rank (from 0) and n, the number of leaves, in their group."""
    order = [F.col("grp"), F.col("key").asc_nulls_first(), F.col("node"), F.col("place")]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "grp string, key long, node binary, altered binary, part int, nth long"

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, seen = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            names = b.column("grp").to_numpy(zero_copy_only=False)
            new = np.r_[names[0] != last, names[1:] != names[:-1]]
            at = np.arange(b.num_rows)
            start = np.maximum.accumulate(np.where(new, at, -1))  # -1: goes on from the batch before
            nth = np.where(start < 0, seen + at, at - start)
            last, seen = names[-1], int(nth[-1]) + 1
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("grp", "key", "node", "altered")], pa.array(np.full(b.num_rows, part, np.int32)), pa.array(nth)], names=["grp", "key", "node", "altered", "part", "nth"])

    cut = written(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(number, schema), "leaves-sorted")
    by_part = cut.groupBy("grp", "part").agg(F.count("*").alias("m"))  # a row for each partition and group
    whole = Window.partitionBy("grp").orderBy("part")
    before = by_part.select("grp", "part", (F.sum("m").over(whole) - F.col("m")).alias("before"), F.sum("m").over(Window.partitionBy("grp")).alias("n"))
    return cut.join(before, ["grp", "part"]).select("grp", "key", "node", "altered", (F.col("nth") + F.col("before")).alias("rank"), "n")


# Inside a superblock. Nodes are hex digests as bytes.


def joined(nodes: Sequence[bytes]) -> bytes:
    return hashlib.sha256(b"".join(nodes)).hexdigest().encode()


def levels(nodes: list[bytes], height: int) -> list[list[bytes]]:
    """The nodes and the ``height`` levels over them."""
    out = [nodes]
    for _ in range(height):
        nodes = [joined(nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        out.append(nodes)
    return out


def rounds_left(n: int, height: int) -> int:
    """Levels over a superblock of a tree of ``n`` nodes: all of them if it has only one."""
    return min(height, (n - 1).bit_length())


def path_of(tree: list[list[bytes]], at: int) -> bytes:
    """The siblings from node ``at`` of the lowest level to the top one: where each stands (L, R or - for none), and its digest."""
    out = []
    for level in tree[:-1]:
        other = at ^ 1
        out.append((b"R" if other > at else b"L") + level[other] if other < len(level) else b"-")
        at >>= 1
    return b"".join(out)


def fold(node: bytes, path: bytes) -> tuple[bytes, bytes]:
    """The root that ``node`` and its siblings give, and the digest of the siblings."""
    at, siblings = 0, []
    while at < len(path):
        side, other = path[at : at + 1], path[at + 1 : at + 65]
        if side == b"-":
            node, at = joined([node]), at + 1
            continue
        node, at = joined([other, node] if side == b"L" else [node, other]), at + 65
        siblings.append(other)
    return node, joined(siblings)


def _hex(column: pd.Series) -> list[bytes]:
    return [bytes(v).hex().encode() for v in column]


def _block(height: int) -> Column:
    return F.shiftright("rank", height).alias("block")


def _parents(nodes: DataFrame, height: int) -> DataFrame:
    """The roots of the superblocks of ``nodes`` (grp, rank, node, n)."""

    def reduce(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        n = int(rows["n"].iloc[0])
        top = levels(_hex(rows["node"]), rounds_left(n, height))[-1]
        return pd.DataFrame({"grp": [key[0]], "rank": [key[1]], "node": [bytes.fromhex(top[0].decode())], "n": [-(-n >> height)]})

    of = nodes.select("grp", "rank", "node", "n", _block(height))
    return of.groupBy("grp", "block").applyInPandas(reduce, "grp string, rank long, node binary, n long")


def _up(nodes: DataFrame, height: int) -> list[DataFrame]:
    """``nodes`` and the tables of superblock roots over them, up to one node for each group."""
    tables = [nodes]
    while True:
        tables.append(written(_parents(tables[-1], height), "subtrees"))
        most = tables[-1].agg(F.max("n")).head()[0]
        if most is None or most == 1:
            return tables


def _down(nodes: DataFrame, outer: DataFrame, height: int, finish: Callable, ddl: str) -> DataFrame:
    """Cogroups nodes by superblock with ``outer`` (grp, rank of the superblock, path, subroot, root); a row for each node by ``finish``."""

    def exchange(key: tuple, rows: pd.DataFrame, out: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank").reset_index(drop=True)
        tree = levels(_hex(rows["node"]), rounds_left(int(rows["n"].iloc[0]), height))
        above = out.iloc[0]
        rest = bytes(above["path"])
        return finish(rows, [path_of(tree, i) + rest for i in range(len(rows))], above)

    left = nodes.withColumn("block", _block(height))
    right = outer.select("grp", F.col("rank").alias("block"), "path", "subroot", "root")
    return left.groupBy("grp", "block").cogroup(right.groupBy("grp", "block")).applyInPandas(exchange, ddl)


_OUTER = "grp string, rank long, path binary, subroot string, root string"


def _inner(rows: pd.DataFrame, paths: list[bytes], above: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"grp": rows["grp"], "rank": rows["rank"], "path": paths, "subroot": above["subroot"], "root": above["root"]})


def _descend(tables: list[DataFrame], outer: DataFrame, height: int) -> DataFrame:
    """``outer`` of the lowest table's superblocks, from that of the top table's single nodes."""
    for nodes in reversed(tables[1:-1]):
        outer = written(_down(nodes, outer, height, _inner, _OUTER), "outer")
    return outer


_PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _proof(rows: pd.DataFrame, paths: list[bytes], above: pd.Series) -> pd.DataFrame:
    leaf = _hex(rows["node"])
    told = [own if other is None else bytes(other).hex().encode() for own, other in zip(leaf, rows["altered"])]
    folded = [tuple(x.decode() for x in fold(node, path)) for node, path in zip(told, paths)]
    out = {"doc_id": rows["key"], "leaf": [x.decode() for x in leaf], "subroot": above["subroot"], "root": above["root"], "proof_sha256": [p for _, p in folded], "folded_root": [r for r, _ in folded]}
    return pd.DataFrame(out).assign(verified=lambda d: d["folded_root"] == d["root"])


def proofs(docs: DataFrame, altered: dict[str, Column] | None = None, fields: Sequence[str] = FIELDS, group: str = "lang", key: str = "doc_id", height: int = HEIGHT) -> DataFrame:
    """A row for each row: its leaf, its group's root, the root, the digest of its proof, and what its proof says of
    the row as ``altered`` has it (expressions for fields; rows that they leave as they are fold to the root).
    """
    rows = written(ranked(written(leaves(docs, altered, fields, group, key), "leaves")), "leaves-ranked")
    trees = _up(rows.select("grp", "rank", "node", "n"), height)
    # the groups' roots are the nodes of the last tree: a row for each group
    subroots = trees[-1].select(F.lit("").alias("grp"), (F.row_number().over(Window.orderBy("grp")) - 1).cast("long").alias("rank"), "node", F.col("grp").alias("of"))
    subroots = written(subroots.crossJoin(F.broadcast(subroots.agg(F.count("*").alias("n")))), "subroots")
    top = _up(subroots.select("grp", "rank", "node", "n"), height)
    root = top[-1].select("grp", "rank", F.lit(b"").alias("path"), F.lit(None).cast("string").alias("subroot"), F.lower(F.hex("node")).alias("root"))
    over = _down(subroots.select("grp", "rank", "node", "n"), _descend(top, root, height), height, _inner, _OUTER)
    named = over.drop("grp", "subroot").join(subroots.select("rank", "of", F.lower(F.hex("node")).alias("subroot")), "rank")
    outer = written(named.select(F.col("of").alias("grp"), F.lit(0).cast("long").alias("rank"), "path", "subroot", "root"), "outer")
    # the top table of each group has one node, number 0, whose siblings these are; so has a group of one superblock
    return _down(rows, _descend(trees, outer, height), height, _proof, _PROOF)


def sql() -> str:
    """The contract's rows in SQL: levels by recursion, then a fold of every row's leaf."""
    field = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
    leaf = lambda n: "sha256(" + " || ".join(field.format(n if f == "n_chars" else f) for f in FIELDS) + ")"
    return f"""WITH RECURSIVE
bytes AS (
  SELECT doc_id, source, lang, n_chars, text,
    xor(list_reduce(flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1])),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, 4294967295::BIGINT), 4294967295::BIGINT) AS crc
  FROM documents),
leaf AS MATERIALIZED (
  SELECT doc_id, coalesce('=' || lang, '-') AS grp, {leaf("n_chars")} AS h,
    CASE WHEN crc % 7 = 0 THEN {leaf("(n_chars + 1)")} ELSE {leaf("n_chars")} END AS told FROM bytes),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, h) - 1 AS rank FROM leaf),
tree AS (
  SELECT grp, 0 AS level, rank, h, count(*) OVER (PARTITION BY grp) AS n FROM placed
  UNION ALL
  SELECT grp, any_value(level) + 1, rank // 2, sha256(string_agg(h, '' ORDER BY rank)), (any_value(n) + 1) // 2 FROM tree WHERE n > 1 GROUP BY grp, rank // 2),
nodes AS MATERIALIZED (SELECT * FROM tree),
subroots AS MATERIALIZED (SELECT grp, h, row_number() OVER (ORDER BY grp) - 1 AS place FROM nodes WHERE n = 1),
upper_tree AS (
  SELECT 0 AS level, place AS rank, h, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, rank // 2, sha256(string_agg(h, '' ORDER BY rank)), (any_value(n) + 1) // 2 FROM upper_tree WHERE n > 1 GROUP BY rank // 2),
upper_nodes AS MATERIALIZED (SELECT * FROM upper_tree),
steps AS (
  SELECT p.doc_id, p.h, p.rank, p.grp, t.level AS step, (p.rank >> t.level) & 1 AS side, s.h AS sibling
  FROM placed p JOIN (SELECT DISTINCT grp, level FROM nodes WHERE n > 1) t ON t.grp = p.grp
  LEFT JOIN nodes s ON s.grp = p.grp AND s.level = t.level AND s.rank = xor(p.rank >> t.level, 1)
  UNION ALL
  SELECT p.doc_id, p.h, p.rank, p.grp, 1000 + t.level, (r.place >> t.level) & 1, s.h
  FROM placed p JOIN subroots r ON r.grp = p.grp CROSS JOIN (SELECT DISTINCT level FROM upper_nodes WHERE n > 1) t
  LEFT JOIN upper_nodes s ON s.level = t.level AND s.rank = xor(r.place >> t.level, 1)),
paths AS (SELECT grp, rank, list({{'side': side, 'sibling': sibling}} ORDER BY step) AS path FROM steps GROUP BY grp, rank),
folded AS (
  SELECT p.doc_id, p.h AS leaf, p.grp, coalesce(path, []) AS path,
    list_reduce(list_transform(coalesce(path, []), lambda e: {{'side': e.side::BIGINT, 'h': e.sibling}}),
      lambda c, e: {{'side': 0::BIGINT, 'h': sha256(CASE WHEN e.h IS NULL THEN c.h WHEN e.side = 1 THEN e.h || c.h ELSE c.h || e.h END)}},
      {{'side': 0::BIGINT, 'h': p.told}}).h AS folded_root
  FROM placed p LEFT JOIN paths USING (grp, rank))
SELECT doc_id, leaf, r.h AS subroot, u.h AS root, sha256(array_to_string(list_transform(path, lambda e: coalesce(e.sibling, '')), '')) AS proof_sha256,
  folded_root, folded_root = u.h AS verified
FROM folded f JOIN subroots r ON r.grp = f.grp CROSS JOIN (SELECT h FROM upper_nodes WHERE n = 1) u"""
