"""Operator 10: documents packed into windows of fixed capacity by best-fit decreasing.

Documents are encoded and cut: full windows first, then what is left. Windows of one remaining capacity are
alike, so the placing works on the counts of pieces by length, at most one number for each length: longest
first, each length goes to the tightest open window that has room, found in a segment tree indexed by
remaining capacity, and fills it while it fits. The outcome is that of placing the pieces one by one. It is
a list of runs (ranks of pieces of one length -> windows); Spark ranks the pieces of a length and looks
each one's place up. Neither documents nor pieces pass through the driver.

Cases: a null text is empty, and leaves a piece with the end id alone; rows that share a doc_id are packed
each for itself; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, written
from .tokens import word_ids

CAPACITY = 4096
_PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())])


class CapacityTree:
    """Segment tree over remaining capacities: how many groups of windows are open at each."""

    def __init__(self, capacity: int):
        self.size = 1 << (capacity + 1).bit_length()
        self.open = [0] * (2 * self.size)

    def add(self, at: int, n: int) -> None:
        at += self.size
        while at:
            self.open[at] += n
            at >>= 1

    def tightest(self, least: int) -> int:
        """The smallest remaining capacity of at least ``least`` at which a window is open, or -1."""
        at = least + self.size
        while not self.open[at]:
            while at & 1:  # a right child: everything below this parent has been seen
                at >>= 1
            if not at:
                return -1
            at += 1
        while at < self.size:
            at = 2 * at if self.open[2 * at] else 2 * at + 1
        return at - self.size


def best_fit_runs(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best-fit decreasing over counts by length.

    Rows (length, first rank, pieces, first window, pieces in each window, offset of the first piece there).
    """
    tree, groups, runs, windows = CapacityTree(capacity), defaultdict(list), [], 0

    def push(room: int, first: int, n: int) -> None:
        if n and room:
            groups[room].append((first, n))
            tree.add(room, 1)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room < 0:
                room, each = capacity, capacity // length
                first, n = windows, -(-left // each)
                windows += n
            else:
                each = room // length
                first, n = groups[room].pop()
                tree.add(room, -1)
            placed = min(left, n * each)
            full, rest = divmod(placed, each)
            runs.append((length, rank, placed, first, each, capacity - room))
            push(room - each * length, first, full)
            if rest:
                push(room - rest * length, first + full, 1)
            push(room, first + full + bool(rest), n - full - bool(rest))
            rank, left = rank + placed, left - placed
    return np.asarray(runs, np.int64).reshape(-1, 6)


def cut(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document: full windows, then the rest. ``nth`` counts the pieces of a length within ``part``."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen, ids = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), word_ids(tokenizer)
        for batch in batches:
            out: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                all_ids = np.append(np.frombuffer(ids.encode(text.as_py()), ids.dtype), ids.dtype.type(end_id)).astype("<u4")
                for start in range(0, all_ids.size, capacity):
                    piece = all_ids[start : start + capacity]
                    out.append((key, start, piece.size, zlib.crc32(piece.tobytes()), all_ids.size, part, seen[piece.size]))
                    seen[piece.size] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), _PIECE)] if out else [pa.array([], f.type) for f in _PIECE], schema=_PIECE)

    return rows.mapInArrow(pieces, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, nth long")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece."""
    cuts = written(cut(docs, tokenizer, end_id, capacity), "pieces")
    by_part = cuts.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = by_part.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    counts = {r[0]: r[1] for r in cuts.groupBy("length").count().collect()}  # at most ``capacity`` rows
    runs = best_fit_runs(counts, capacity)
    shift = np.int64(1) << np.int64(48)
    order = np.argsort(runs[:, 0] * shift + runs[:, 1])
    runs = runs[order]
    begin = runs[:, 0] * shift + runs[:, 1]
    kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    schema = pa.schema([*[_PIECE.field(n) for n in kept], ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            run = runs[np.searchsorted(begin, length * shift + rank, side="right") - 1]
            nth = rank - run[:, 1]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in kept], pa.array(run[:, 3] + nth // run[:, 4]), pa.array(run[:, 5] + nth % run[:, 4] * length)], schema=schema)

    ranked = cuts.join(earlier, ["length", "part"]).select(*kept, (F.col("nth") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
