"""Operator 13: a quartile bucket digest of each document, and how like two digests are.

Every byte of a text starts a triplet: itself and the bytes ``STEP`` and twice ``STEP`` after it (zero bytes after the
end), which tell what a text says rather than its language, as neighbouring bytes do. Triplets are hashed into
``BUCKETS`` counters. A bucket is encoded in two bits, as the number of quartiles of all counters that it exceeds; the
length is encoded in steps of an eighth of a doubling. The difference of two digests adds up the distances of the codes
and, up to a limit, of the lengths; as both are bounded, likeness is one minus the share of the largest difference.

``against_edits`` compares each document with the next one, and with itself after half of it was overwritten by the next
one. Texts are shuffled once. Documents, in order of (doc_id, hash of the text), are cut into blocks of about equal
bytes: some documents, chosen by a hash with a chance in proportion to their bytes, start a block each, so the first
document of a block is known before any sorting, and is sent to the block before it as well. A block is then sorted,
and read as a stream of documents and their next ones.

Cases: a null text is empty; an empty text has no triplets, and a likeness of 1 to another empty one; rows equal in
doc_id and text are one document; null doc_ids come first; documents that share a doc_id are ordered by the hash of
their text; a single document is its own next one; an empty table gives an empty result; other columns are ignored, or
passed along by ``with_fingerprint``, whatever their names.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from .common import free_names, small_batches, written

BUCKETS, STEP = 512, 3
#: Multiplier of the hash; its upper 16 bits choose the bucket.
MULTIPLIER = 2654435761
#: Steps of length for a doubling; the difference of lengths counts ``LENGTH_WEIGHT`` a step, for ``LENGTH_STEPS`` at most.
PER_DOUBLING, LENGTH_STEPS, LENGTH_WEIGHT = 8, 24, 8
LARGEST = 3 * BUCKETS + LENGTH_STEPS * LENGTH_WEIGHT
#: Blocks for each shuffle partition, and at most in all (each is known to the driver by a key).
BLOCKS_EACH, MOST_BLOCKS = 16, 1 << 16


def bucket_counts(data: bytes) -> np.ndarray:
    """How many triplets fall into each bucket."""
    b = np.frombuffer(data + bytes(2 * STEP), np.uint8).astype(np.uint64)
    n = len(data)
    word = (b[:n] << np.uint64(16)) | (b[STEP : STEP + n] << np.uint64(8)) | b[2 * STEP :]
    bucket = ((word * np.uint64(MULTIPLIER)) & np.uint64(0xFFFFFFFF)) >> np.uint64(16)
    return np.bincount((bucket % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)


def length_code(n: int) -> int:
    """The number of eighths of doublings in n + 1, by exact integers."""
    return ((n + 1) ** PER_DOUBLING).bit_length() - 1


class Digest:
    """Length code and quartile codes of a text's bytes."""

    def __init__(self, data: bytes):
        counts = bucket_counts(data)
        quartiles = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
        self.length, self.codes = length_code(len(data)), (counts[:, None] > quartiles).sum(axis=1)

    def text(self) -> str:
        """Three hex digits of length, then one for every two buckets."""
        return f"{self.length:03x}" + "".join("0123456789abcdef"[v] for v in self.codes[::2] * 4 + self.codes[1::2])


def likeness(a: Digest, b: Digest) -> float:
    """1 for equal digests, 0 for the largest difference."""
    apart = int(np.abs(a.codes - b.codes).sum()) + LENGTH_WEIGHT * min(abs(a.length - b.length), LENGTH_STEPS)
    return 1.0 - apart / LARGEST


def digest_of(fingerprint: str) -> Digest:
    """The digest that a fingerprint was written from."""
    out = Digest.__new__(Digest)
    values = np.asarray([int(c, 16) for c in fingerprint[3:]])
    out.length, out.codes = int(fingerprint[:3], 16), np.stack([values // 4, values % 4], axis=1).ravel()
    return out


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of each text; a column of that name is replaced."""
    small_batches(docs.sparkSession)
    (source,) = free_names(docs, "source")
    rows = docs.drop(name).withColumn(source, docs[text].cast("string"))
    schema = StructType([*rows.drop(source).schema.fields]).add(name, StringType())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = [Digest((t.as_py() or "").encode()).text() for t in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(marks, pa.string())], names=[*b.schema.names[:-1], name])

    return rows.mapInArrow(add, schema)


_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)
_OUT_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _key(doc_id: int | None, h: int) -> tuple[bool, int, int]:
    return (doc_id is not None, doc_id or 0, h)


def _starts(rows: DataFrame) -> list[tuple[bool, int, int]]:
    """Keys of the documents that start a block, in order; the first of all documents is one."""
    sizes = written(rows.select("doc_id", "h", (F.octet_length("text") + 64).alias("n")), "sizes")
    low = F.min(F.struct(F.col("doc_id").isNotNull(), F.coalesce("doc_id", F.lit(0)), "h"))
    total, first = sizes.agg(F.sum("n"), low).head()
    if total is None:
        return []
    wanted = min(MOST_BLOCKS, BLOCKS_EACH * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    chosen = sizes.where(F.pmod(F.xxhash64(F.col("doc_id"), F.col("h")), F.lit(max(1, total // wanted))) < F.col("n"))
    return sorted({tuple(first), *(_key(*r) for r in chosen.select("doc_id", "h").distinct().collect())})


def against_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each document."""
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("h", F.xxhash64("text"))
    starts = _starts(rows)
    if not starts:
        return spark.createDataFrame([], _OUT_DDL)
    names = ["block", "guard", "doc_id", "h", "text"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each document of this task once, with its block, and the first of a block with the block before it too."""
        seen: set[tuple[bool, int, int]] = set()
        for b in batches:
            at, block, guard = [], [], []
            for i, key in enumerate(map(_key, b.column("doc_id").to_pylist(), b.column("h").to_pylist())):
                if key in seen:
                    continue
                seen.add(key)
                k = bisect_right(starts, key) - 1
                at.append(i)
                block.append(k)
                guard.append(False)
                if starts[k] == key:
                    at.append(i)
                    block.append((k - 1) % len(starts))
                    guard.append(True)
            took = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(guard, pa.bool_()), *[took.column(c) for c in names[2:]]], names=names)

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # (block, key, doc_id, text, digest) of a document whose next one is still to come
        for b in batches:
            out = []
            columns = [b.column(c).to_pylist() for c in names[:4]]
            for (block, guard, doc_id, h), value in zip(zip(*columns), b.column("text")):
                key = _key(doc_id, h)
                if guard and before is None or not guard and before is not None and before[1] == key:
                    continue  # a block that has been closed; another copy of the document
                own = value.as_py()
                now = (block, key, doc_id, own, Digest(own.encode()))
                if before is not None:
                    _, _, old_id, old, digest = before
                    half = len(old) // 2
                    edited = (old[: len(old) - half] + own[:half]).encode()
                    other = Digest(edited)
                    out.append((old_id, len(old), hashlib.sha256(edited).hexdigest(), digest.text(), other.text(), likeness(digest, other), likeness(digest, now[4])))
                before = None if guard else now
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _OUT)] if out else [pa.array([], f.type) for f in _OUT], schema=_OUT)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.mapInArrow(deal, "block int, guard boolean, doc_id long, h long, text string").repartition(parts, "block")
    return dealt.sortWithinPartitions("block", "guard", F.col("doc_id").asc_nulls_first(), "h").mapInArrow(follow, _OUT_DDL)


def sql() -> str:
    """The contract's rows in SQL."""
    return f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id NULLS FIRST) AS r, count(*) OVER () AS n FROM documents),
edits AS MATERIALIZED (
  SELECT d.r, d.doc_id, length(d.text) AS n_chars, d.text AS own, left(d.text, length(d.text) - length(d.text) // 2) || left(e.text, length(d.text) // 2) AS edited, e.r AS next
  FROM docs d JOIN docs e ON e.r = d.r % d.n + 1),
texts AS (SELECT r, 0 AS kind, hex(encode(own)) AS x FROM edits UNION ALL SELECT r, 1, hex(encode(edited)) FROM edits),
bytes AS MATERIALIZED (SELECT r, kind, length(x) // 2 AS n, list_transform(regexp_extract_all(x, '..'), lambda h: ('0x' || h)::BIGINT) AS b FROM texts),
words AS (
  SELECT r, kind, (t[1] << 16) | (coalesce(t[2], 0) << 8) | coalesce(t[3], 0) AS w
  FROM (SELECT r, kind, unnest(list_zip(b, b[{STEP + 1}:], b[{2 * STEP + 1}:])) AS t FROM bytes)),
counts AS (SELECT r, kind, (((w * {MULTIPLIER}) & 4294967295) >> 16) % {BUCKETS} AS bucket, count(*) AS n FROM words GROUP BY ALL),
grid AS (SELECT r, kind, bucket, coalesce(c.n, 0) AS n FROM (SELECT r, kind, unnest(range({BUCKETS})) AS bucket FROM texts) LEFT JOIN counts c USING (r, kind, bucket)),
quartiles AS (SELECT r, kind, list_sort(list(n)) AS s FROM grid GROUP BY r, kind),
codes AS MATERIALIZED (
  SELECT r, kind, list((g.n > s[{BUCKETS // 4}])::INT + (g.n > s[{BUCKETS // 2}])::INT + (g.n > s[{3 * BUCKETS // 4}])::INT ORDER BY bucket) AS c
  FROM grid g JOIN quartiles USING (r, kind) GROUP BY r, kind),
lengths AS (
  SELECT r, kind, n, floor({PER_DOUBLING} * log2(n + 1) + 1e-9)::BIGINT AS l FROM bytes),
digests AS MATERIALIZED (
  SELECT r, kind, c, l, lpad(lower(to_hex(l)), 3, '0') || array_to_string(list_transform(range({BUCKETS // 2}), lambda i: lower(to_hex(4 * c[2 * i + 1] + c[2 * i + 2]))), '') AS f
  FROM codes JOIN lengths USING (r, kind)),
pairs AS (
  SELECT e.*, a.f AS fingerprint, b.f AS edited_fingerprint,
    1.0::DOUBLE - (list_sum(list_transform(list_zip(a.c, b.c), lambda p: abs(p[1] - p[2]))) + {LENGTH_WEIGHT} * least(abs(a.l - b.l), {LENGTH_STEPS}))::DOUBLE / {LARGEST} AS near_edited,
    1.0::DOUBLE - (list_sum(list_transform(list_zip(a.c, x.c), lambda p: abs(p[1] - p[2]))) + {LENGTH_WEIGHT} * least(abs(a.l - x.l), {LENGTH_STEPS}))::DOUBLE / {LARGEST} AS near_next
  FROM edits e JOIN digests a ON a.r = e.r AND a.kind = 0 JOIN digests b ON b.r = e.r AND b.kind = 1 JOIN digests x ON x.r = e.next AND x.kind = 0)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next FROM pairs"""
