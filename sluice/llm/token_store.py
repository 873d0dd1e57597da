"""Operator 4: token ids as binary shards with a minimal perfect hash index.

Documents are range-partitioned and sorted by key, encoded in their final partition and written as shard
records: the raw ids of consecutive documents (``payload``), and an index over their keys. The index is a
cascade of bit arrays (a key sits in the first level where it collides with no other key); the rank of its
bit is its slot. A slot holds a fingerprint of the key, and where the document's ids begin and how many
there are, so that one key is found in constant time and a foreign key is told apart.

Cases: a null text is empty and leaves only the end id; a null key sorts first, is stored and listed, but
cannot be looked up; rows that share a key are numbered (by a hash of their texts) and each keeps a slot;
an empty table gives a store without shards; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches
from .tokens import word_ids

#: Ids in a shard, after which the next document opens another one. A longer document has its own shard.
SHARD_IDS = 1 << 20
GAMMA = 1.5
BLOCK = 512

_SHARD = pa.schema(
    [
        ("part", pa.int32()), ("seq", pa.int32()), ("start_in_part", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()),
        ("n_null", pa.int64()), ("first_key", pa.int64()), ("last_key", pa.int64()), ("id_bytes", pa.int32()),
        ("keys", pa.binary()), ("levels", pa.list_(pa.int64())), ("bits", pa.binary()), ("ranks", pa.binary()),
        ("fingerprints", pa.binary()), ("begins", pa.binary()), ("counts", pa.binary()), ("payload", pa.binary()),
    ]
)
_SHARD_DDL = (
    "part int, seq int, start_in_part long, n_docs long, n_ids long, n_null long, first_key long, last_key long, id_bytes int, "
    "keys binary, levels array<long>, bits binary, ranks binary, fingerprints binary, begins binary, counts binary, payload binary"
)


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A bijection of 64-bit words for each seed."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def key_words(keys: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    """One 64-bit word for each (key, number among the rows of that key)."""
    return _mix(keys.astype(np.int64).view(np.uint64), 1) ^ _mix(occurrence.astype(np.uint64), 2) * (occurrence > 0)


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit words."""

    def __init__(self, levels: list[int], bits: bytes, ranks: bytes):
        self.levels, self.bits, self.ranks = levels, np.frombuffer(bits, np.uint8), np.frombuffer(ranks, "<u4")

    @classmethod
    def build(cls, words: np.ndarray) -> PerfectHash:
        levels, arrays, rest = [], [], words
        while rest.size:
            size = -(-int(rest.size * GAMMA + 1) // BLOCK) * BLOCK
            at = (_mix(rest, 16 + len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(size)
            arrays.append(alone)
            rest = rest[~alone[at]]
        every = np.concatenate(arrays) if arrays else np.zeros(0, bool)
        per_block = every.reshape(-1, BLOCK).sum(axis=1, dtype=np.int64)
        ranks = (np.cumsum(per_block) - per_block).astype("<u4")
        return cls(levels, np.packbits(every, bitorder="little").tobytes(), ranks.tobytes())

    def slots(self, words: np.ndarray) -> np.ndarray:
        """The slot of each word; -1 where no level has it. A foreign word may get any slot."""
        out, open_, base = np.full(words.size, -1, np.int64), np.arange(words.size), 0
        for k, size in enumerate(self.levels):
            at = base + (_mix(words[open_], 16 + k) % np.uint64(size)).astype(np.int64)
            hit = (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            out[open_[hit]] = self._rank(at[hit])
            open_, base = open_[~hit], base + size
        return out

    def _rank(self, at: np.ndarray) -> np.ndarray:
        block = at // BLOCK
        before = np.arange(BLOCK // 8)[None, :] * 8 + 8 <= (at % BLOCK)[:, None]
        octets = self.bits.reshape(-1, BLOCK // 8)[block]
        whole = (np.bitwise_count(octets) * before).sum(axis=1, dtype=np.int64)
        last = self.bits[at >> 3] & ((np.uint16(1) << (at & 7).astype(np.uint16)) - 1).astype(np.uint8)
        return self.ranks[block].astype(np.int64) + whole + np.bitwise_count(last)


class _Shard:
    def __init__(self, part: int, id_bytes: int):
        self.part, self.id_bytes, self.seq, self.start = part, id_bytes, 0, 0
        self.clear()

    def clear(self) -> None:
        self.keys: list[int | None] = []
        self.ids: list[bytes] = []
        self.n = 0

    def add(self, key: int | None, ids: bytes) -> None:
        self.keys.append(key)
        self.ids.append(ids)
        self.n += len(ids) // self.id_bytes

    def record(self) -> pa.RecordBatch:
        counts = np.asarray([len(x) for x in self.ids], np.int64) // self.id_bytes
        begins = np.cumsum(counts) - counts
        nulls = sum(k is None for k in self.keys)
        keys = np.asarray(self.keys[nulls:], np.int64)
        words = key_words(keys, _occurrence(keys))
        index = PerfectHash.build(words)
        slot = index.slots(words)
        fingerprints, first, many = np.empty(keys.size, "<u4"), np.empty(keys.size, "<u8"), np.empty(keys.size, "<u8")
        fingerprints[slot] = (_mix(words, 3) >> np.uint64(32)).astype("<u4")
        first[slot], many[slot] = begins[nulls:], counts[nulls:]
        row = {
            "part": self.part, "seq": self.seq, "start_in_part": self.start, "n_docs": len(self.keys), "n_ids": self.n, "n_null": nulls,
            "first_key": int(keys[0]) if keys.size else None, "last_key": int(keys[-1]) if keys.size else None, "id_bytes": self.id_bytes,
            "keys": keys.astype("<i8").tobytes(), "levels": index.levels, "bits": index.bits.tobytes(), "ranks": index.ranks.tobytes(),
            "fingerprints": fingerprints.tobytes(), "begins": first.tobytes(), "counts": many.tobytes(), "payload": b"".join(self.ids),
        }
        if nulls:  # these have no slot; their lengths precede the others
            row["counts"] = counts[:nulls].astype("<u8").tobytes() + row["counts"]
        self.seq, self.start = self.seq + 1, self.start + self.n
        self.clear()
        return pa.RecordBatch.from_pylist([row], schema=_SHARD)


def _occurrence(keys: np.ndarray) -> np.ndarray:
    """Number of earlier equal keys, for sorted keys."""
    if not keys.size:
        return np.zeros(0, np.int64)
    at = np.arange(keys.size)
    new = np.r_[True, keys[1:] != keys[:-1]]
    return at - np.maximum.accumulate(np.where(new, at, 0))


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, partitions: int | None = None, shard_ids: int = SHARD_IDS) -> None:
    """Encodes ``docs`` (doc_id, text), appends ``end_id`` to each and writes the shards, in key order, to ``path``."""
    spark = docs.sparkSession
    small_batches(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids = word_ids(tokenizer)
        end = np.asarray([end_id], ids.dtype).tobytes()
        shard = _Shard(TaskContext.get().partitionId(), ids.dtype.itemsize)
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard.add(key, ids.encode(text.as_py()) + end)
                if shard.n >= shard_ids:
                    yield shard.record()
        if shard.keys:
            yield shard.record()

    rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(encode, _SHARD_DDL).write.parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """A row per stored document: doc_id, start (ids of all documents before it), n_tokens, ids (raw bytes), id_bytes.

    Each document is fetched by its key through the index of its shard.
    """
    shards = spark.read.schema(_SHARD_DDL).parquet(path)
    total, bases = 0, {}
    for part, n in sorted(map(tuple, shards.groupBy("part").agg(F.sum("n_ids")).collect())):  # a number for each partition
        bases[part], total = total, total + n
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("id_bytes", pa.int32())])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                size, nulls, base = shard["id_bytes"], shard["n_null"], bases[shard["part"]] + shard["start_in_part"]
                keys = np.frombuffer(shard["keys"], "<i8")
                first, many = _locate(shard, keys, _occurrence(keys))
                counts = np.r_[np.frombuffer(shard["counts"], "<u8")[:nulls].astype(np.int64), many]
                begins = np.r_[np.cumsum(counts[:nulls]) - counts[:nulls], first]
                names = [None] * nulls + keys.tolist()
                payload = memoryview(shard["payload"])
                for lo in range(0, len(names), 256):
                    b, c = begins[lo : lo + 256], counts[lo : lo + 256]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names[lo : lo + 256], pa.int64()), pa.array(base + b), pa.array(c), pa.array([bytes(payload[i * size : (i + j) * size]) for i, j in zip(b.tolist(), c.tolist())], pa.binary()), pa.array(np.full(b.size, size, np.int32))],
                        schema=schema,
                    )

    return shards.mapInArrow(fetch, "doc_id long, start long, n_tokens long, ids binary, id_bytes int")


def _locate(shard: dict, keys: np.ndarray, occurrence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and count of each key's ids in a shard; begin is -1 for a key that is not there."""
    words = key_words(keys, occurrence)
    slot = PerfectHash(shard["levels"], shard["bits"], shard["ranks"]).slots(words)
    there = slot >= 0
    stored = np.frombuffer(shard["fingerprints"], "<u4")
    there[there] = stored[slot[there]] == (_mix(words[there], 3) >> np.uint64(32)).astype("<u4")
    begins, counts = np.frombuffer(shard["begins"], "<u8"), np.frombuffer(shard["counts"], "<u8")[shard["n_null"] :]
    first, many = np.full(keys.size, -1, np.int64), np.zeros(keys.size, np.int64)
    first[there], many[there] = begins[slot[there]].astype(np.int64), counts[slot[there]].astype(np.int64)
    return first, many


def lookup(spark: SparkSession, path: str, keys: list[int]) -> DataFrame:
    """doc_id and ids of the given keys (the first row of each), read from the shards whose key range holds them."""
    asked = np.unique(np.asarray(keys, np.int64))
    shards = spark.read.schema(_SHARD_DDL).parquet(path)
    if asked.size:
        shards = shards.where((F.col("last_key") >= int(asked[0])) & (F.col("first_key") <= int(asked[-1])))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                mine = asked[(asked >= shard["first_key"]) & (asked <= shard["last_key"])]
                first, many = _locate(shard, mine, np.zeros(mine.size, np.int64))
                size = shard["id_bytes"]
                found = [(k, shard["payload"][b * size : (b + c) * size], size) for k, b, c in zip(mine.tolist(), first.tolist(), many.tolist()) if b >= 0]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.binary()), pa.array([x[2] for x in found], pa.int32())], names=["doc_id", "ids", "id_bytes"])

    return shards.mapInArrow(find, "doc_id long, ids binary, id_bytes int")


def ids_crc32(ids: bytes, id_bytes: int) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids if id_bytes == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes())


def digests(store: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids that ``read_store`` returned."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = [ids_crc32(i.as_py(), n.as_py()) for i, n in zip(b.column("ids"), b.column("id_bytes"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(sums, pa.int64())], schema=schema)

    return store.mapInArrow(crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
