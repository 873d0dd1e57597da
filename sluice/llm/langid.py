"""Operator 1: language identification with bit-sliced Bloom filters of letter n-grams.

Letters are lower-cased, everything else counts as a space, and every three characters around a letter are
an n-gram. An n-gram belongs to a language if its rate there is at least a fixed share of its highest rate
in any language, so that words borrowed by a few documents do not count. The languages' Bloom filters are
sliced by bit: a slot holds one mask of languages, and the AND of an n-gram's slots gives all languages that
contain it. A text's popcount for each language is corrected for the filter's false positives; the highest
corrected share decides, and is the score.

The filters grow with the n-grams of the largest language, ``ROOM`` slots for each. N-grams are divided by hash
into as many filters as keep each below ``FILTER_BYTES``: driver and executors hold one at a time, and texts are
looked up in one after the other, with the sums so far written in between.

Cases: a null text or one without a letter is ``und`` with score 0, as is every text if nothing was learned;
ties go to the language first in order; rows are judged one by one, so repeated rows get equal results; only text is
read for a prediction, other columns are carried along, and columns named like the added ones replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, small_batches, written

#: Characters that are worked on at once.
SEGMENT = 1 << 19
#: Slots of a filter for each n-gram (rounded up to a power of two), and slots that an n-gram sets.
ROOM, PROBES = 16, 3
#: An n-gram's rate in a language against its highest rate in any, from which it belongs to the language.
SHARE = 0.3
MASK_BITS = 60
#: Bytes of the filter that is held and broadcast at once; more n-grams are divided among several.
FILTER_BYTES = 1 << 28
_ALPHA: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _ALPHA:
        _ALPHA.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _ALPHA[0]


def segments(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """(row, piece) lists of bounded size. Consecutive pieces of a text overlap, so that each n-gram lies in one."""
    rows, pieces, size = [], [], 0
    for row, text in enumerate(texts):
        padded = f" {text.lower()} " if text else ""
        for at in range(0, max(len(padded) - 2, 0), SEGMENT):
            piece = padded[at : at + SEGMENT + 2]
            rows.append(row)
            pieces.append(piece)
            size += len(piece)
            if size >= SEGMENT:
                yield rows, pieces
                rows, pieces, size = [], [], 0
    if rows:
        yield rows, pieces


def ngrams(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of some pieces as 63-bit codes, and the number of the piece of each."""
    codes = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), "<u4")
    letters = _letters()[codes]
    c = np.where(letters, codes, 32).astype(np.uint64)
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ok = letters[1:-1].copy()
    inner = np.cumsum(lengths)[:-1]
    ok[inner - 2] = False  # would span two pieces
    ok[inner - 1] = False
    at = np.flatnonzero(ok)
    return (c[at] << np.uint64(42)) | (c[at + 1] << np.uint64(21)) | c[at + 2], np.repeat(np.arange(len(pieces)), lengths)[at]


def slots_of(grams: np.ndarray, slots: int, probes: int = PROBES) -> list[np.ndarray]:
    """The Bloom slots of n-grams, by double hashing."""
    with np.errstate(over="ignore"):
        h = grams * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return [((a + np.uint64(k) * b) % np.uint64(slots)).astype(np.int64) for k in range(probes)]


def part_of(grams: np.ndarray, parts: int) -> np.ndarray:
    """Which of ``parts`` filters an n-gram belongs to."""
    with np.errstate(over="ignore"):
        h = (grams ^ (grams >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return ((h >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def shares(sums: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Shares of n-grams that languages contain, from corrected counts."""
    return np.clip(sums / np.maximum(n, 1)[:, None], 0, 1)


@dataclass
class Model:
    """One filter: that of the n-grams whose hash falls on ``part``."""

    langs: list[str]
    masks: list[np.ndarray]
    false_positive: np.ndarray
    part: int = 0
    parts: int = 1

    def tally(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """By text: n-grams found for each language, less what false positives add; and n-grams looked up."""
        counts, n = np.zeros((len(texts), len(self.langs)), np.int64), np.zeros(len(texts), np.int64)
        for rows, pieces in segments(texts):
            grams, piece = ngrams(pieces)
            if self.parts > 1:
                mine = part_of(grams, self.parts) == self.part
                grams, piece = grams[mine], piece[mine]
            if not grams.size:
                continue
            at, row = slots_of(grams, self.masks[0].size if self.masks else 1), np.asarray(rows)[piece]
            n += np.bincount(row, minlength=len(texts))
            for w, mask in enumerate(self.masks):
                both = mask[at[0]]
                for k in at[1:]:
                    both = both & mask[k]
                for bit in range(min(MASK_BITS, len(self.langs) - w * MASK_BITS)):
                    counts[:, w * MASK_BITS + bit] += np.bincount(row[(both >> mask.dtype.type(bit)) & 1 == 1], minlength=len(texts))
        f = np.minimum(self.false_positive[None, :], 1 - 1e-9)
        return (counts - n[:, None] * f) / (1 - f), n


@dataclass
class Languages:
    """What was learned: the languages, and the table (part, slot, word, mask) of their filters."""

    langs: list[str]
    slots: int = 1
    parts: int = 1
    table: DataFrame | None = None

    def filter(self, part: int = 0) -> Model:
        """One filter, of ``FILTER_BYTES`` at most, brought to the driver."""
        if self.table is None:
            return Model([], [], np.zeros(0))
        masks = np.zeros((-(-len(self.langs) // MASK_BITS), self.slots), np.int64)
        got = self.table.where(F.col("part") == part).select("slot", "word", "mask").toArrow()  # ``slots`` rows a word at most
        masks[got.column("word").to_numpy(), got.column("slot").to_numpy()] = got.column("mask").to_numpy()
        fill = np.asarray([((masks[i // MASK_BITS] >> np.int64(i % MASK_BITS)) & 1).mean() for i in range(len(self.langs))])
        small = [m.astype(np.uint8) if len(self.langs) <= 8 else m for m in masks]
        return Model(self.langs, small, fill**PROBES, part, self.parts)


def count_ngrams(docs: DataFrame) -> DataFrame:
    """lang, gram, n over whole texts of ``docs`` (lang, text)."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, (grams, n) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * grams.size, pa.string()), pa.array(grams.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

        for b in batches:
            by = defaultdict(list)
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by[lang].append(text)
            for lang, texts in by.items():
                for _, pieces in segments(texts):
                    grams, n = np.unique(ngrams(pieces)[0], return_counts=True)
                    old = held.get(lang, (grams[:0], n[:0]))
                    every, at = np.unique(np.concatenate([old[0], grams]), return_inverse=True)
                    held[lang] = (every, np.bincount(at, np.concatenate([old[1], n])).astype(np.int64))
            if sum(g.size for g, _ in held.values()) > 2_000_000:
                yield from out()
                held = {}
        yield from out()

    return docs.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, share: float = SHARE, room: int = ROOM, filter_bytes: int = FILTER_BYTES) -> Languages:
    """Learns from every row of ``docs`` (lang, text) with a language and a text. ``filter_bytes`` bounds one filter."""
    rows = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = written(count_ngrams(rows), "ngrams")
    langs = [r[0] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).orderBy("lang").collect()]
    if not langs:
        return Languages([])
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rated = counts.join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("total"))  # a row for each language
    top = rated.groupBy("gram").agg(F.max("rate").alias("top"))
    member = written(rated.join(top, "gram").where(F.col("rate") >= share * F.col("top")).select("lang", "gram"), "language-ngrams")
    most = member.groupBy("lang").count().agg(F.max("count")).head()[0]
    wide = 8 * -(-len(langs) // MASK_BITS)  # bytes of a slot while the filter is put together
    size = lambda parts: 1 << max(room * -(-most // parts) - 1, 1).bit_length()
    parts = 1
    while size(parts) * wide > filter_bytes and parts < most:
        parts *= 2
    slots = size(parts)
    number = F.create_map(*[F.lit(x) for i, lang in enumerate(langs) for x in (lang, i)])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams, lang = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()
            part = part_of(grams, parts)
            for at in slots_of(grams, slots):
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(at), pa.array(lang // MASK_BITS), pa.array(np.int64(1) << (lang % MASK_BITS).astype(np.int64))], names=["part", "slot", "word", "mask"])

    placed = member.select("gram", number[F.col("lang")].cast("int").alias("lang")).mapInArrow(place, "part long, slot long, word int, mask long")
    return Languages(langs, slots, parts, written(placed.groupBy("part", "slot", "word").agg(F.bit_or("mask").alias("mask")), "language-filters"))


def predict(docs: DataFrame, learned: Languages) -> DataFrame:
    """``docs`` with lang_pred and score; the other columns are carried along."""
    from pyspark.sql import types as T

    spark = docs.sparkSession
    small_batches(spark)
    out = docs.drop("lang_pred", "score")
    final = T.StructType([*out.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    sums_name, n_name = free_names(out, "sums", "n")
    between = T.StructType([*out.schema.fields, T.StructField(sums_name, T.ArrayType(T.DoubleType())), T.StructField(n_name, T.LongType())])
    names = out.columns

    def judge(batches: Iterator[pa.RecordBatch], shared, first: bool, last: bool) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
        m = shared.value
        for b in batches:
            columns = [b.column(i) for i in range(len(names))]
            sums, n = m.tally(b.column("text").to_pylist())
            if not first:
                sums = sums + b.column(len(names)).flatten().to_numpy().reshape(sums.shape)
                n = n + b.column(len(names) + 1).to_numpy()
            if not last:
                flat = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * len(m.langs), pa.int32()), pa.array(sums.ravel(), pa.float64()))
                yield pa.RecordBatch.from_arrays([*columns, flat, pa.array(n, pa.int64())], names=between.names)
                continue
            if m.langs:
                share = shares(sums, n)
                best = share.argmax(axis=1)
                lang = [m.langs[i] if k else "und" for i, k in zip(best.tolist(), n.tolist())]
                score = np.where(n > 0, share[np.arange(len(best)), best], 0.0)
            else:
                lang, score = ["und"] * b.num_rows, np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=final.names)

    for part in range(learned.parts):
        shared = spark.sparkContext.broadcast(learned.filter(part))
        first, last = part == 0, part == learned.parts - 1
        step = lambda batches, shared=shared, first=first, last=last: judge(batches, shared, first, last)
        out = out.mapInArrow(step, final if last else between)
        out = out if last else written(out, "language-sums")
    return out
