"""Operator 6: passages that repeat across or within documents, by hashes of normalised units.

Units are lines, and runs of sentences (stretches of a line up to a sentence mark): from each sentence on, and up to
each sentence back, as many as reach ``MIN_WORDS`` words, over line breaks too. A line or sentence that is long enough
is a unit of its own; shorter ones are covered, with what stands beside them, from wherever a passage begins to
wherever it ends; a text of fewer words is one unit. (With shorter lines as units, chance repeats such as one-word
lines touch close to half of the documents that repeat no passage.) Units are normalised (lower case, single spaces,
no closing marks) and known by 128 bits of hash. Of equal units over all documents the first (by doc_id, then hash of
the text, then position) stays; the others are to be removed, and keep their places in the original text (code
points, end exclusive). Places may overlap. What overlaps its own first occurrence stays, so that a copy of each
repeated sentence is left.

Cases: a null or empty text has no units; a line without a letter or digit is none by itself; in texts without
spaces, ``WORD_CHARS`` characters count as a word; rows equal in doc_id and text are one document, whose places are
listed for each of them; null ids come first; an empty table gives an empty result; other columns are ignored, or
passed along by ``remove``, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_names, small_batches, written

MIN_WORDS = 12
WORD_CHARS = 12
_BREAK = re.compile(r"[.!?]+(?=\s)|[\u3002\uff01\uff1f]+|\n")
_KEY = ("doc_id", "text_key")
_FIELDS = ["doc_id", "text_key", "start", "end", "n_words", "h1", "h2"]


def units(text: str | None, min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, str, int]]:
    """(start, end, normalised, words) of every unit of a text, each place once."""
    if not text:
        return
    begin, opens, parts, spans = 0, 0, [], set()  # spans: first and last sentence of each unit
    for end in [*(m.end() for m in _BREAK.finditer(text)), len(text)]:
        piece = text[begin:end]
        words = piece.lower().split()
        if words:
            start, stop = begin + len(piece) - len(piece.lstrip()), begin + len(piece.rstrip())
            parts.append((start, stop, " ".join(words), len(words), max(len(words), (stop - start) // WORD_CHARS)))
        if piece.endswith("\n") or end == len(text):
            if sum(p[4] for p in parts[opens:]) >= min_words and any(c.isalnum() for c in text[parts[opens][0] : parts[-1][1]]):
                spans.add((opens, len(parts) - 1))
            opens = len(parts)
        begin = end
    sizes = [p[4] for p in parts]
    if 0 < sum(sizes) < min_words and any(map(str.isalnum, text)):
        spans.add((0, len(parts) - 1))
    last = held = 0
    for i, n in enumerate(sizes):  # forward runs
        while held < min_words and last < len(sizes):
            held, last = held + sizes[last], last + 1
        if held >= min_words:
            spans.add((i, last - 1))
        held -= n
    first = len(sizes) - 1
    held = 0
    for i in range(len(sizes) - 1, -1, -1):  # backward runs
        while held < min_words and first >= 0:
            held, first = held + sizes[first], first - 1
        if held >= min_words:
            spans.add((first + 1, i))
        held -= sizes[i]
    for i, j in sorted(spans):
        run = parts[i : j + 1]
        yield run[0][0], run[-1][1], " ".join(p[2] for p in run).rstrip(".!?\u3002\uff01\uff1f"), sum(p[3] for p in run)


def _units(docs: DataFrame, min_words: int) -> DataFrame:
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for b in batches:
            out: list[tuple] = []
            digests: list[bytes] = []
            for doc, key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                for start, end, unit, words in units(text.as_py(), min_words):
                    out.append((doc, key, start, end, words))
                    digests.append(xxh3_128_digest(unit.encode("utf-8", "surrogatepass")))
            h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            columns = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns], pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], names=_FIELDS)

    return rows.mapInArrow(listed, ", ".join(f"`{f}` long" for f in _FIELDS))


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """A row for each unit to be removed: doc_id, text_key, start, end, n_words, and first_doc_id and first_start of what stays."""
    every = written(_units(docs, min_words), "units")
    here = F.struct(*_KEY, "start", "end")
    firsts = every.groupBy("h1", "h2").agg(F.min(here).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    firsts = written(firsts, "first-units")
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    later = every.join(firsts.hint("merge"), ["h1", "h2"]).where(~(same & (F.col("start") < F.col("first.end"))))
    return later.select(*_KEY, "start", "end", "n_words", F.col("first.doc_id").alias("first_doc_id"), F.col("first.start").alias("first_start"))


def remove(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with ``kept_text``, and ``removed``: the (start, end) places that were cut from the original text."""
    small_batches(docs.sparkSession)
    cuts = repeats(docs, min_words).distinct().groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("removed"))
    base = docs.drop("removed", "kept_text")
    i, k = free_names(base, "id", "key")
    cuts = written(cuts, "unit-cuts").toDF(i, k, "removed")
    joined = base.join(cuts.hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(k)), "left").drop(i, k)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = []
            for text, places in zip(b.column("text"), b.column("removed")):
                whole, at, parts = text.as_py(), 0, []
                for p in places.as_py() or []:
                    parts.append(whole[at : p["start"]])
                    at = max(at, p["end"])
                kept.append(whole if not places.is_valid else "".join([*parts, whole[at:]]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(kept, pa.string())], names=[*b.schema.names, "kept_text"])

    return joined.mapInArrow(cut, T.StructType([*joined.schema.fields, T.StructField("kept_text", T.StringType())]))
