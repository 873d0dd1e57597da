"""Operator 7: benchmark decontamination by Wu-Manber search over words.

Patterns are the windows of 13 consecutive words of the items; a shorter item is one window. Patterns of one
length form a set with a shift table over blocks of two words: a block that ends no prefix of any pattern
lets the search skip ahead. Where the shift is zero, the bucket of that block (the patterns' suffix) holds
the candidates, and a comparison of all words confirms them.

Cases: a null text has no words; an item without words is no pattern; items of equal text are all named; an
item without an id marks words but cannot be named; an empty benchmark marks nothing; rows are judged one by
one, so repeated rows get equal results; only doc_id and text are used, other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written

WINDOW = 13
#: Text bytes of the items whose tables are held at once (some hundred MB); a larger benchmark is searched in several passes.
PASS_BYTES = 1 << 20
#: In a worker: the items of the pass at hand and their tables.
_TABLES: list = [None, None]

#: Bytes that separate words become spaces; A-Z become lower case.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split(b" ") if text else []


def word_list(text: str | None) -> list[bytes]:
    return [w for w in words(text) if w]


class PatternSet:
    """Wu-Manber tables for patterns of one length (in words)."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], set[str]]):
        self.length, self.block = length, min(2, length)
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], list[tuple[tuple[bytes, ...], set[str]]]] = defaultdict(list)
        for p, items in patterns.items():
            for end in range(self.block, length + 1):
                key = p[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, length), length - end)
            self.buckets[p[length - self.block :]].append((p, items))
        self.most = length - self.block + 1

    def search(self, doc: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """Positions at which a pattern begins, with its items."""
        get, most, block, m, n = self.shift.get, self.most, self.block, self.length, len(doc)
        end = m
        while end <= n:
            key = (doc[end - 2], doc[end - 1]) if block == 2 else (doc[end - 1],)
            step = get(key, most)
            if step:
                end += step
                continue
            start = end - m
            for pattern, items in self.buckets[key]:
                if pattern[0] == doc[start] and list(pattern) == doc[start:end]:
                    yield start, items
            end += 1


def pattern_sets(items: list[tuple[list[str], str | None]], window: int = WINDOW) -> list[PatternSet]:
    """The patterns of items (ids, text) by length."""
    by: dict[int, dict[tuple[bytes, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
    for ids, text in items:
        w = word_list(text)
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            by[m][tuple(w[i : i + m])].update(ids)
    return [PatternSet(m, p) for m, p in sorted(by.items())]


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``docs`` with n_words, hit_words (positions, ascending) and hit_items (ids as text, ascending) added.

    Of each pass the texts go to the executors, where a worker builds their tables once; passes are written in between.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    items = written(items.groupBy("text").agg(F.array_sort(F.collect_set("item_id")).alias("ids")).select("ids", "text"), "benchmark-items")
    total = items.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    passes = max(1, -(-total // pass_bytes))
    added = ("n_words", "hit_words", "hit_items")
    out = docs.drop(*added).withColumns({"n_words": F.lit(None).cast("long"), "hit_words": F.expr("cast(array() as array<int>)"), "hit_items": F.expr("cast(array() as array<string>)")})
    for k in range(passes):
        shared = spark.sparkContext.broadcast([tuple(r) for r in items.where(F.pmod(F.xxhash64("text"), F.lit(passes)) == k).collect()])  # about ``pass_bytes``

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            if _TABLES[0] is not shared.value:
                _TABLES[:] = shared.value, pattern_sets(shared.value, window)
            sets = _TABLES[1]
            for b in batches:
                counts, places, names = [], [], []
                for text, hits, found in zip(b.column("text"), b.column("hit_words"), b.column("hit_items")):
                    doc = word_list(text.as_py())
                    hit, named = set(hits.as_py()), set(found.as_py())
                    for s in sets:
                        for start, its in s.search(doc):
                            hit.update(range(start, start + s.length))
                            named |= its
                    counts.append(len(doc))
                    places.append(sorted(hit))
                    names.append(sorted(named))
                new = {"n_words": pa.array(counts, pa.int64()), "hit_words": pa.array(places, pa.list_(pa.int32())), "hit_items": pa.array(names, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays([new.get(n, b.column(i)) for i, n in enumerate(b.schema.names)], names=b.schema.names)

        out = out.mapInArrow(search, out.schema)
        out = out if k == passes - 1 else written(out, "searched")
    return out


def judged(found: DataFrame) -> DataFrame:
    """``find``'s rows with n_hit, n_items, items_sha256 and contaminated: at least a twentieth of the words is hit."""
    n_hit = F.size("hit_words").cast("long")
    return found.withColumns(
        {
            "n_hit": n_hit,
            "n_items": F.size("hit_items").cast("long"),
            "items_sha256": F.sha2(F.array_join(F.array_sort("hit_items"), ",").cast("binary"), 256),
            "contaminated": (n_hit > 0) & (n_hit * 20 >= F.col("n_words")),
        }
    )


_SQL_WORDS = r"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
#: ``judged(find(documents, benchmark))`` without the positions, by a join of all windows on their words.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS w FROM documents),
e AS (SELECT r, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM d),
ahead AS (SELECT r, pos, list(word) OVER (PARTITION BY r ORDER BY pos ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS l FROM e),
b AS (SELECT item_id::VARCHAR AS item_id, {_SQL_WORDS} AS w FROM benchmark),
s AS (SELECT item_id, w, least({WINDOW}, len(w)) AS m, unnest(range(1, greatest(len(w) - {WINDOW}, 0) + 2)) AS i FROM b WHERE len(w) > 0),
p AS (SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS k FROM s),
x AS (SELECT r, pos, m, array_to_string(l[1 : m], ' ') AS k FROM ahead, (SELECT DISTINCT m FROM p) WHERE len(l) >= m),
found AS (SELECT r, pos, m, item_id FROM x JOIN p USING (m, k)),
hit AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(pos, pos + m)) AS j FROM (SELECT DISTINCT r, pos, m FROM found)) GROUP BY r),
named AS (SELECT r, count(item_id) AS n_items, coalesce(string_agg(item_id, ',' ORDER BY item_id), '') AS ids FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""
