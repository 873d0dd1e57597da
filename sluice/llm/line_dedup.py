"""Operator 9: removal of lines that repeat earlier passages, by windows of three lines.

Every three consecutive lines of a document are one window, known by 128 bits of hash. Windows are compared
over all documents; of equal windows the first (by doc_id, then hash of the text, then position) stays, and
the lines of every later one are removed. Covered positions that overlap or touch are merged into ranges.

Cases: a null text or a text of fewer than three lines has no window and stays as it is; a window of blank
lines alone does not count; within a document later repeats are removed too; rows equal in doc_id and text are
one document and get the same result; null ids come first; an empty table gives an empty result; other
columns are kept, and columns named like the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, written

LINES = 3
_KEY = ("doc_id", "text_key")


def _lines() -> Column:
    return F.split("text", "\n")


def _windows(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, pos and the two halves of the hash of every window that holds text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), _lines().alias("lines"))
    hashed = F.posexplode(
        F.transform(
            F.sequence(F.lit(0), F.size("lines") - LINES),
            lambda i: F.struct(
                F.xxhash64(*[F.get("lines", i + k) for k in range(LINES)]).alias("h1"),
                F.xxhash64(F.lit(LINES), *[F.get("lines", i + k) for k in reversed(range(LINES))]).alias("h2"),
                F.length(F.trim(F.concat(*[F.get("lines", i + k) for k in range(LINES)]))).alias("n"),
            ),
        )
    ).alias("pos", "w")
    return rows.where(F.size("lines") >= LINES).select(*_KEY, hashed).where("w.n > 0").select(*_KEY, "pos", "w.h1", "w.h2")


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and ``ranges``: ascending, disjoint (first, last) line numbers from 0 to be removed."""
    windows = _windows(docs)
    here = F.struct(*_KEY, "pos")
    firsts = windows.groupBy("h1", "h2").agg(F.min(here).alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = written(firsts.drop("n"), "line-windows")
    later = windows.join(firsts.hint("merge"), ["h1", "h2"]).where(~here.eqNullSafe(F.col("first"))).select(*_KEY, "pos").distinct()
    by_doc = Window.partitionBy(*_KEY).orderBy("pos")
    opens = F.coalesce(F.col("pos") - F.lag("pos").over(by_doc) > LINES, F.lit(True)).cast("int")
    islands = later.withColumn("opens", opens).withColumn("island", F.sum("opens").over(by_doc))
    ranges = islands.groupBy(*_KEY, "island").agg(F.min("pos").alias("first"), (F.max("pos") + LINES - 1).alias("last"))
    return ranges.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("ranges"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with ``kept_text`` (the text without repeated lines), n_lines, n_removed and ``ranges`` added."""
    ranges = written(repeated_ranges(docs), "line-ranges")
    base = docs.drop("kept_text", "n_lines", "n_removed", "ranges")
    i, k, lines = free_names(base, "id", "key", "lines")
    found = ranges.select(F.col("doc_id").alias(i), F.col("text_key").alias(k), "ranges")
    joined = base.join(found.hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(k)), "left")
    gaps = F.transform(
        F.sequence(F.lit(0), F.size("ranges")),
        lambda i: F.slice(
            lines,
            F.when(i == 0, 1).otherwise(F.get("ranges", i - 1)["last"] + 2),
            F.when(i == F.size("ranges"), F.size(lines)).otherwise(F.get("ranges", i)["first"]) - F.when(i == 0, 0).otherwise(F.get("ranges", i - 1)["last"] + 1),
        ),
    )
    removed = F.aggregate("ranges", F.lit(0), lambda a, r: a + r["last"] - r["first"] + 1)
    return (
        joined.withColumn(lines, _lines())
        .withColumns(
            {
                "kept_text": F.when(F.col("ranges").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(gaps), "\n")),
                "n_lines": F.coalesce(F.when(F.length("text") > 0, F.size(lines)), F.lit(0)).cast("long"),
                "n_removed": F.coalesce(F.when(F.col("ranges").isNotNull(), removed), F.lit(0)).cast("long"),
            }
        )
        .drop(i, k, lines)
    )


def ranges_text() -> Column:
    return F.array_join(F.transform(F.coalesce("ranges", F.expr("array()")), lambda r: F.concat(r["first"].cast("string"), F.lit("-"), r["last"].cast("string"))), ",")


#: The rows of the op9 query.
SQL = """
WITH lines AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents
), numbered AS (
  SELECT doc_id, ls, unnest(range(0, len(ls) - 2)) AS pos FROM lines WHERE len(ls) >= 3
), windows AS (
  SELECT doc_id, pos, ls[pos + 1] || chr(10) || ls[pos + 2] || chr(10) || ls[pos + 3] AS w FROM numbered
  WHERE length(trim(ls[pos + 1] || ls[pos + 2] || ls[pos + 3])) > 0
), ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS nth FROM windows
), covered AS (
  SELECT DISTINCT doc_id, pos + k AS line FROM ranked, (VALUES (0), (1), (2)) AS t(k) WHERE nth > 1
), islands AS (
  SELECT doc_id, line, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS island FROM covered
), ranges AS (
  SELECT doc_id, min(line) AS a, max(line) AS b FROM islands GROUP BY doc_id, island
), removed AS (
  SELECT doc_id, sum(b - a + 1)::BIGINT AS n_removed, string_agg(a || '-' || b, ',' ORDER BY a) AS removed FROM ranges GROUP BY doc_id
), each_line AS (
  SELECT doc_id, unnest(ls) AS l, unnest(range(0, len(ls))) AS line FROM lines
), kept AS (
  SELECT e.doc_id, string_agg(e.l, chr(10) ORDER BY e.line) AS t
  FROM each_line e ANTI JOIN covered c ON e.doc_id = c.doc_id AND e.line = c.line GROUP BY e.doc_id
)
SELECT d.doc_id, CASE WHEN length(d.text) > 0 THEN len(d.ls) ELSE 0 END::BIGINT AS n_lines, coalesce(r.n_removed, 0)::BIGINT AS n_removed,
       coalesce(r.removed, '') AS removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM lines d LEFT JOIN removed r USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
