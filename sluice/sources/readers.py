"""Reading delimited files whose separator, header and encoding are unknown, and writing prepared tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import finite, normalise

SEPARATORS = (",", "\t", ";", r"\s+", "|", ":")
ENCODINGS = ("utf-8", "iso-8859-1", "windows-1252", "utf-16")
# First cells that are labels, not names of columns.
LABELS = ("ham", "spam", "yes", "no", "true", "false", "positive", "negative", "pos", "neg")
SNIFF_LINES = 10


def text_lines(spark: SparkSession, path: str, charset: str = "utf-8") -> DataFrame:
    """``value``: the lines of a file or folder, decoded. A file in UTF-16 is read by one task, as a stream."""
    if charset == "utf-8":
        return spark.read.text(path)
    # A separator that occurs in no text and no quotes: a line is one cell.
    lines = spark.read.schema("value string").csv(path, sep="\x01", quote="", escape="", encoding=charset, multiLine=charset == "utf-16")
    return lines.where("value is not null")


def first_lines(spark: SparkSession, path: str, charset: str = "utf-8", n: int = SNIFF_LINES) -> list[str]:
    return [r[0] for r in text_lines(spark, path, charset).limit(n).collect()]


def _cells(line: str, sep: str) -> list[str]:
    return re.split(r"\s+", line.strip()) if sep == r"\s+" else line.split(sep)


def separator(lines: Sequence[str]) -> str:
    """The separator that cuts some first lines best: many columns, few holes, present in the header."""
    rows = [x for x in lines if x.strip()]
    best, best_score = ",", float("-inf")
    for sep in SEPARATORS:
        table = [_cells(x, sep) for x in rows]
        if len(table) < 2:
            continue
        width = len(table[0]) if sep != r"\s+" else max(len(t) for t in table)
        if width < 2:
            continue
        columns = list(zip(*[(t + [""] * width)[:width] for t in table[1:]]))
        holes = sum(1 for c in columns if sum(not x.strip() for x in c) > len(c) / 2)
        if holes > width / 2 or (sep != r"\s+" and sum(len(t[0].split()) >= 3 for t in table[1:]) > len(table) / 2):
            continue
        score = 10 * width + 2 * (len(table) - 1) - 20 * holes
        if sep != r"\s+" and sep not in rows[0]:
            score -= 900
        if sep == r"\s+":
            if "\t" in rows[0] and any(" " in x for x in rows[1:]):
                score += 200
            elif any(len(re.findall(r"\s+", x.strip())) >= width - 1 for x in rows[1:]) and not any(s in rows[0] for s in ",;|\t"):
                score += 100
        if len(table[0]) + 1 == len(table[1]):
            score += 100
        if score > best_score:
            best, best_score = sep, score
    return best


def _number(x: str) -> bool:
    try:
        float(x)
    except ValueError:
        return False
    return True


def has_header(lines: Sequence[str], sep: str) -> bool:
    """Whether the first line names the columns."""
    table = [[c.strip().strip('"') for c in _cells(x, sep)] for x in lines[:5] if x.strip()]
    if len(table) < 2:
        return True
    first = table[0]
    if len(first) != len(table[1]):
        return True
    if sum(map(_number, first)) > len(first) / 2:
        return False
    if any(sum(a == b for a, b in zip(first, t)) > len(first) / 2 for t in table[1:]):
        return False
    if first[0].lower() in LABELS and table[1][0].lower() in LABELS:
        return False
    return not any("\t" in c or "," in c for c in first)


def encoding(spark: SparkSession, path: str) -> str:
    """The first encoding that reads every line of every file; found where the lines are, from their bytes."""
    head = F.hex(F.substring(F.col("value").cast("binary"), 1, 2))
    marked, valid = spark.read.text(path).agg(F.bool_or(head.isin("FFFE", "FEFF")), F.bool_and(F.is_valid_utf8("value"))).head()
    return ENCODINGS[3] if marked else ENCODINGS[0] if valid or valid is None else ENCODINGS[1]


def clean_names(df: DataFrame) -> DataFrame:
    """Names with single spaces, different from each other; columns without a name or a value go."""
    if not df.columns:
        return df
    safe = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    filled = safe.agg(*[F.count(c).alias(c) for c in safe.columns]).head().asDict()
    names, keep, seen = [], [], {}
    for i, raw in enumerate(df.columns):
        name = " ".join(raw.split())
        if not filled[f"c{i}"] or not name or name.lower().startswith(("unnamed", "_c")) and name != raw.strip() or name.lower() == "null" or name.lower().startswith("unnamed"):
            continue
        seen[name] = seen.get(name, -1) + 1
        names.append(name if not seen[name] else f"{name}_{seen[name]}")
        keep.append(f"c{i}")
    return safe.select(*keep).toDF(*names)


def read_table(spark: SparkSession, path: str, sep: str | None = None, header: bool | None = None, charset: str | None = None, numeric_sentinels: bool = False) -> DataFrame:
    """A delimited file or folder as a table of texts: what is not given is found out; null tokens become null."""
    charset = charset or encoding(spark, path)
    lines = first_lines(spark, path, charset)
    sep = sep or separator(lines)
    header = has_header(lines, sep) if header is None else header
    if sep == r"\s+":
        rows = text_lines(spark, path, charset).where(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+").alias("c"))
        names = _cells(lines[0], sep) if header else [f"Column{i + 1}" for i in range(max(len(_cells(x, sep)) for x in lines if x.strip()))]
        df = rows.select(*[F.get("c", F.lit(i)).alias(n) for i, n in enumerate(names)])
        if header:
            df = df.where(~F.concat_ws(" ", *[F.col(f"`{n}`") for n in df.columns]).eqNullSafe(F.lit(" ".join(names))))
    else:
        df = spark.read.csv(path, sep=sep, header=header, mode="DROPMALFORMED", ignoreLeadingWhiteSpace=True, encoding=charset, multiLine=charset == "utf-16")
        if not header:
            df = df.toDF(*[f"Column{i + 1}" for i in range(len(df.columns))])
    return clean_names(normalise(df, numeric_sentinels))


def write_splits(train: DataFrame, test: DataFrame, path: str) -> None:
    """Both splits as one table, a folder for each."""
    train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")), allowMissingColumns=True).write.mode("overwrite").partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split; the folder of the other is not read."""
    return spark.read.parquet(path).where(F.col("split") == split).drop("split")


def write_json(df: DataFrame, path: str) -> None:
    """One object a line; NaN and infinities, which JSON does not have, become null."""
    floating = [f.name for f in df.schema.fields if f.dataType.typeName() in ("float", "double")]
    df = df.withColumns({c: finite(F.col(f"`{c}`")) for c in floating})
    df.write.mode("overwrite").json(path)
