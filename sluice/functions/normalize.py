"""Clean-up of raw columns: null tokens, number and time formats, and what type a text column really has."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that mean "missing" in delimited files (compared after trimming).
NULL_TOKENS = (
    "?", "??",
    "NA", "N/A", "n/a", "na", "Na",
    "NULL", "null", "Null",
    "None", "none", "NONE",
    "NaN", "nan", "NAN",
    "", " ", "  ", "\t",
    "-", "--", "---", "_", "__",
    "N.A.", "n.a.",
    "Not Available", "not available", "NOT AVAILABLE",
    "Not Applicable", "not applicable", "NOT APPLICABLE",
    "Missing", "missing", "MISSING",
    "Unknown", "unknown", "UNKNOWN",
    "Undefined", "undefined", "UNDEFINED",
    "*", "**", "#N/A", "#NA",
    "NIL", "nil", "Nil",
    "BLANK", "blank", "Blank",
)
# Numbers that stand for "missing".
NUMERIC_SENTINELS = ("-999", "-9999", "999", "9999", "-1", "inf", "-inf", "Inf", "-Inf", "INF", "-INF")

DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "M/d/yyyy", "M-d-yyyy")
DAY_FIRST_FORMATS = ("d/M/yyyy", "d-M-yyyy", "d.M.yyyy")


def null_tokens_to_null(c: Column, tokens: Sequence[str] = NULL_TOKENS, numeric_sentinels: bool = False) -> Column:
    """The column, with null where the trimmed text is a token for missing data."""
    every = [*tokens, *(NUMERIC_SENTINELS if numeric_sentinels else ())]
    return F.when(~F.trim(c).isin([t.strip() for t in every]), c)


def finite(c: Column) -> Column:
    """A floating column with null for NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def normalise(df: DataFrame, numeric_sentinels: bool = False) -> DataFrame:
    """Null tokens in texts, and NaN or infinite numbers, become null in every column."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            c = null_tokens_to_null(c, numeric_sentinels=numeric_sentinels)
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = finite(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def decimal_comma(c: Column) -> Column:
    """``2,5`` as 2.5; null where it is no number."""
    return F.replace(c, F.lit(","), F.lit(".")).try_cast("double")


def dotted_time(c: Column) -> Column:
    """``18.00.00`` as ``18:00:00``."""
    return F.when(c.rlike(r"^\d{1,2}\.\d{2}\.\d{2}"), F.replace(c, F.lit("."), F.lit(":"))).otherwise(c)


def parse_timestamp(c: Column, day_first: bool = False, fall_back: bool = True) -> Column:
    """A timestamp by the first format that fits; null if none does. Without ``fall_back``, in the asked order of day and month alone."""
    iso = DATE_FORMATS[:3]
    formats = (*iso, *DAY_FIRST_FORMATS) if day_first else DATE_FORMATS
    if fall_back:
        formats = (*formats, *(DATE_FORMATS[3:] if day_first else DAY_FIRST_FORMATS))
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def format_ratios(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row per text column: shares of its non-null values with each format, from one pass over the table.

    ``number``: converts to double; ``comma``: decimal comma; ``dotted``: dotted time; ``date``: looks like a date
    or time; ``parsed`` and ``day_first``: values that parse as timestamps in either order.
    """

    def share(c: Column, test: Column) -> Column:
        return F.try_divide(F.count_if(test).cast("double"), F.count(c))

    each = []
    for name in columns:
        c = F.col(f"`{name}`")
        each.append(
            F.struct(
                F.lit(name).alias("column"),
                F.count(c).alias("n"),
                share(c, c.try_cast("double").isNotNull()).alias("number"),
                share(c, c.rlike(r"^-?\d+,\d+$")).alias("comma"),
                share(c, c.rlike(r"^\d{1,2}\.\d{2}\.\d{2}")).alias("dotted"),
                share(c, c.rlike(r"^\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|^\d{1,2}:\d{2}")).alias("date"),
                share(c, parse_timestamp(c, fall_back=False).isNotNull()).alias("parsed"),
                share(c, parse_timestamp(c, day_first=True, fall_back=False).isNotNull()).alias("day_first"),
            )
        )
    return df.agg(F.array(*each).alias("a")).select(F.inline("a"))


def infer_types(df: DataFrame, columns: Sequence[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """Text columns in the type that most of their values have, and what was decided for each.

    Over half decimal commas, or over 80 % numbers: double. Over half dotted times: written with colons. Over
    half dates: timestamp, day first where that parses more values. All values timestamps: timestamp.
    """
    names = list(columns) if columns is not None else [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not names:
        return df, {}
    kinds, new = {}, {}
    for r in format_ratios(df, names).collect():  # a row for each column
        c = F.col(f"`{r['column']}`")
        number, comma, dotted, date, parsed, first = (r[k] or 0.0 for k in ("number", "comma", "dotted", "date", "parsed", "day_first"))
        if comma > 0.5:
            kinds[r["column"]], new[r["column"]] = "double", decimal_comma(c)
        elif number > 0.8:
            kinds[r["column"]], new[r["column"]] = "double", c.try_cast("double")
        elif (date > 0.5 and max(parsed, first) > 0.5) or max(parsed, first) == 1.0:
            kinds[r["column"]], new[r["column"]] = "timestamp", parse_timestamp(c, day_first=first > parsed)
        elif dotted > 0.5:
            kinds[r["column"]], new[r["column"]] = "time", dotted_time(c)
        else:
            kinds[r["column"]] = "string"
    return df.withColumns(new), kinds
