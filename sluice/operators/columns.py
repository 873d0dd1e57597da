"""Which columns are ids, constant, of low variance, mostly missing or text; and what role each column has."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import profile


@dataclass(frozen=True)
class ColumnRoles:
    numerical: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    datetime: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    ids: list[str] = field(default_factory=list)
    constant: list[str] = field(default_factory=list)
    high_missing: list[str] = field(default_factory=list)
    low_variance: list[str] = field(default_factory=list)
    target: str | None = None


#: Standard error of the approximate counts below; a column is decided by one only if it is 15 such errors and more off a limit.
ERROR = 0.02


def screen(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, Row]:
    """What one pass without a shuffle tells of each column, by name: kind, rows, n (not null), about (approximate
    number of values), lo and hi as whole numbers (numeric columns), same (one value or none), missing (share of nulls
    and of the text 'nan'), and mean and std (numeric columns)."""
    kinds = {r["column"]: r["kind"] for r in profile.column_kinds(df).collect()}
    names = [c for c in columns or df.columns if kinds[c] != "other"]

    def facts(c: Column, kind: str) -> dict[str, Column]:
        number = kind == "numeric"
        x = c.cast("double") if number else F.lit(None).cast("double")
        nan = F.isnan(x) if number else F.lower(c.cast("string")) == "nan" if kind == "categorical" else F.lit(False)
        whole = lambda v: v.try_cast("long") if number else F.lit(None).cast("long")
        return {
            "rows": F.count("*"), "n": F.count(c), "about": F.approx_count_distinct(c, ERROR), "lo": whole(F.min(c)), "hi": whole(F.max(c)),
            "same": F.coalesce(F.min(c) == F.max(c), F.lit(True)), "missing": F.avg((c.isNull() | nan).cast("double")),
            "mean": F.avg(x), "std": F.stddev_samp(x),
        }

    out = {}
    for kind in ("numeric", "categorical", "datetime"):
        chosen = [c for c in names if kinds[c] == kind]
        for r in profile.per_column(df, chosen, lambda c, kind=kind: facts(c, kind)).collect() if chosen else []:
            out[r["column"]] = Row(kind=kinds[r["column"]], **r.asDict())
    return {c: out[c] for c in names}


def exact_distinct(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """The number of values (but null) of each column."""
    if not columns:
        return {}
    return {r["column"]: r["n"] for r in profile.value_counts(df, columns).groupBy("column").agg(F.count("value").alias("n")).collect()}


#: Names of id columns in the third variant; fixed values.
ID_PARTS = ("_id", "customerid", "userid", "rowid", "index", "record_id", "row_number", "serial")


def id_columns(df: DataFrame, mode: str = "adaptive") -> DataFrame:
    """column, is_id. ``adaptive``: name, and nearly unique or a sequence; ``basic``: name, or unique, or a sequence;
    ``unsupervised``: a name from a longer list with near-uniqueness, or a unique sequence of over 10 numbers.

    Values are counted exactly only in columns that their names, ends and approximate counts leave open. Columns of
    nulls are no ids, but by their name in ``basic``.
    """
    seen = screen(df)
    ids = _ids(df, seen, mode)
    return df.sparkSession.createDataFrame([(c, c in ids) for c in seen], "`column` string, is_id boolean")


def _ids(df: DataFrame, seen: dict[str, Row], mode: str) -> set[str]:
    def named(c: str) -> bool:
        low = c.lower()
        return any(p in low for p in ID_PARTS) or low in ("id", "idx") if mode == "unsupervised" else profile.id_like(c)

    def least(c: str) -> float:
        return 0.9 if mode == "unsupervised" and seen[c]["kind"] != "numeric" else 0.95

    dense = {c for c, r in seen.items() if r["n"] and r["hi"] is not None and r["lo"] is not None and r["hi"] - r["lo"] + 1 == r["n"]}
    near = lambda c, share: seen[c]["about"] > (share - 15 * ERROR) * seen[c]["n"]
    some = [c for c, r in seen.items() if r["n"]]
    if mode == "adaptive":
        some = [c for c in some if named(c) and seen[c]["kind"] != "datetime" and near(c, 0.95)]
        exact = exact_distinct(df, some)
        return {c for c, n in exact.items() if n / seen[c]["n"] > 0.95 or (n == seen[c]["n"] and c in dense and seen[c]["lo"] in (0, 1))}
    if mode == "basic":
        exact = exact_distinct(df, [c for c in some if not named(c) and near(c, 1.0)])
        return {c for c in seen if named(c)} | {c for c, n in exact.items() if n == seen[c]["n"]}
    exact = exact_distinct(df, [c for c in some if (named(c) and near(c, least(c))) or (c in dense and seen[c]["n"] > 10 and near(c, 1.0))])
    return {c for c, n in exact.items() if (named(c) and n / seen[c]["n"] > least(c)) or (c in dense and n == seen[c]["n"] and n > 10)}


def constant_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, n_distinct (non-null), is_constant."""
    names = list(columns or df.columns)
    counts = profile.value_counts(df, names).groupBy("column").agg(F.count("value").alias("n_distinct"))
    return counts.withColumn("is_constant", F.col("n_distinct") <= 1)


def low_variance_columns(df: DataFrame, columns: Sequence[str] | None = None, share: float = 0.95, cv: float = 0.5) -> DataFrame:
    """column, modal_share (null is a value), cv, is_low: one value dominates, and a number does not vary much either."""
    names = list(columns or df.columns)
    modal = profile.value_counts(df, names).groupBy("column").agg((F.max("n") / F.sum("n")).alias("modal_share"))
    numbers = [c for c in names if c in set(profile.numeric_columns(df))]
    varies = F.lit(False)
    if numbers:
        spread = profile.per_column(df, numbers, lambda c: {"std": F.stddev_samp(c.cast("double")), "mean": F.avg(c.cast("double"))})
        modal = modal.join(F.broadcast(spread), "column", "left")
        tiny = F.abs("mean") < 1e-10
        varies = F.coalesce(F.when(tiny, F.col("std") > 1e-10).otherwise(F.abs(F.col("std") / F.nullif("mean", F.lit(0.0))) > cv), F.lit(False))
        modal = modal.withColumn("cv", F.abs(F.col("std") / F.nullif("mean", F.lit(0.0))))
    else:
        modal = modal.withColumn("cv", F.lit(None).cast("double"))
    return modal.withColumn("is_low", (F.col("modal_share") > share) & ~varies).select("column", "modal_share", "cv", "is_low")


def missing_columns(df: DataFrame, columns: Sequence[str] | None = None, limit: float = 0.6) -> DataFrame:
    """column, share (nulls and the text 'nan'), is_high."""
    rows = profile.per_column(df, columns or df.columns, lambda c: {"share": F.avg((c.isNull() | (F.lower(c.cast("string")) == "nan")).cast("double"))})
    return rows.withColumn("is_high", F.col("share") > limit)


def text_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, avg_len, n_distinct, is_text: long and varied, or long with words or punctuation."""
    names = list(columns or profile.text_columns(df))
    rows = profile.per_column(df, names, lambda c: {"n": F.count(c), "avg_len": F.avg(F.length(c)), "spaced": F.avg(c.rlike(r"\s").cast("double")), "marked": F.avg(c.rlike("[.,!?;:]").cast("double"))})
    distinct = profile.value_counts(df, names).where("value is not null").groupBy("column").agg(F.count("*").alias("n_distinct"))
    both = rows.join(F.broadcast(distinct), "column")
    varied = (F.col("avg_len") > 30) & (F.col("n_distinct") > 50) & (F.col("n_distinct") / F.col("n") > 0.5)
    worded = (F.col("avg_len") > 50) & ((F.col("spaced") > 0.5) | (F.col("marked") > 0.3))
    return both.select("column", "avg_len", "n_distinct", (varied | worded).alias("is_text"))


def verdicts(df: DataFrame, target: str | None = None) -> DataFrame:
    """column, verdict of problem columns: id, then high_missing, constant, low_variance. None if under two features would stay."""
    names = [c for c in df.columns if c != target]
    kinds = {r["column"]: r["kind"] for r in profile.column_kinds(df).collect()}
    usable = [c for c in names if kinds[c] != "other"]
    features = df.select(*[F.col(f"`{c}`") for c in usable])
    seen = screen(features)
    ids = _ids(features, seen, "adaptive")
    found = {c: "id" if c in ids else "high_missing" if (r["missing"] or 0) > 0.6 else "constant" for c, r in seen.items() if c in ids or (r["missing"] or 0) > 0.6 or r["same"]}
    few = [c for c, r in seen.items() if c not in found and r["about"] <= (0.05 + 15 * ERROR) * r["rows"] + 10]  # a value in 95 % of the rows leaves no more
    if few:
        found |= {r["column"]: "low_variance" for r in low_variance_columns(features, few).where("is_low").collect()}
    if len(usable) - len(found) < 2:
        found = {}
    return df.sparkSession.createDataFrame([(c, found[c]) for c in usable if c in found], "`column` string, verdict string")


def drop_problem_columns(df: DataFrame, target: str | None = None) -> tuple[DataFrame, dict[str, str]]:
    found = {r["column"]: r["verdict"] for r in verdicts(df, target).collect()}
    return df.drop(*found), found


def binary_or_low(df: DataFrame, columns: Sequence[str] | None = None, most: int = 5) -> DataFrame:
    """column, is_binary (values within 0 and 1), is_low_integer (whole numbers of few values): both count as categorical."""
    names = list(columns or profile.numeric_columns(df))
    whole = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))}
    rows = profile.per_column(df, names, lambda c: {"binary": F.coalesce(F.bool_and(c.isin(0, 1)), F.lit(False))})
    distinct = profile.value_counts(df, names).where("value is not null").groupBy("column").agg(F.count("*").alias("n_distinct"))
    return rows.join(F.broadcast(distinct), "column").select("column", F.col("binary").alias("is_binary"), (F.col("column").isin(*whole) & (F.col("n_distinct") <= most)).alias("is_low_integer"))


def roles(df: DataFrame, target: str | None = None, find_text: bool = True) -> ColumnRoles:
    """The role of every column, from its type and a few profiles."""
    found = {r["column"]: r["verdict"] for r in verdicts(df, target).collect()}
    kinds = {r["column"]: r["kind"] for r in profile.column_kinds(df).collect() if r["column"] != target and r["column"] not in found}
    texts = [c for c, k in kinds.items() if k == "categorical"]
    long = {r["column"] for r in text_columns(df, texts).collect() if r["is_text"]} if texts and find_text else set()
    of = lambda v: [c for c, x in found.items() if x == v]
    return ColumnRoles(
        [c for c, k in kinds.items() if k == "numeric"], [c for c in texts if c not in long], [c for c, k in kinds.items() if k == "datetime"], sorted(long),
        of("id"), of("constant"), of("high_missing"), of("low_variance"), target,
    )


def task_type(df: DataFrame, target: str | None) -> str:
    """unsupervised, regression or classification, from the target column."""
    if target is None:
        return "unsupervised"
    kind = df.schema[target].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "regression"
    if isinstance(kind, T.NumericType):
        return df.agg(F.when(F.count_distinct(target) / F.count(target) > 0.05, "regression").otherwise("classification")).head()[0]
    return "classification"

