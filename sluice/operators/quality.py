"""Quality scores, recommendations and summaries of what preparation changed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import profile


def _band(score: Column, cuts: Sequence[tuple[float, str]], last: str) -> Column:
    out = F.when(score >= cuts[0][0], cuts[0][1])
    for at, name in cuts[1:]:
        out = out.when(score >= at, name)
    return out.otherwise(last)


def basic_score(df: DataFrame) -> DataFrame:
    """One row: 100 - 50 * missing share - 30 * duplicate share, and its band."""
    cells = profile.missing_total(df).select("n_missing")
    dup = profile.duplicates(df).select("n_duplicates")
    rows = df.agg(F.count("*").alias("n_rows"))
    one = cells.crossJoin(dup).crossJoin(rows)  # three tables of one row
    score = F.round(100 - F.try_divide(F.col("n_missing") * 50.0, F.col("n_rows") * len(df.columns)) - F.try_divide(F.col("n_duplicates") * 30.0, F.col("n_rows")), 4)
    return one.select(score.alias("score")).withColumn("band", _band(F.col("score"), [(90, "excellent"), (70, "good"), (50, "fair")], "poor"))


def full_score(df: DataFrame, numeric: Sequence[str], texts: Sequence[str], low_variance: Sequence[str] = ()) -> DataFrame:
    """One row: the seven penalties and the score 100 - their sum, not below 0, with its band."""
    n = df.count()
    missing, dup = profile.missing_total(df).head(), profile.duplicates(df).head()
    shape = profile.distribution(df, numeric)
    out = profile.outliers(df, numeric)
    rare = profile.rare_values(df, texts) if texts else None
    pairs = profile.correlations(df, numeric) if len(numeric) > 1 else None
    n_out = out.agg(F.coalesce(F.sum("n_outliers"), F.lit(0))).head()[0]
    skewed = shape.where(F.abs("skewness") > 2).count()
    n_rare = rare.count() if rare is not None else 0
    strong = pairs.where(F.abs("r") > 0.9).count() if pairs is not None else 0
    n_pairs = max(1, len(numeric) * (len(numeric) - 1) // 2)
    parts = {
        "p_missing": missing["n_missing"] / max(1, n * len(df.columns)) * 25,
        "p_duplicates": dup["n_duplicates"] / max(1, n) * 15,
        "p_outliers": min(20.0, n_out / max(1, n * len(numeric)) * 100),
        "p_skew": skewed / max(1, len(numeric)) * 10,
        "p_rare": min(15.0, n_rare / max(1, 5 * len(texts)) * 15),
        "p_low_variance": len(low_variance) / max(1, len(df.columns)) * 10,
        "p_correlation": strong / n_pairs * 10,
    }
    score = max(0.0, 100 - sum(parts.values()))
    band = next((b for at, b in ((90, "excellent"), (75, "good"), (60, "fair"), (40, "poor")) if score >= at), "critical")
    row = [*(round(float(v), 4) for v in parts.values()), round(float(score), 4), band]
    return df.sparkSession.createDataFrame([tuple(row)], ", ".join(f"{k} double" for k in [*parts, "score"]) + ", band string")


def recommendations(df: DataFrame, numeric: Sequence[str], texts: Sequence[str]) -> DataFrame:
    """type, category, message, action, columns (comma-joined, sorted): a row for everything that deserves a look."""
    missing = profile.missing(df)
    distinct = profile.value_counts(df, [*numeric, *texts]).where("value is not null").groupBy("column").agg(F.count("*").alias("n"))
    none = df.limit(0).select(F.lit("").alias("column"))
    pairs = profile.correlated_pairs(df, numeric, 0.9).select(F.explode(F.array("f1", "f2")).alias("column")).distinct() if len(numeric) > 1 else none
    found = [
        ("warning", "missing_values", "over half of the values are missing", "drop_columns", missing.where("pct_missing > 50")),
        ("info", "missing_values", "some values are missing", "impute", missing.where("pct_missing > 0 and pct_missing <= 50")),
        ("warning", "duplicates", "some rows repeat others", "remove_duplicates", profile.duplicates(df).where("has_duplicates").select(F.lit("*").alias("column"))),
        ("warning", "constant_features", "one value at most", "drop_columns", distinct.where("n <= 1")),
        ("info", "encoding", "over 50 different values", "encode_or_bin", distinct.where(F.col("column").isin(list(texts)) & (F.col("n") > 50))),
        ("warning", "rare_values", "values of under 2 % beside dominant ones, possibly typing errors", "remove_rows", profile.rare_values(df, texts) if texts else none),
        ("info", "outliers", "over 5 % of the values are outliers", "handle_outliers", profile.outliers(df, numeric).where("pct > 5") if numeric else none),
        ("info", "correlation", "strongly correlated with another column", "remove_correlated", pairs),
    ]
    rows = None
    for kind, category, message, action, columns in found:
        one = columns.agg(F.array_join(F.array_sort(F.collect_set("column")), ",").alias("columns")).where("columns <> ''")
        one = one.select(*[F.lit(x).alias(n) for n, x in (("type", kind), ("category", category), ("message", message), ("action", action))], "columns")
        rows = one if rows is None else rows.union(one)
    fine = rows.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("success"), F.lit("quality"), F.lit("nothing stands out"), F.lit("none"), F.lit(""))
    return rows.union(fine)


def change_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: what preparation removed and filled, and the shares kept and complete."""
    n0, n1 = before.count(), after.count()
    m0, m1 = profile.missing_total(before).head()["n_missing"], profile.missing_total(after).head()["n_missing"]
    c0, c1 = max(1, n0 * len(before.columns)), max(1, n1 * len(after.columns))
    filled = max(0, m0 - m1)
    row = (n0 - n1, len(before.columns) - len(after.columns), filled, round(n1 / max(1, n0), 6), round(100 - 30 * filled / c0, 6), round(100 - 100 * m0 / c0, 6), round(100 - 100 * m1 / c1, 6))
    return before.sparkSession.createDataFrame([row], "rows_removed long, columns_removed long, cells_filled long, retention double, quality double, complete_before double, complete_after double")
