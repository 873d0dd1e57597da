"""Tables of datasets and model runs: joins, comparisons, timelines and the dashboard's numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_dataset(models: DataFrame, datasets: DataFrame) -> DataFrame:
    """Models with the name of their dataset, 'Unknown' where it is gone."""
    names = datasets.select("dataset_id", F.col("name").alias("dataset_name"))
    return models.join(names, "dataset_id", "left").withColumn("dataset_name", F.coalesce("dataset_name", F.lit("Unknown")))


def compare(models: DataFrame, ids: Sequence[int]) -> DataFrame:
    """The models with the given ids; ids that do not exist are passed over."""
    return models.where(F.col("model_id").isin(list(ids)))


def find(df: DataFrame, equal: dict | None = None, either: Sequence[dict] = (), exists: dict[str, bool] | None = None) -> DataFrame:
    """Rows with equal values, any of several sets of equal values, and columns that are (not) null."""
    for c, v in (equal or {}).items():
        df = df.where(F.col(c).eqNullSafe(F.lit(v)))
    if either:
        any_of = F.lit(False)
        for alternative in either:
            one = F.lit(True)
            for c, v in alternative.items():
                one = one & F.col(c).eqNullSafe(F.lit(v))
            any_of = any_of | one
        df = df.where(any_of)
    for c, there in (exists or {}).items():
        df = df.where(F.col(c).isNotNull() if there else F.col(c).isNull())
    return df


def sort(df: DataFrame, by: str, descending: bool = False) -> DataFrame:
    c = F.lower(by) if dict(df.dtypes)[by] == "string" else F.col(by)
    return df.orderBy(c.desc() if descending else c.asc())


def top(df: DataFrame, by: str, n: int = 10, least: float | None = None) -> DataFrame:
    """The n rows with the largest absolute values: a report, so limited."""
    rows = df.where(F.abs(by) > least) if least is not None else df
    return rows.orderBy(F.abs(by).desc(), df.columns[0]).limit(n)


def timeline(n: int = 15, **events: DataFrame) -> DataFrame:
    """The newest events (at, name) of several kinds together."""
    out = None
    for kind, df in events.items():
        part = df.select(F.lit(kind).alias("kind"), "at", "name")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    assert out is not None
    return out.orderBy(F.desc("at"), "kind", "name").limit(n)


def dashboard(models: DataFrame, datasets: DataFrame) -> DataFrame:
    """One row: totals, the best model, the newest dataset, and what needs attention."""
    m = models.agg(F.count("*").alias("n_models"), F.max_by("name", F.struct("score", "name")).alias("best_model"), F.max("score").alias("best_score"), F.count_if(F.col("score") < 0.6).alias("n_weak"))
    newest = F.struct("at", "name")
    share = [F.max_by("missing_pct", newest).alias("latest_missing_pct")] if "missing_pct" in datasets.columns else []
    d = datasets.agg(F.count("*").alias("n_datasets"), F.max_by("name", newest).alias("latest"), *share, F.count_if(~F.col("processed")).alias("n_unprocessed"))
    return m.crossJoin(d)  # one row each


def attention(models: DataFrame, datasets: DataFrame, weak: float = 0.6, n: int = 5) -> DataFrame:
    """type, severity, total, names: what to look at, with the first ``n`` names of each kind (a report, so limited)."""
    none = F.lit(False)
    kinds = [
        ("unprocessed_datasets", "warning", datasets.where(~F.col("processed")), "dataset_id"),
        ("low_accuracy", "error", models.where(F.coalesce("score", F.lit(0.0)) < weak), "model_id"),
        ("class_imbalance", "info", models.where(F.coalesce("imbalanced", none) if "imbalanced" in models.columns else none), "model_id"),
    ]
    out = None
    for kind, severity, rows, key in kinds:
        first = rows.orderBy(key).limit(n).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "name"))), lambda x: x["name"]), ",").alias("names"))
        one = rows.agg(F.count("*").alias("total")).where("total > 0").crossJoin(first).select(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), "total", "names")  # one row each
        out = one if out is None else out.union(one)
    return out


def model_table(models: DataFrame, datasets: DataFrame) -> DataFrame:
    """Models with their dataset's name and a rounded score, the newest first."""
    return with_dataset(models, datasets).withColumn("score", F.round("score", 4)).orderBy(F.desc("created"), "model_id")
