"""Decisions per column, from profiles: how to impute, encode and scale, and which family a model belongs to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import profile

# Families of models.
FAMILIES = {
    "decision_tree": "tree", "random_forest": "tree", "gradient_boosting": "tree", "xgboost": "tree", "lightgbm": "tree", "adaboost": "tree", "isolation_forest": "tree",
    "logistic_regression": "linear", "linear_regression": "linear", "ridge": "linear", "lasso": "linear", "elastic_net": "linear", "svm": "linear", "svr": "linear",
    "knn": "distance", "kmeans": "distance", "minibatch_kmeans": "distance", "dbscan": "distance", "hierarchical": "distance", "lof": "distance", "pca": "distance",
    "neural_network": "neural",
}
DEFAULT_FAMILY = {"classification": "tree", "regression": "linear", "unsupervised": "distance"}


def family_of(task: str, model: str | None = None) -> str:
    return FAMILIES.get(model or "", DEFAULT_FAMILY[task])


def imputation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, missing, rows, outlier_share, strategy.

    Above 80 % missing: drop. Above 50 %: a constant of its own. From 20 %: by neighbours on tables of at most
    1000 rows, the median otherwise. From 5 %: neighbours up to 500 rows, else by outliers. Less: the median where
    over a tenth are outliers, the mean otherwise; nothing where nothing is missing.
    """
    kinds = {r["column"]: r["kind"] for r in profile.column_kinds(df).collect()}
    numbers = [c for c in columns if kinds[c] == "numeric"]
    share = profile.per_column(df, columns, lambda c: {"missing": F.avg(c.isNull().cast("double")), "rows": F.count("*")})
    out = profile.outliers(df, numbers) if numbers else None
    rows = share if out is None else share.join(F.broadcast(out.select("column", (F.col("pct") / 100).alias("outlier_share"))), "column", "left")  # a row for each column
    if out is None:
        rows = rows.withColumn("outlier_share", F.lit(None).cast("double"))
    numeric = F.col("column").isin(numbers)
    skewed = F.coalesce(F.col("outlier_share") > 0.1, F.lit(False))
    by_outliers = F.when(skewed, "median").otherwise("mean")
    m = F.col("missing")
    strategy = (
        F.when(m == 0, "none")
        .when(m > 0.8, "drop")
        .when(m > 0.5, F.when(numeric, "constant").otherwise("constant"))
        .when(~numeric, "mode")
        .when(m >= 0.2, F.when(F.col("rows") <= 1000, "knn").otherwise("median"))
        .when(m >= 0.05, F.when(F.col("rows") <= 500, "knn").otherwise(by_outliers))
        .otherwise(by_outliers)
    )
    return rows.select("column", "missing", "rows", "outlier_share", strategy.alias("strategy"))


def encoding(df: DataFrame, columns: Sequence[str], family: str) -> DataFrame:
    """column, n_distinct, strategy: codes for trees and above 50 values, 0/1 columns otherwise."""
    cats = profile.categorical(df, columns)
    return cats.select("column", "n_distinct", F.when(F.lit(family == "tree") | (F.col("n_distinct") > 50), "ordinal").otherwise("one_hot").alias("strategy"))


def scaling(df: DataFrame, columns: Sequence[str], family: str, share: float = 0.0) -> DataFrame:
    """column, strategy: none for trees, minmax for neural networks, else robust where there are outliers and standard where not."""
    out = profile.outliers(df, columns).select("column", (F.col("n_outliers") > share * F.lit(1)).alias("has"))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "`column` string")
    fixed: Column | None = {"tree": F.lit("none"), "neural": F.lit("minmax")}.get(family)
    both = names.join(F.broadcast(out), "column", "left")
    return both.select("column", (fixed if fixed is not None else F.when(F.coalesce("has", F.lit(False)), "robust").otherwise("standard")).alias("strategy"))


def as_dict(decisions: DataFrame) -> dict[str, str]:
    """column -> strategy: a row for each column."""
    return {r["column"]: r["strategy"] for r in decisions.select("column", "strategy").collect()}
