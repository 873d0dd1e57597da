"""Metrics of predictions, as aggregates over a table of labels and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from . import profile


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """label, prediction, n for every two classes that occur, zeros included."""
    counts = df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))
    classes = counts.select(F.explode(F.array("label", "prediction")).alias("c")).distinct()
    grid = classes.select(F.col("c").alias("label")).crossJoin(classes.select(F.col("c").alias("prediction")))  # classes, not rows
    return grid.join(counts, ["label", "prediction"], "left").select("label", "prediction", F.coalesce("n", F.lit(0)).alias("n"))


def per_class(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """class, precision, recall, f1, support; 0 where there is nothing to divide by."""
    c = confusion(df, label, prediction)
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    true = c.groupBy(F.col("label").alias("class")).agg(F.sum("n").alias("support"), F.sum(hit).alias("hits"))
    told = c.groupBy(F.col("prediction").alias("class")).agg(F.sum("n").alias("predicted"))
    p, r = F.coalesce(F.try_divide("hits", "predicted"), F.lit(0.0)), F.coalesce(F.try_divide("hits", "support"), F.lit(0.0))
    both = true.join(told, "class").withColumns({"precision": p, "recall": r})
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return both.select("class", "precision", "recall", f1.alias("f1"), "support")


def classification(df: DataFrame, label: str = "label", prediction: str = "prediction", positive: Column | None = None) -> DataFrame:
    """One row: accuracy, and precision, recall and F1 weighted by support (or of the ``positive`` class alone)."""
    each = per_class(df, label, prediction)
    accuracy = df.agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"))
    if positive is not None:
        return each.where(F.col("class") == positive).select("precision", "recall", "f1").crossJoin(accuracy)
    mean = lambda c: (F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c)
    return each.agg(mean("precision"), mean("recall"), mean("f1")).crossJoin(accuracy)  # one row each


def regression(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: r2, mae, mse, rmse."""
    e = F.col(label) - F.col(prediction)
    one = df.agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.var_pop(label).alias("v"))
    return one.select((1 - F.try_divide("mse", "v")).alias("r2"), "mae", "mse", F.sqrt("mse").alias("rmse"))


def _curves(counts: DataFrame) -> DataFrame:
    """class, threshold, p, n, fpr, tpr of counts (class, threshold, p positives, n negatives): running shares from the highest threshold on.

    The running sums are over groups of thresholds of about equal size, so that no task holds all of a class.
    """
    spark = counts.sparkSession
    counts = cut(counts)
    marks = counts.groupBy("class").agg(F.percentile_approx("threshold", [i / 32 for i in range(1, 32)], 10000).alias("marks"))  # a row for each class
    below = F.size(F.filter(F.array_distinct("marks"), lambda m: F.col("threshold") < m))
    parted = counts.join(F.broadcast(marks), "class").select(*counts.columns, below.alias("part"))
    before, seen = [], {}
    for k, part, p, n in sorted(map(tuple, parted.groupBy("class", "part").agg(F.sum("p"), F.sum("n")).collect())):  # 32 rows a class
        p0, n0 = seen.get(k, (0, 0))
        before.append((k, part, p0, n0))
        seen[k] = (p0 + p, n0 + n)
    base = [(k, part, p0, n0, *seen[k]) for k, part, p0, n0 in before]
    base = spark.createDataFrame(base, "class int, part int, p0 long, n0 long, np long, nn long")
    w = Window.partitionBy("class", "part").orderBy(F.desc("threshold"))
    run = parted.join(F.broadcast(base), ["class", "part"])
    share = lambda c, start, all_: (F.sum(c).over(w) + F.col(start)) / F.greatest(F.col(all_), F.lit(1))
    return run.select("class", "threshold", "p", "n", "np", "nn", share("n", "n0", "nn").alias("fpr"), share("p", "p0", "np").alias("tpr"))


def _areas(curves: DataFrame) -> DataFrame:
    """class, auc: a positive wins against the negatives below its score, and half against those at it."""
    wins = F.col("p") * ((1 - F.col("fpr")) + F.try_divide(F.col("n"), F.col("nn")) / 2)
    return curves.groupBy("class").agg(F.try_divide(F.sum(wins), F.max("np")).alias("auc"))


def _hits(label: Column) -> list[Column]:
    hit = label.cast("long")
    return [F.sum(hit).alias("p"), F.sum(1 - hit).alias("n")]


def _binary(df: DataFrame, label: str, score: str) -> DataFrame:
    return df.groupBy(F.lit(1).alias("class"), F.col(score).cast("double").alias("threshold")).agg(*_hits(F.col(label)))


def _one_vs_rest(df: DataFrame, label: str, scores: str) -> DataFrame:
    each = df.select(F.col(label).cast("int").alias("_label"), F.posexplode(scores).alias("class", "threshold"))
    return each.groupBy("class", F.col("threshold").cast("double").alias("threshold")).agg(*_hits(F.col("_label") == F.col("class")))


def roc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """threshold, fpr, tpr: a point for each score that occurs, from the highest on."""
    return _curves(_binary(df, label, score)).select("threshold", "fpr", "tpr")


def auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row: area under the curve, from the mean rank of the positives (ties share their ranks)."""
    return _areas(_curves(_binary(df, label, score))).select("auc")


def roc_each(df: DataFrame, label: str = "label", scores: str = "scores") -> DataFrame:
    """class, threshold, fpr, tpr of each class against all others; ``scores`` has a number for each class, in order of their codes."""
    return _curves(_one_vs_rest(df, label, scores)).select("class", "threshold", "fpr", "tpr")


def auc_each(df: DataFrame, label: str = "label", scores: str = "scores") -> DataFrame:
    """class, auc of each class against all others; null for a class that all rows or none belong to."""
    return _areas(_curves(_one_vs_rest(df, label, scores)))


def residuals(df: DataFrame, key: str, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.select(key, F.col(prediction), F.col(label), (F.col(label) - F.col(prediction)).alias("residual"))


def qq(df: DataFrame, column: str, points: int = 99) -> DataFrame:
    """q, theoretical, sample: quantiles against those of the normal distribution, at even steps."""
    from statistics import NormalDist

    q = [(i + 1) / (points + 1) for i in range(points)]
    rows = [(p, NormalDist().inv_cdf(p), x) for p, x in zip(q, profile.quantiles(df, [column], q)[column])]
    return df.sparkSession.createDataFrame(rows, "q double, theoretical double, sample double")


def cluster_sizes(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    return df.groupBy(F.col(cluster).alias("cluster")).agg(F.count("*").alias("n"))


def cluster_summary(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """One row: clusters, rows of noise (cluster -1), their share, and the share of the largest cluster."""
    sizes = cluster_sizes(df, cluster)
    noise = F.coalesce(F.sum(F.when(F.col("cluster") == -1, F.col("n"))), F.lit(0))
    return sizes.agg(F.count_if(F.col("cluster") >= 0).alias("n_clusters"), noise.alias("n_noise"), (noise / F.sum("n")).alias("noise_ratio"), (F.max(F.when(F.col("cluster") >= 0, F.col("n"))) / F.sum("n")).alias("largest"))


def cluster_indices(df: DataFrame, vector: str = "v", cluster: str = "cluster") -> DataFrame:
    """One row: Calinski-Harabasz and Davies-Bouldin of array vectors; noise left out. Linear in the rows."""
    rows = df.where(F.col(cluster) >= 0).select(F.col(cluster).alias("c"), F.col(vector).cast("array<double>").alias("v"))
    long = rows.select("c", F.posexplode("v").alias("i", "x"))
    centre = long.groupBy("c", "i").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    centres = centre.groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("m"), F.max("n").alias("n"))
    table = {r["c"]: (r["m"], r["n"]) for r in centres.collect()}  # a row for each cluster
    n, k = sum(v[1] for v in table.values()), len(table)
    if k < 2 or n <= k:
        return df.sparkSession.createDataFrame([(None, None)], "calinski_harabasz double, davies_bouldin double")
    dim = len(next(iter(table.values()))[0])
    grand = [sum(m[i] * c for m, c in table.values()) / n for i in range(dim)]
    between = sum(c * sum((m[i] - grand[i]) ** 2 for i in range(dim)) for m, c in table.values())
    joined = rows.join(F.broadcast(centres.select("c", "m")), "c")
    d2 = F.aggregate(F.zip_with("v", "m", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)
    spread = {r["c"]: (r["w"], r["s"]) for r in joined.groupBy("c").agg(F.sum(d2).alias("w"), F.avg(F.sqrt(d2)).alias("s")).collect()}
    within = sum(w for w, _ in spread.values())
    ch = (between / (k - 1)) / (within / (n - k)) if within else None
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(table[a][0], table[b][0])) ** 0.5
    db = sum(max((spread[a][1] + spread[b][1]) / gap(a, b) for b in table if b != a and gap(a, b) > 0) for a in table) / k
    return df.sparkSession.createDataFrame([(ch, db)], "calinski_harabasz double, davies_bouldin double")


def generalization(results: DataFrame, factor: float = 2.0) -> DataFrame:
    """``results`` (model, train_score, cv_score) with gap, rejected, penalty, generalization and overfitting."""
    gap = F.abs(F.col("train_score") - F.col("cv_score"))
    times = F.when(F.col("gap") > 0.20, 5.0).when(F.col("gap") > 0.10, 3.0).otherwise(factor)
    out = results.withColumn("gap", gap).withColumns({"rejected": F.col("gap") > 0.20, "penalty": F.col("gap") * times, "overfitting": F.col("gap") > 0.05})
    return out.withColumn("generalization", F.col("cv_score") - F.col("penalty"))


def ranked(results: DataFrame) -> DataFrame:
    """Models in order: those not rejected by score; if all are rejected, by the smallest gap. A row for each model."""
    scored = generalization(results)
    alone = Window.partitionBy()
    all_out = F.min(F.col("rejected").cast("int")).over(alone) == 1
    order = Window.orderBy(F.col("rejected"), F.when(F.col("all_out"), F.col("gap")).otherwise(-F.col("generalization")), "model")
    return scored.withColumn("all_out", all_out).withColumn("rank", F.row_number().over(order)).drop("all_out")


def anomaly_summary(df: DataFrame, label: str = "anomaly_label", score: str = "anomaly_score", vector: str | None = None) -> DataFrame:
    """One row: rows outside and inside, the ratio, the spread of scores, and with ``vector`` the silhouette of the split."""
    out = F.count_if(F.col(label) == -1)
    one = df.agg(out.alias("n_out"), F.count_if(F.col(label) != -1).alias("n_in"), (out / F.count("*")).alias("ratio"), F.avg(score).alias("mean_score"), F.stddev_samp(score).alias("std_score"))
    return one if vector is None else one.crossJoin(split_silhouette(df, label, vector))  # one row each


def split_silhouette(df: DataFrame, cluster: str, vector: str) -> DataFrame:
    """One row: the mean silhouette with squared distances, linear in the rows; -1 where there is one cluster only.

    The mean squared distance of a row to a cluster follows from the cluster's size, sum and sum of squares.
    """
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    rows = df.select(F.col(cluster).alias("c"), F.col(vector).cast("array<double>").alias("v")).withColumn("q", dot("v", "v"))
    sums = rows.select("c", F.posexplode("v").alias("i", "x")).groupBy("c", "i").agg(F.sum("x").alias("s"))
    sums = sums.groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda z: z["s"]).alias("s"))
    each = rows.groupBy("c").agg(F.count("*").alias("n"), F.sum("q").alias("qs")).join(sums, "c").withColumnRenamed("c", "other")
    table = each.agg(F.collect_list(F.struct("other", "n", "qs", "s")).alias("t"))
    scored = rows.crossJoin(F.broadcast(table))  # one row
    to = lambda keep: F.transform(F.filter("t", keep), lambda k: (k["n"] * F.col("q") - 2 * dot(F.col("v"), k["s"]) + k["qs"]) / F.when(k["other"] == F.col("c"), F.greatest(k["n"] - 1, F.lit(1))).otherwise(k["n"]))
    a, b = F.array_max(to(lambda k: k["other"] == F.col("c"))), F.array_min(to(lambda k: k["other"] != F.col("c")))
    alone = F.exists("t", lambda k: (k["other"] == F.col("c")) & (k["n"] == 1))
    s = F.when(alone | (F.greatest(a, b) == 0), 0.0).otherwise((b - a) / F.greatest(a, b))
    return scored.agg(F.coalesce(F.avg(F.when(b.isNotNull(), s)), F.lit(-1.0)).alias("silhouette"))
