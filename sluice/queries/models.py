"""Metrics, neighbours, rebalancing, preparation, models, catalog, sources and streams (A, J, M, S, T, L and U operators)."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import catalog, metrics, neighbours, resample, rows, transforms
from ..plans import models, policy, prepare
from ..session import cut, shared_dir, stored
from ..sources import readers
from ..streaming import scoring
from . import load, query
from .inputs import ORDERS_SQL, orders

PREDICTIONS = ("o_orderkey AS id", "CAST(o_orderkey % 3 AS INT) AS label", "CAST((CASE WHEN o_custkey % 4 = 0 THEN o_orderkey + 1 ELSE o_orderkey END) % 3 AS INT) AS prediction")
PRED_SQL = "SELECT " + ", ".join(PREDICTIONS) + " FROM orders"
BINARY = ("o_orderkey AS id", "CAST(o_orderkey % 2 AS INT) AS label", "CAST(o_custkey % 50 + (o_orderkey % 2) * 10 AS DOUBLE) AS score")
BIN_SQL = "SELECT " + ", ".join(BINARY) + " FROM orders"
NUMERIC = ("o_orderkey AS id", "o_totalprice AS label", "o_totalprice * 0.9 + o_custkey % 100 AS prediction")
NUM_SQL = "SELECT " + ", ".join(NUMERIC) + " FROM orders"


def _folder(spark: SparkSession) -> str:
    """A new folder among the shared ones."""
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def _r(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


#: A model for each brand of parts, with scores that follow from its parts and what was sold of them.
_RESULTS = """SELECT p_brand AS model, CAST(0.98 - sum(p_size) / (count(*) * 500.0) AS DOUBLE) AS train_score, CAST(0.95 - sum(l_quantity) / (count(*) * 250.0) - sum(p_partkey % 7) / (count(*) * 60.0) AS DOUBLE) AS cv_score
FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY p_brand"""


def _results(spark: SparkSession, d: str) -> DataFrame:
    joined = load(spark, d, "part").join(load(spark, d, "lineitem"), F.col("p_partkey") == F.col("l_partkey"))
    n = F.count("*")
    train = F.lit(0.98) - F.sum("p_size") / (n * 500.0)
    cv = F.lit(0.95) - F.sum("l_quantity") / (n * 250.0) - F.sum(F.col("p_partkey") % 7) / (n * 60.0)
    return joined.groupBy(F.col("p_brand").alias("model")).agg(train.cast("double").alias("train_score"), cv.cast("double").alias("cv_score"))


_RES = _RESULTS
_GEN = f"WITH r AS ({_RES}), g AS (SELECT *, abs(train_score - cv_score) AS gap FROM r), p AS (SELECT *, gap > 0.20 AS rejected, gap * CASE WHEN gap > 0.20 THEN 5 WHEN gap > 0.10 THEN 3 ELSE 2 END AS penalty, gap > 0.05 AS overfitting FROM g)"

# Metrics


@query("a19_confusion", f"WITH t AS ({PRED_SQL}), c AS (SELECT DISTINCT label FROM t) SELECT a.label, b.label AS prediction, count(t.id) AS n FROM c a CROSS JOIN c b LEFT JOIN t ON t.label = a.label AND t.prediction = b.label GROUP BY 1, 2")
def a19(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(load(spark, d, "orders").selectExpr(*PREDICTIONS))


_CLS = f"WITH t AS ({PRED_SQL}), k AS (SELECT label AS class, count(*) AS support, count(*) FILTER (label = prediction) AS hits FROM t GROUP BY 1), q AS (SELECT prediction AS class, count(*) AS told FROM t GROUP BY 1), m AS (SELECT class, hits / told AS precision, hits / support AS recall, support FROM k JOIN q USING (class)), f AS (SELECT *, 2 * precision * recall / (precision + recall) AS f1 FROM m)"


@query("a20_per_class", _CLS + " SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM f")
def a20(spark: SparkSession, d: str) -> DataFrame:
    return _r(metrics.per_class(load(spark, d, "orders").selectExpr(*PREDICTIONS)), 6, "precision", "recall", "f1")


@query("a20_classification", _CLS + " SELECT round(sum(precision * support) / sum(support), 6) AS precision, round(sum(recall * support) / sum(support), 6) AS recall, round(sum(f1 * support) / sum(support), 6) AS f1, (SELECT round(avg((label = prediction)::INT), 6) FROM t) AS accuracy FROM f")
def a20b(spark: SparkSession, d: str) -> DataFrame:
    return _r(metrics.classification(load(spark, d, "orders").selectExpr(*PREDICTIONS)), 6, "precision", "recall", "f1", "accuracy")


@query("a21_regression", f"WITH t AS ({NUM_SQL}) SELECT round(1 - avg(pow(label - prediction, 2)) / var_pop(label), 6) AS r2, round(avg(abs(label - prediction)), 4) AS mae, round(avg(pow(label - prediction, 2)), 2) AS mse, round(sqrt(avg(pow(label - prediction, 2))), 4) AS rmse FROM t")
def a21(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.regression(load(spark, d, "orders").selectExpr(*NUMERIC))
    return out.select(F.round("r2", 6).alias("r2"), F.round("mae", 4).alias("mae"), F.round("mse", 2).alias("mse"), F.round("rmse", 4).alias("rmse"))


@query("a28_w06_roc", f"WITH t AS ({BIN_SQL}), c AS (SELECT score AS threshold, sum(label) AS p, sum(1 - label) AS n FROM t GROUP BY 1) SELECT threshold, round(sum(n) OVER w / sum(n) OVER (), 6) AS fpr, round(sum(p) OVER w / sum(p) OVER (), 6) AS tpr FROM c WINDOW w AS (ORDER BY threshold DESC)")
def a28(spark: SparkSession, d: str) -> DataFrame:
    return _r(metrics.roc(load(spark, d, "orders").selectExpr(*BINARY)), 6, "fpr", "tpr")


@query("a28_auc", f"WITH t AS ({BIN_SQL}), c AS (SELECT score, sum(label) AS p, sum(1 - label) AS n FROM t GROUP BY 1), w AS (SELECT p * (sum(n) OVER (ORDER BY score) - n / 2) AS x, p, n FROM c) SELECT round(sum(x) / (sum(p) * sum(n)), 6) AS auc FROM w")
def a28b(spark: SparkSession, d: str) -> DataFrame:
    return _r(metrics.auc(load(spark, d, "orders").selectExpr(*BINARY)), 6, "auc")


#: Three classes, and scores for each that lean towards the right one.
THREE = ("o_orderkey AS id", "CAST(o_orderkey % 3 AS INT) AS label", *[f"CAST(o_custkey % {m} + CASE WHEN o_orderkey % 3 = {k} THEN {a} ELSE 0 END AS DOUBLE) AS s{k}" for k, m, a in ((0, 40, 9), (1, 60, 20), (2, 25, 3))])
_EACH = "WITH t AS (SELECT " + ", ".join(THREE) + " FROM orders), e AS (" + " UNION ALL ".join(f"SELECT {k} AS class, s{k} AS threshold, (label = {k})::INT AS hit FROM t" for k in range(3)) + "), c AS (SELECT class, threshold, sum(hit) AS p, sum(1 - hit) AS n FROM e GROUP BY 1, 2)"


def _three(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").selectExpr(*THREE).select("id", "label", F.array("s0", "s1", "s2").alias("scores"))


@query("a28_roc_each", _EACH + " SELECT class, threshold, round(sum(n) OVER w / sum(n) OVER (PARTITION BY class), 6) AS fpr, round(sum(p) OVER w / sum(p) OVER (PARTITION BY class), 6) AS tpr FROM c WINDOW w AS (PARTITION BY class ORDER BY threshold DESC)")
def a28c(spark: SparkSession, d: str) -> DataFrame:
    return _r(metrics.roc_each(_three(spark, d)), 6, "fpr", "tpr")


@query("a28_auc_each", _EACH + ", w AS (SELECT class, p * (sum(n) OVER (PARTITION BY class ORDER BY threshold) - n / 2) AS x, p, n FROM c) SELECT class, round(sum(x) / (sum(p) * sum(n)), 6) AS auc FROM w GROUP BY 1")
def a28d(spark: SparkSession, d: str) -> DataFrame:
    return _r(metrics.auc_each(_three(spark, d)), 6, "auc")


@query("a29_residuals", f"WITH t AS ({NUM_SQL}) SELECT id, round(prediction, 4) AS prediction, label, round(label - prediction, 4) AS residual FROM t")
def a29(spark: SparkSession, d: str) -> DataFrame:
    return _r(metrics.residuals(load(spark, d, "orders").selectExpr(*NUMERIC), "id"), 4, "prediction", "residual")


_STEPS = [(i + 1) / 100 for i in range(99)]


@query(
    "a29_qq",
    f"SELECT unnest({_STEPS}::DOUBLE[]) AS q, round(unnest({[NormalDist().inv_cdf(q) for q in _STEPS]}::DOUBLE[]), 6) AS theoretical, round(unnest((SELECT quantile_cont(o_totalprice::DOUBLE, {_STEPS}) FROM orders)), 4) AS sample",
)
def a29b(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.qq(load(spark, d, "orders"), "o_totalprice")
    return out.select("q", F.round("theoretical", 6).alias("theoretical"), F.round("sample", 4).alias("sample"))


@query("m17_generalization", _GEN + " SELECT model, round(gap, 6) AS gap, rejected, round(penalty, 6) AS penalty, round(cv_score - penalty, 6) AS generalization, overfitting FROM p")
def m17(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.generalization(_results(spark, d)).select("model", "gap", "rejected", "penalty", "generalization", "overfitting")
    return _r(out, 6, "gap", "penalty", "generalization")


@query("m18_w10_ranked", _GEN + " SELECT model, row_number() OVER (ORDER BY rejected, -(cv_score - penalty), model)::INT AS rank FROM p")
def m18(spark: SparkSession, d: str) -> DataFrame:
    return metrics.ranked(_results(spark, d)).select("model", "rank")


@query("m26_comparison", _GEN + " SELECT model, round(train_score, 6) AS train_score, round(cv_score, 6) AS cv_score, round(gap, 6) AS gap FROM p ORDER BY gap DESC, model LIMIT 10")
def m26(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.generalization(_results(spark, d)).select("model", F.round("train_score", 6).alias("train_score"), F.round("cv_score", 6).alias("cv_score"), F.round("gap", 6).alias("gap"))
    return catalog.top(out, "gap", 10)


# Neighbours. Vectors of a few columns, so that exact SQL stays quick.

POINTS = ("c_custkey AS id", "[c_acctbal / 1000, CAST(c_nationkey AS DOUBLE)] AS v", "CAST(c_custkey % 3 AS INT) AS label")
POINT_SQL = "SELECT c_custkey AS id, c_acctbal / 1000 AS x, c_nationkey::DOUBLE AS y, (c_custkey % 3)::INT AS label FROM customer"


def _points(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.array(F.col("c_acctbal") / 1000, F.col("c_nationkey").cast("double")).alias("v"), (F.col("c_custkey") % 3).cast("int").alias("label"))


_KNN = f"WITH t AS ({POINT_SQL}), p AS (SELECT a.id, b.id AS nid, a.label, b.label AS nlabel, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS dist FROM t a JOIN t b ON a.id <> b.id), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, nid) AS rank FROM p QUALIFY rank <= {{k}})"


@query("j05_w07_knn", _KNN.format(k=5) + " SELECT id, rank::INT AS rank, nid, round(dist, 6) AS dist FROM k")
def j05(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d)
    return _r(neighbours.knn(p, p, 5), 6, "dist")


@query("j05_distance_range", _KNN.format(k=5) + " SELECT round(quantile_cont(dist, 0.05), 6) AS low, round(quantile_cont(dist, 0.95), 6) AS high FROM k WHERE rank = 5")
def j05b(spark: SparkSession, d: str) -> DataFrame:
    return _r(neighbours.distance_range(_points(spark, d), 5), 6, "low", "high")


@query("j05_approximate_knn")
def j05c(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return neighbours.approximate_knn(p, 5)


@query(
    "j06_impute",
    "WITH t AS (SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal END AS balance, c_nationkey::DOUBLE AS nation FROM customer), p AS (SELECT a.c_custkey, b.c_custkey AS nid, b.balance, sqrt(2.0 * (a.nation - b.nation) * (a.nation - b.nation)) AS dist FROM t a JOIN t b ON a.balance IS NULL AND b.balance IS NOT NULL), k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY dist, nid) <= 5), n AS (SELECT *, min(dist) OVER (PARTITION BY c_custkey) AS least FROM k), w AS (SELECT c_custkey, balance, CASE WHEN least = 0 THEN (dist = 0)::INT::DOUBLE ELSE 1 / dist END AS w FROM n), v AS (SELECT c_custkey, sum(balance * w) / sum(w) AS v FROM w GROUP BY 1) SELECT t.c_custkey, round(coalesce(balance, v), 6) AS balance, nation FROM t LEFT JOIN v USING (c_custkey)",
)
def j06(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal")).alias("balance"), F.col("c_nationkey").cast("double").alias("nation"))
    return _r(neighbours.impute(df, "c_custkey", ["balance", "nation"]), 6, "balance")


@query(
    "j06_impute_fitted",
    "WITH t AS (SELECT c_custkey, c_custkey % 5 = 0 AS held, CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal END AS balance, c_nationkey::DOUBLE AS nation FROM customer), p AS (SELECT a.c_custkey, b.c_custkey AS nid, b.balance, sqrt(2.0 * (a.nation - b.nation) * (a.nation - b.nation)) AS dist FROM t a JOIN t b ON a.held AND NOT b.held AND a.balance IS NULL AND b.balance IS NOT NULL), k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY dist, nid) <= 5), n AS (SELECT *, min(dist) OVER (PARTITION BY c_custkey) AS least FROM k), w AS (SELECT c_custkey, balance, CASE WHEN least = 0 THEN (dist = 0)::INT::DOUBLE ELSE 1 / dist END AS w FROM n), v AS (SELECT c_custkey, sum(balance * w) / sum(w) AS v FROM w GROUP BY 1) SELECT t.c_custkey, round(coalesce(balance, v), 6) AS balance, nation FROM t LEFT JOIN v USING (c_custkey) WHERE held",
)
def j06b(spark: SparkSession, d: str) -> DataFrame:
    """Held-out rows from donors among the others, which are kept in the chain."""
    df = load(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal")).alias("balance"), F.col("c_nationkey").cast("double").alias("nation"))
    step = transforms.fit_impute_neighbours(df.where("c_custkey % 5 <> 0"), "c_custkey", ["balance", "nation"], ["balance"])
    return _r(step.transform(df.where("c_custkey % 5 = 0")), 6, "balance")


@query("j08_tomek", _KNN.format(k=1) + " SELECT a.id AS a, a.nid AS b FROM k a JOIN k b ON a.nid = b.id AND b.nid = a.id WHERE a.id < b.id AND a.label <> a.nlabel")
def j08(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.tomek_links(_points(spark, d))


@query("j09_u05_preservation", _KNN.format(k=10) + ", q AS (SELECT a.id, b.id AS nid, row_number() OVER (PARTITION BY a.id ORDER BY abs(b.x - a.x), b.id) AS rank FROM t a JOIN t b ON a.id <> b.id QUALIFY rank <= 10), s AS (SELECT t.id, count(q.nid) AS n FROM t LEFT JOIN k ON k.id = t.id LEFT JOIN q ON q.id = k.id AND q.nid = k.nid GROUP BY 1) SELECT round(avg(n / 10), 6) AS preserved FROM s")
def j09(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d)
    return _r(neighbours.preservation(p, p.withColumn("v", F.slice("v", 1, 1)), 10), 6, "preserved")


@query("j12_m06_vote", f"WITH t AS ({POINT_SQL}), p AS (SELECT a.id, b.id AS nid, b.label, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS dist FROM t a JOIN t b ON a.id % 5 = 0 AND b.id % 5 <> 0), k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, nid) <= 5) SELECT id, label AS prediction FROM (SELECT id, label, count(*) AS n FROM k GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, label) = 1")
def j12(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d)
    return neighbours.vote(p.where("id % 5 = 0"), p.where("id % 5 <> 0"))


_TESTED = f"WITH t AS ({POINT_SQL}), p AS (SELECT a.id, b.id AS nid, b.label, {{d}} AS dist FROM t a JOIN t b ON a.id % 5 = 0 AND b.id % 5 <> 0), k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, nid) <= 5)"
_EUCLID = "sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y))"


@query("j12_weighted_vote", _TESTED.format(d="abs(b.x - a.x) + abs(b.y - a.y)") + " SELECT id, label AS prediction FROM (SELECT id, label, round(sum(1 / greatest(dist, 1e-12)), 9) AS w FROM k GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY id ORDER BY w DESC, label) = 1")
def j12b(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d)
    return neighbours.vote(p.where("id % 5 = 0"), p.where("id % 5 <> 0"), weights="distance", metric="manhattan")


@query("j12_m06_average", _TESTED.format(d=_EUCLID) + " SELECT id, round(avg(label), 6) AS prediction FROM k GROUP BY 1")
def j12c(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d)
    return _r(neighbours.average(p.where("id % 5 = 0"), p.where("id % 5 <> 0")), 6, "prediction")


@query("m11_dbscan", f"WITH RECURSIVE t AS ({POINT_SQL}), n AS (SELECT a.id, b.id AS nid FROM t a JOIN t b ON a.id <> b.id AND (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) <= 0.01), c AS (SELECT id FROM n GROUP BY 1 HAVING count(*) + 1 >= 4), e AS (SELECT n.* FROM n JOIN c USING (id) JOIN c c2 ON n.nid = c2.id), r AS (SELECT id, id AS c FROM c UNION SELECT e.nid, r.c FROM r JOIN e ON e.id = r.id), l AS (SELECT id, min(c) AS c FROM r GROUP BY 1), b AS (SELECT n.id, min(l.c) AS c FROM n JOIN l ON n.nid = l.id GROUP BY 1) SELECT t.id, coalesce(l.c, b.c, -1) AS cluster FROM t LEFT JOIN l USING (id) LEFT JOIN b USING (id)")
def m11(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.dbscan(_points(spark, d), 0.1, 4)


@query(
    "m11_dbscan_8d",
    "WITH RECURSIVE t AS (SELECT vec_id AS id, list_transform(embedding[1:8], lambda x: x::DOUBLE) AS v FROM embeddings), n AS (SELECT a.id, b.id AS nid FROM t a JOIN t b ON a.id <> b.id AND list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) <= 0.0625), c AS (SELECT id FROM n GROUP BY 1 HAVING count(*) + 1 >= 4), e AS (SELECT n.* FROM n JOIN c USING (id) JOIN c c2 ON n.nid = c2.id), r AS (SELECT id, id AS c FROM c UNION SELECT e.nid, r.c FROM r JOIN e ON e.id = r.id), l AS (SELECT id, min(c) AS c FROM r GROUP BY 1), b AS (SELECT n.id, min(l.c) AS c FROM n JOIN l ON n.nid = l.id GROUP BY 1) SELECT t.id, coalesce(l.c, b.c, -1) AS cluster FROM t LEFT JOIN l USING (id) LEFT JOIN b USING (id)",
)
def m11b(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.slice("embedding", 1, 8).alias("v"))
    return neighbours.dbscan(df, 0.25, 4)


@query("m14_lof", _KNN.format(k=10) + ", d AS (SELECT id, max(dist) AS kd FROM k GROUP BY 1), r AS (SELECT k.id, k.nid, greatest(dist, kd) AS reach FROM k JOIN d ON d.id = k.nid), l AS (SELECT id, 1 / greatest(avg(reach), 1e-10) AS lrd FROM r GROUP BY 1) SELECT r.id, round(avg(n.lrd) / any_value(o.lrd), 5) AS lof FROM r JOIN l n ON n.id = r.nid JOIN l o ON o.id = r.id GROUP BY 1")
def m14(spark: SparkSession, d: str) -> DataFrame:
    return _r(neighbours.lof(_points(spark, d), 10), 5, "lof")


@query("a22_silhouette", f"WITH t AS ({POINT_SQL}), s AS (SELECT label, count(*) AS n FROM t GROUP BY 1), p AS (SELECT a.id, a.label AS own, b.label, sum(sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y))) AS d FROM t a JOIN t b ON TRUE GROUP BY 1, 2, 3), m AS (SELECT id, own, max(d / (n - 1)) FILTER (own = p.label) AS a, min(d / n) FILTER (own <> p.label) AS b FROM p JOIN s ON s.label = p.label GROUP BY 1, 2) SELECT id, own::BIGINT AS cluster, round((b - a) / greatest(a, b), 5) AS silhouette FROM m")
def a22(spark: SparkSession, d: str) -> DataFrame:
    return _r(neighbours.silhouette(_points(spark, d).withColumnRenamed("label", "cluster")), 5, "silhouette")


@query("w08_silhouette_order", f"WITH t AS ({POINT_SQL}), s AS (SELECT label, count(*) AS n FROM t GROUP BY 1), p AS (SELECT a.id, a.label AS own, b.label, sum(sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y))) AS d FROM t a JOIN t b ON TRUE GROUP BY 1, 2, 3), m AS (SELECT id, own, max(d / (n - 1)) FILTER (own = p.label) AS a, min(d / n) FILTER (own <> p.label) AS b FROM p JOIN s ON s.label = p.label GROUP BY 1, 2), q AS (SELECT id, own AS cluster, round((b - a) / greatest(a, b), 5) AS s FROM m) SELECT id, cluster::BIGINT AS cluster, row_number() OVER (PARTITION BY cluster ORDER BY s, id)::INT AS place FROM q")
def w08(spark: SparkSession, d: str) -> DataFrame:
    s = _r(neighbours.silhouette(_points(spark, d).withColumnRenamed("label", "cluster")), 5, "silhouette")
    return rows.ranked(s, ["cluster"], ["silhouette", "id"]).select("id", "cluster", F.col("place").cast("int").alias("place"))


@query(
    "a22_cluster_indices",
    """WITH r AS (SELECT vec_id, label AS c, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT c, i, avg(x) AS m FROM r GROUP BY 1, 2), g AS (SELECT i, avg(x) AS g FROM r GROUP BY 1),
    n AS (SELECT label AS c, count(*) AS n FROM embeddings GROUP BY 1), d AS (SELECT vec_id, c, sum((x - m) * (x - m)) AS d FROM r JOIN m USING (c, i) GROUP BY 1, 2), w AS (SELECT c, sum(d) AS w, avg(sqrt(d)) AS s FROM d GROUP BY 1),
    b AS (SELECT sum(n * (m - g) * (m - g)) AS b FROM m JOIN g USING (i) JOIN n USING (c)), q AS (SELECT x.c AS a, y.c AS b, sqrt(sum((x.m - y.m) * (x.m - y.m))) AS gap FROM m x JOIN m y ON x.i = y.i AND x.c <> y.c GROUP BY 1, 2),
    t AS (SELECT q.a, max((x.s + y.s) / gap) AS t FROM q JOIN w x ON x.c = q.a JOIN w y ON y.c = q.b GROUP BY 1)
    SELECT round(((SELECT b FROM b) / (count(*) - 1)) / (sum(w) / ((SELECT sum(n) FROM n) - count(*))), 5) AS calinski_harabasz, (SELECT round(avg(t), 5) FROM t) AS davies_bouldin FROM w""",
)
def a22b(spark: SparkSession, d: str) -> DataFrame:
    return _r(metrics.cluster_indices(load(spark, d, "embeddings").select(F.col("embedding").alias("v"), F.col("label").alias("cluster"))), 5, "calinski_harabasz", "davies_bouldin")


@query("a23_clusters", "WITH t AS (SELECT CASE WHEN label = 0 THEN -1 ELSE label END AS cluster FROM embeddings), s AS (SELECT cluster, count(*) AS n FROM t GROUP BY 1) SELECT count(*) FILTER (cluster >= 0) AS n_clusters, coalesce(sum(n) FILTER (cluster = -1), 0)::BIGINT AS n_noise, round(coalesce(sum(n) FILTER (cluster = -1), 0) / sum(n), 6) AS noise_ratio, round(max(n) FILTER (cluster >= 0) / sum(n), 6) AS largest FROM s")
def a23(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "embeddings").select(F.when(F.col("label") == 0, -1).otherwise(F.col("label")).alias("cluster"))
    return _r(metrics.cluster_summary(df), 6, "noise_ratio", "largest")


@query("a24_anomalies", "SELECT count(*) FILTER (value > 20) AS n_out, count(*) FILTER (NOT value > 20) AS n_in, round(avg((value > 20)::INT), 6) AS ratio, round(avg(value), 5) AS mean_score, round(stddev_samp(value), 5) AS std_score FROM events")
def a24(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "events").select(F.when(F.col("value") > 20, -1).otherwise(1).alias("anomaly_label"), F.col("value").alias("anomaly_score"))
    out = metrics.anomaly_summary(df)
    return out.select("n_out", "n_in", F.round("ratio", 6).alias("ratio"), F.round("mean_score", 5).alias("mean_score"), F.round("std_score", 5).alias("std_score"))


@query(
    "a24_split_silhouette",
    "WITH t AS (SELECT CASE WHEN value > 20 THEN -1 ELSE 1 END AS c, value::DOUBLE AS x FROM events), g AS (SELECT c, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM t GROUP BY 1), p AS (SELECT (o.n * x * x - 2 * x * o.s + o.q) / greatest(o.n - 1, 1) AS a, (r.n * x * x - 2 * x * r.s + r.q) / r.n AS b FROM t JOIN g o ON o.c = t.c JOIN g r ON r.c <> t.c) SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM p",
)
def a24b(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "events").select(F.when(F.col("value") > 20, -1).otherwise(1).alias("anomaly_label"), F.col("value").alias("anomaly_score"), F.array("value").alias("v"))
    return metrics.anomaly_summary(df, vector="v").select(F.round("silhouette", 6).alias("silhouette"))


# Rebalancing


@query("x28_u03_oversample", f"WITH t AS ({ORDERS_SQL}), c AS (SELECT late, count(*) AS n FROM t GROUP BY 1), m AS (SELECT max(n) AS m FROM c), r AS (SELECT order_id, t.late, n, m, row_number() OVER (PARTITION BY t.late ORDER BY md5('42|' || order_id)) AS k FROM t JOIN c USING (late), m) SELECT order_id, late, unnest(range(0, m // n + (k <= m % n)::INT))::INT AS copy FROM r")
def x28(spark: SparkSession, d: str) -> DataFrame:
    return resample.oversample(orders(spark, d).select("order_id", "late"), "late", "order_id")


def _minority(spark: SparkSession, d: str) -> DataFrame:
    return _points(spark, d).withColumn("label", (F.col("id") % 8 == 0).cast("int"))


@query("x29_j07_smote")
def x29(spark: SparkSession, d: str) -> DataFrame:
    return resample.smote(_minority(spark, d))


@query("x30_smote_tomek")
def x30(spark: SparkSession, d: str) -> DataFrame:
    return resample.smote_tomek(_minority(spark, d))


@query("x31_policy", f"WITH t AS ({ORDERS_SQL}), c AS (SELECT count(*) AS n FROM t GROUP BY late) SELECT CASE WHEN min(n) * 100.0 / sum(n) >= 25 AND max(n) / min(n) <= 3 THEN 'none' WHEN max(n) / min(n) > 5 THEN 'smote' WHEN max(n) / min(n) > 2.5 THEN 'smote_tomek' ELSE 'oversample' END AS policy FROM c")
def x31(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(resample.policy(orders(spark, d), "late")[0],)], "policy string")


@query("x31_balanced", f"WITH t AS ({POINT_SQL}), c AS (SELECT (id % 8 = 0)::INT AS class, count(*) AS before FROM t GROUP BY 1) SELECT class, 'smote' AS policy, before, max(before) OVER () AS after FROM c")
def x31b(spark: SparkSession, d: str) -> DataFrame:
    return resample.balanced(_minority(spark, d))[1]


# Decisions and preparation


@query(
    "x34_imputation_policy",
    f"WITH t AS ({ORDERS_SQL}) SELECT 'price' AS \"column\", round(avg((price IS NULL)::INT), 6) AS missing, 'mean' AS strategy FROM t UNION ALL SELECT 'optional', round(avg((optional IS NULL)::INT), 6), 'constant' FROM t UNION ALL SELECT 'status', round(avg((status IS NULL)::INT), 6), 'mode' FROM t UNION ALL SELECT 'late', 0, 'none' FROM (SELECT 1)",
)
def x34(spark: SparkSession, d: str) -> DataFrame:
    return _r(policy.imputation(orders(spark, d), ["price", "optional", "status", "late"]).select("column", "missing", "strategy"), 6, "missing")


@query("x35_encoding_policy", "SELECT 'p_brand' AS \"column\", count(DISTINCT p_brand) AS n_distinct, CASE WHEN count(DISTINCT p_brand) > 50 THEN 'ordinal' ELSE 'one_hot' END AS strategy FROM part UNION ALL SELECT 'p_type', count(DISTINCT p_type), CASE WHEN count(DISTINCT p_type) > 50 THEN 'ordinal' ELSE 'one_hot' END FROM part")
def x35(spark: SparkSession, d: str) -> DataFrame:
    return policy.encoding(load(spark, d, "part"), ["p_brand", "p_type"], "linear")


@query("x36_scaling_policy", f"WITH t AS ({ORDERS_SQL}) " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CASE WHEN (SELECT count(*) FROM t WHERE {c} < q1 - 2.5 * (q3 - q1) OR {c} > q3 + 2.5 * (q3 - q1)) > 0 THEN 'robust' ELSE 'standard' END AS strategy FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM t)" for c in ("price", "custkey")))
def x36(spark: SparkSession, d: str) -> DataFrame:
    return policy.scaling(orders(spark, d), ["price", "custkey"], "linear")


def _prepared(spark: SparkSession, d: str, family: str) -> prepare.Prepared:
    return prepare.adaptive(orders(spark, d), "order_id", "late", family=family)


@query("x37_adaptive_tree")
def x37(spark: SparkSession, d: str) -> DataFrame:
    p = _prepared(spark, d, "tree")
    return p.train.unionByName(p.test)


@query("x37_adaptive_linear")
def x37b(spark: SparkSession, d: str) -> DataFrame:
    p = _prepared(spark, d, "linear")
    return p.train.unionByName(p.test)


@query("x37_decisions")
def x37c(spark: SparkSession, d: str) -> DataFrame:
    return _prepared(spark, d, "distance").decisions()


@query("x38_x40_fixed")
def x38(spark: SparkSession, d: str) -> DataFrame:
    p = prepare.fixed(orders(spark, d).select("order_id", "custkey", "price", "status", "priority", "late"), "order_id", "late", impute="median", scale="robust", outliers="clip", drop_first=True)
    return p.train.unionByName(p.test)


@query("x39_unsupervised")
def x39(spark: SparkSession, d: str) -> DataFrame:
    return prepare.unsupervised(load(spark, d, "part"), "p_partkey").train


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("double").alias("label"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))


@query("x27_m27_components")
def x27(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return prepare.components(_vectors(spark, d), most=2).select("id", F.slice(vector_to_array("pca"), 1, 2).alias("xy"))


@query("m12_w05_explained_variance")
def m12(spark: SparkSession, d: str) -> DataFrame:
    return prepare.explained_variance(_vectors(spark, d), 8)


@query("m12_truncated_svd")
def m12b(spark: SparkSession, d: str) -> DataFrame:
    shares = prepare.truncated_svd(_vectors(spark, d), 8)
    return shares.withColumn("score", F.lit(prepare.parsimony_score(shares, 64)))


# Models


def _sized(spark: SparkSession, d: str) -> tuple[prepare.Prepared, Callable[[DataFrame], DataFrame]]:
    """Orders of which ``size`` is to be told, prepared adaptively (dates included), and what stores a split of them with vectors and labels."""
    df = load(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_custkey", "o_orderpriority", "o_orderdate", F.when(F.col("o_totalprice") + F.col("o_custkey") % 7 * 1000 > 250000, "big").otherwise("small").alias("size"))
    p = prepare.adaptive(df, "o_orderkey", "size", family="linear")
    return p, lambda x: stored(prepare.vectors(x, p.features).select("o_orderkey", "features", F.col("size").cast("double").alias("label")))


def _labelled(spark: SparkSession, d: str) -> tuple[prepare.Prepared, DataFrame, DataFrame]:
    """Both splits of ``_sized``."""
    p, name = _sized(spark, d)
    return p, name(p.train), name(p.test)


def _priced(spark: SparkSession, d: str) -> DataFrame:
    """Lines with their price as the label."""
    df = load(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_quantity", "l_discount", "l_tax", F.col("l_extendedprice").alias("label"))
    return prepare.vectors(df, ["l_quantity", "l_discount", "l_tax"])


@query("m15_m18_search")
def m15(spark: SparkSession, d: str) -> DataFrame:
    p, name = _sized(spark, d)
    return models.search(name(p.train), "o_orderkey", "classification", trials=2).results


@query("m02_m08_regression_search")
def m02(spark: SparkSession, d: str) -> DataFrame:
    return models.search(_priced(spark, d), "id", "regression", ("ridge", "lasso", "elastic_net", "decision_tree", "random_forest", "gradient_boosting"), trials=2, k=3).results


@query("m08_m22_regression_importance")
def m08(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_quantity", "l_discount", "l_tax", F.col("l_extendedprice").alias("label"))
    features = ["l_quantity", "l_discount", "l_tax"]
    return models.importance(models.estimator("ridge", "regression", 0, {"regParam": 0.01}).fit(prepare.vectors(df, features)), features, spark)


@query("m23_fixed_models")
def m23b(spark: SparkSession, d: str) -> DataFrame:
    _, train, test = _labelled(spark, d)
    each = {"logistic_regression": {}, "decision_tree": {}, "random_forest": {"seed": 7}, "gradient_boosting": {"seed": 7}}
    return reduce(DataFrame.union, [metrics.classification(models.fit_fixed(train, m, params=p).transform(test)).select(F.lit(m).alias("model"), "*") for m, p in each.items()])


@query("m23_m24_fixed_and_score")
def m23(spark: SparkSession, d: str) -> DataFrame:
    _, train, test = _labelled(spark, d)
    model = models.fit_fixed(train, "random_forest", params={"seed": 7})
    return models.score(model, test, ["big", "small"]).select("o_orderkey", "predicted", "confidence")


@query("m04_gradient_boosting")
def m04(spark: SparkSession, d: str) -> DataFrame:
    _, train, test = _labelled(spark, d)
    return metrics.classification(models.fit_fixed(train, "gradient_boosting", params={"seed": 7}).transform(test))


@query("m05_linear_svm")
def m05(spark: SparkSession, d: str) -> DataFrame:
    _, train, test = _labelled(spark, d)
    return metrics.classification(models.fit_fixed(train, "linear_svm").transform(test))


@query("m07_adaboost")
def m07(spark: SparkSession, d: str) -> DataFrame:
    _, train, test = _labelled(spark, d)
    return metrics.classification(models.adaboost(train).transform(test))


@query("m09_m25_kmeans")
def m09(spark: SparkSession, d: str) -> DataFrame:
    v = rows.train_test_split(_vectors(spark, d), "id")
    return metrics.cluster_sizes(models.kmeans(v.where("split = 'train'"), 5).transform(v.where("split = 'test'")), "prediction")


@query("s13_saved_models")
def s13(spark: SparkSession, d: str) -> DataFrame:
    """A search over neighbours and boosting as it was saved, and what its best model says of new rows."""
    df = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal"), F.col("c_nationkey"), (F.col("c_acctbal") > F.col("c_nationkey") * 200).cast("double").alias("label"))
    rows_ = cut(prepare.vectors(df, ["c_acctbal", "c_nationkey"]))
    path = _folder(spark)
    models.search(rows_.where("id % 5 <> 0"), "id", "classification", ("knn", "adaboost"), trials=1, k=2).save(spark, path)
    return models.Search.load(spark, path).best.transform(rows_.where("id % 5 = 0")).select("id", "label", "prediction")


@query("m09_minibatch_kmeans")
def m09b(spark: SparkSession, d: str) -> DataFrame:
    v = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return metrics.cluster_sizes(models.nearest_centre(v, models.minibatch_kmeans(v, 5)), "prediction")


@query("m10_bisecting")
def m10(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return metrics.cluster_sizes(models.bisecting(v, 5).transform(v), "prediction")


@query("m13_s10_isolation_forest")
def m13(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.array(F.col("o_totalprice"), F.col("o_custkey").cast("double")).alias("v"))
    return models.isolation_forest(df).select("id", "anomaly_score", "anomaly_label")


@query("m13_m25_forest_new_rows")
def m13b(spark: SparkSession, d: str) -> DataFrame:
    """Rows that the forest was not grown from, by the forest as it was saved."""
    df = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.array(F.col("o_totalprice"), F.col("o_custkey").cast("double")).alias("v"))
    path = _folder(spark)
    models.fit_isolation_forest(df.where("id % 5 <> 0")).save(spark, path)
    return models.IsolationForest.load(spark, path).transform(df.where("id % 5 = 0")).select("id", "anomaly_score", "anomaly_label")


@query("m19_stability")
def m19(spark: SparkSession, d: str) -> DataFrame:
    _, train, test = _labelled(spark, d)
    model = models.estimator("decision_tree", "classification", 2, {"maxDepth": 3}).fit(train)
    seen, new = model.transform(train), model.transform(test)
    return models.stability(model, new, *(metrics.classification(x).head()["f1"] for x in (seen, new)))


@query("m20_m21_objectives")
def m20(spark: SparkSession, d: str) -> DataFrame:
    v = _points(spark, d).withColumnRenamed("label", "cluster")
    s = neighbours.silhouette(v).agg(F.avg("silhouette")).head()[0]
    c = metrics.cluster_summary(v).head()
    far = models.isolation_forest(v.select("id", "v"))
    a = metrics.anomaly_summary(far, vector="v").head()
    return spark.createDataFrame([("clusters", models.clustering_objective(s, c["noise_ratio"], c["largest"])), ("anomalies", models.anomaly_objective(a["silhouette"], a["ratio"]))], "kind string, objective double")


# Sources, sinks and streams


@query("s01_s05_csv", "SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderpriority, o_custkey::VARCHAR AS \"cust key\" FROM orders")
def s01(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    load(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.col("o_custkey").alias(" cust   key "), F.lit(None).cast("string").alias("empty")).write.option("header", True).option("sep", ";").csv(path)
    return readers.read_table(spark, path)


@query("s04_csv_latin1", "SELECT c_custkey::VARCHAR AS \"clé\", c_name || '_é' AS name, CASE WHEN c_custkey % 2 = 0 THEN 'ñ' ELSE 'ü' END AS sign FROM customer")
def s04(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    df = load(spark, d, "customer").select(F.col("c_custkey").alias("clé"), F.concat("c_name", F.lit("_é")).alias("name"), F.when(F.col("c_custkey") % 2 == 0, "ñ").otherwise("ü").alias("sign"))
    df.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return readers.read_table(spark, path)


@query("s04_csv_utf16", "SELECT o_orderkey::VARCHAR AS \"schlüssel\", o_orderstatus || '_ß' AS status, CASE WHEN o_orderkey % 2 = 0 THEN '漢' ELSE 'ж' END AS sign FROM orders")
def s04b(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    df = load(spark, d, "orders").select(F.col("o_orderkey").alias("schlüssel"), F.concat("o_orderstatus", F.lit("_ß")).alias("status"), F.when(F.col("o_orderkey") % 2 == 0, "漢").otherwise("ж").alias("sign"))
    df.repartition(4).write.option("header", True).option("sep", ";").option("encoding", "UTF-16").csv(path)
    return readers.read_table(spark, path)


@query("s02_csv_no_header", "SELECT s_suppkey::VARCHAR AS Column1, s_nationkey::VARCHAR AS Column2, s_name AS Column3 FROM supplier")
def s02(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    load(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_name").write.option("sep", "\t").csv(path)
    return readers.read_table(spark, path)


@query("s06_s07_splits", f"WITH t AS ({ORDERS_SQL}) SELECT order_id, priority FROM t QUALIFY row_number() OVER (ORDER BY md5('42|' || order_id)) <= ceil((SELECT count(*) FROM t) * 0.2)")
def s06(spark: SparkSession, d: str) -> DataFrame:
    path, split = _folder(spark), rows.train_test_split(orders(spark, d).select("order_id", "priority"), "order_id")
    readers.write_splits(split.where("split = 'train'").drop("split"), split.where("split = 'test'").drop("split"), path)
    return readers.read_split(spark, path, "test")


@query("s11_c33_json", "SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS price FROM orders")
def s11(spark: SparkSession, d: str) -> DataFrame:
    path, key = _folder(spark), F.col("o_orderkey")
    price = F.when(key % 6 == 0, F.lit(float("nan"))).when(key % 3 == 0, F.lit(float("inf"))).otherwise(F.col("o_totalprice"))
    readers.write_json(load(spark, d, "orders").select("o_orderkey", "o_orderpriority", price.alias("price")), path)
    return spark.read.schema("o_orderkey long, o_orderpriority string, price double").json(path)


@query("s12_saved_chain", "WITH k AS (SELECT p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS code FROM (SELECT DISTINCT p_brand FROM part)), s AS (SELECT avg(p_size) AS a, stddev_pop(p_size) AS b FROM part) SELECT p_partkey, code::DOUBLE AS p_brand, round((p_size - a) / b, 6) AS p_size FROM part JOIN k USING (p_brand), s")
def s12(spark: SparkSession, d: str) -> DataFrame:
    df, path = load(spark, d, "part").select("p_partkey", "p_brand", "p_size"), _folder(spark)
    transforms.Chain([transforms.fit_ordinal(df, ["p_brand"]), transforms.fit_scale(df, ["p_size"])]).save(spark, path)
    return _r(transforms.Chain.load(spark, path).transform(df), 6, "p_size")


@query("t07_s13_stream_scores")
def t07(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.ml import PipelineModel

    p, train, _ = _labelled(spark, d)
    folder = _folder(spark)
    models.fit_fixed(train, "logistic_regression").write().overwrite().save(f"{folder}/model")
    model = PipelineModel.load(f"{folder}/model")
    source = load(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_custkey", "o_orderpriority", "o_orderdate")
    source.write.parquet(f"{folder}/arriving")
    arriving = scoring.stream(spark, f"{folder}/arriving", source).withColumn("size", F.lit(None).cast("string"))
    scoring.score_stream(arriving, p.chain, model, p.features, f"{folder}/scores", f"{folder}/progress", ["o_orderkey", "prediction", "confidence"]).awaitTermination()
    return spark.read.parquet(f"{folder}/scores")


# Catalog, shaped like lists of models and datasets

_MODELS = """SELECT CAST(replace(p_brand, 'Brand#', '') AS BIGINT) AS model_id, p_brand AS name, CASE WHEN CAST(replace(p_brand, 'Brand#', '') AS BIGINT) % 6 = 0 THEN 99 ELSE CAST(replace(p_brand, 'Brand#', '') AS BIGINT) % 5 END AS dataset_id,
round(0.3 + sum(p_size) / (count(*) * 60.0), 4) AS score, max(p_partkey) AS created, sum(p_size) % 4 = 0 AS imbalanced FROM part GROUP BY p_brand"""
_SETS = """SELECT c_nationkey % 5 AS dataset_id, 'set ' || (c_nationkey % 5) AS name, c_nationkey % 5 % 2 = 0 AS processed, max(c_custkey) AS "at", round(avg(CASE WHEN c_acctbal < 0 THEN 1.0 ELSE 0.0 END) * 100, 2) AS missing_pct FROM customer GROUP BY c_nationkey % 5"""


def _models(spark: SparkSession, d: str) -> DataFrame:
    """A model for each brand of parts."""
    number = F.replace("p_brand", F.lit("Brand#"), F.lit("")).cast("long")
    each = load(spark, d, "part").groupBy("p_brand").agg(F.round(0.3 + F.sum("p_size") / (F.count("*") * 60.0), 4).alias("score"), F.max("p_partkey").alias("created"), (F.sum("p_size") % 4 == 0).alias("imbalanced"))
    return each.select(number.alias("model_id"), F.col("p_brand").alias("name"), F.when(number % 6 == 0, 99).otherwise(number % 5).alias("dataset_id"), "score", "created", "imbalanced")


def _sets(spark: SparkSession, d: str) -> DataFrame:
    """A dataset for each fifth of the nations' customers."""
    number = F.col("c_nationkey") % 5
    each = load(spark, d, "customer").groupBy(number.alias("dataset_id")).agg(F.max("c_custkey").alias("at"), F.round(F.avg((F.col("c_acctbal") < 0).cast("double")) * 100, 2).alias("missing_pct"))
    return each.select("dataset_id", F.concat(F.lit("set "), F.col("dataset_id").cast("string")).alias("name"), (F.col("dataset_id") % 2 == 0).alias("processed"), "at", "missing_pct")


@query("j01_models_with_datasets", f"WITH m AS ({_MODELS}), s AS ({_SETS}) SELECT m.dataset_id, model_id, m.name, score, created, imbalanced, coalesce(s.name, 'Unknown') AS dataset_name FROM m LEFT JOIN s USING (dataset_id)")
def j01(spark: SparkSession, d: str) -> DataFrame:
    return catalog.with_dataset(_models(spark, d), _sets(spark, d))


@query("j03_compare", f"WITH m AS ({_MODELS}) SELECT * FROM m WHERE model_id IN (11, 15, 1000)")
def j03(spark: SparkSession, d: str) -> DataFrame:
    return catalog.compare(_models(spark, d), [11, 15, 1000])


@query("s14_find", f"WITH m AS ({_MODELS}) SELECT * FROM m WHERE (dataset_id = 1 OR name = 'Brand#13') AND score IS NOT NULL")
def s14(spark: SparkSession, d: str) -> DataFrame:
    return catalog.find(_models(spark, d), either=[{"dataset_id": 1}, {"name": "Brand#13"}], exists={"score": True})


@query("l04_sorted", "SELECT p_partkey, p_name FROM part ORDER BY lower(p_name)")
def l04(spark: SparkSession, d: str) -> DataFrame:
    return catalog.sort(load(spark, d, "part").select("p_partkey", "p_name"), "p_name")


@query("l02_top", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY abs(o_totalprice) DESC, o_orderkey LIMIT 10")
def l02(spark: SparkSession, d: str) -> DataFrame:
    return catalog.top(load(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 10)


@query("l03_u02_timeline", "SELECT kind, \"at\", name FROM (SELECT 'event' AS kind, ts AS \"at\", event_type AS name FROM events UNION ALL SELECT 'order', o_orderdate, o_orderpriority FROM orders) ORDER BY \"at\" DESC, kind, name LIMIT 15")
def l03(spark: SparkSession, d: str) -> DataFrame:
    return catalog.timeline(event=load(spark, d, "events").select(F.col("ts").alias("at"), F.col("event_type").alias("name")), order=load(spark, d, "orders").select(F.col("o_orderdate").alias("at"), F.col("o_orderpriority").alias("name")))


@query("a30_dashboard", f"WITH m AS ({_MODELS}), s AS ({_SETS}) SELECT (SELECT count(*) FROM m) AS n_models, (SELECT name FROM m ORDER BY score DESC, name DESC LIMIT 1) AS best_model, (SELECT max(score) FROM m) AS best_score, (SELECT count(*) FROM m WHERE score < 0.6) AS n_weak, (SELECT count(*) FROM s) AS n_datasets, (SELECT name FROM s ORDER BY \"at\" DESC, name DESC LIMIT 1) AS latest, (SELECT missing_pct FROM s ORDER BY \"at\" DESC, name DESC LIMIT 1) AS latest_missing_pct, (SELECT count(*) FROM s WHERE NOT processed) AS n_unprocessed")
def a30(spark: SparkSession, d: str) -> DataFrame:
    return catalog.dashboard(_models(spark, d), _sets(spark, d))


@query("a30_attention", f"WITH m AS ({_MODELS}), s AS ({_SETS}), i AS (SELECT 'unprocessed_datasets' AS type, 'warning' AS severity, dataset_id AS id, name FROM s WHERE NOT processed UNION ALL SELECT 'low_accuracy', 'error', model_id, name FROM m WHERE score < 0.6 UNION ALL SELECT 'class_imbalance', 'info', model_id, name FROM m WHERE imbalanced), k AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY id) AS k FROM i) SELECT type, severity, count(*) AS total, string_agg(name, ',' ORDER BY id) FILTER (k <= 5) AS names FROM k GROUP BY ALL")
def a30b(spark: SparkSession, d: str) -> DataFrame:
    return catalog.attention(_models(spark, d), _sets(spark, d))


@query("a30_model_table", f"WITH m AS ({_MODELS}), s AS ({_SETS}) SELECT m.dataset_id, model_id, m.name, round(score, 4) AS score, created, imbalanced, coalesce(s.name, 'Unknown') AS dataset_name FROM m LEFT JOIN s USING (dataset_id)")
def a30c(spark: SparkSession, d: str) -> DataFrame:
    return catalog.model_table(_models(spark, d), _sets(spark, d))


@query("l01_w05_cumulative", "WITH c AS (SELECT event_type, sum(value) AS v FROM events GROUP BY 1), s AS (SELECT event_type, v / sum(v) OVER () AS share, v FROM c) SELECT event_type, round(share, 6) AS share, round(sum(share) OVER (ORDER BY v DESC, event_type), 6) AS cumulative FROM s")
def l01(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "events").groupBy("event_type").agg(F.sum("value").alias("v"))
    share = F.col("v") / F.sum("v").over(Window.partitionBy())
    return c.withColumn("share", share).select("event_type", F.round("share", 6).alias("share"), F.round(F.sum("share").over(Window.orderBy(F.desc("v"), "event_type")), 6).alias("cumulative"))


@query("u01_union", "SELECT split, count(*) AS n FROM (SELECT 'train' AS split FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT 'test' FROM orders WHERE o_orderkey % 5 = 0) GROUP BY 1")
def u01(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").select("o_orderkey")
    both = o.where("o_orderkey % 5 <> 0").withColumn("split", F.lit("train")).unionByName(o.where("o_orderkey % 5 = 0").withColumn("split", F.lit("test")))
    return both.groupBy("split").agg(F.count("*").alias("n"))


@query("c30_overlap", "WITH p AS (SELECT l_orderkey, list(DISTINCT l_partkey % 20) FILTER (l_linenumber <= 3) AS a, list(DISTINCT l_partkey % 20) FILTER (l_linenumber > 3) AS b FROM lineitem GROUP BY 1) SELECT l_orderkey, coalesce(len(list_intersect(a, b)), 0)::INT AS n FROM p")
def c30(spark: SparkSession, d: str) -> DataFrame:
    part = F.col("l_partkey") % 20
    g = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_linenumber") <= 3, part)).alias("a"), F.collect_set(F.when(F.col("l_linenumber") > 3, part)).alias("b"))
    return g.select("l_orderkey", scalar.overlap(F.col("a"), F.col("b")).alias("n"))
