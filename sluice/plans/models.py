"""Models: candidates with sampled parameters, cross-validated search, ranking, scoring and stability checks."""

from __future__ import annotations

import hashlib
import json
import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import clustering as K
from pyspark.ml import evaluation as V
from pyspark.ml import regression as R
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..operators import metrics, neighbours, profile, rows
from ..session import cut, stored


class Sampler:
    """Reproducible draws, by hash of a seed and the number of the draw."""

    def __init__(self, seed: int):
        self.seed, self.n = seed, 0

    def unit(self) -> float:
        self.n += 1
        return int(hashlib.md5(f"{self.seed}|{self.n}".encode()).hexdigest()[:12], 16) / 16**12

    def between(self, low: int, high: int) -> int:
        return low + int(self.unit() * (high - low + 1))

    def log(self, low: float, high: float) -> float:
        return math.exp(math.log(low) + self.unit() * (math.log(high) - math.log(low)))

    def one_of(self, *values):  # noqa: ANN002, ANN201
        return values[int(self.unit() * len(values))]


def draw(model: str, s: Sampler, n: int) -> dict:
    """Parameters of one trial. ``n`` training rows turn a penalty per row sum into one per mean."""
    if model == "logistic_regression":
        penalty = s.one_of("l1", "l2", "none")
        return {"regParam": 0.0 if penalty == "none" else 1 / (s.log(1e-3, 1e2) * n), "elasticNetParam": float(penalty == "l1"), "maxIter": s.between(50, 200), "standardization": False}
    if model == "linear_svm":
        return {"regParam": 1 / (s.log(1e-3, 1e1) * n), "maxIter": s.between(50, 100), "standardization": False}
    if model == "decision_tree":
        return {"maxDepth": s.between(2, 10), "minInstancesPerNode": s.between(1, 20)}
    if model == "random_forest":
        return {"numTrees": s.between(10, 40), "maxDepth": s.between(3, 10), "minInstancesPerNode": s.between(1, 10), "featureSubsetStrategy": s.one_of("sqrt", "log2", "all"), "seed": 7}
    if model == "gradient_boosting":
        return {"maxIter": s.between(5, 20), "maxDepth": s.between(2, 6), "stepSize": s.log(0.02, 0.3), "subsamplingRate": 0.5 + s.unit() / 2, "seed": 7}
    if model == "ridge":
        return {"regParam": s.log(1e-3, 1e3) / n, "elasticNetParam": 0.0, "standardization": False}
    if model == "lasso":
        return {"regParam": s.log(1e-4, 1e1), "elasticNetParam": 1.0, "standardization": False}
    if model == "elastic_net":
        return {"regParam": s.log(1e-4, 1e1), "elasticNetParam": s.unit(), "standardization": False}
    if model == "linear_regression":
        return {"regParam": 0.0}
    if model == "naive_bayes":
        return {"modelType": "gaussian"}
    if model == "knn":
        return {"k": s.between(3, 15), "weights": s.one_of("uniform", "distance")}
    if model == "adaboost":
        return {"rounds": s.between(5, 20), "depth": s.between(1, 3)}
    raise ValueError(f"unknown model {model}")


def repaired(model: str, params: dict, n: int, task: str = "classification") -> dict:
    """``params`` without what cannot work: penalties without a weight, leaves larger than half of the rows, shares above 1."""
    out = dict(params)
    if out.get("regParam") == 0.0:
        out.pop("elasticNetParam", None)
    if "minInstancesPerNode" in out:
        out["minInstancesPerNode"] = max(1, min(out["minInstancesPerNode"], n // 2))
    if "subsamplingRate" in out:
        out["subsamplingRate"] = min(1.0, max(out["subsamplingRate"], 1 / max(n, 1)))
    if "featureSubsetStrategy" in out and model != "random_forest":
        out.pop("featureSubsetStrategy")
    if model == "linear_svm" and task != "classification":
        raise ValueError("a linear SVM separates classes")
    return out


@dataclass
class Boosting:
    """AdaBoost as a candidate of a search."""

    rounds: int = 10
    depth: int = 1
    weight: str | None = None

    def fit(self, df: DataFrame) -> AdaBoost:
        return adaboost(df, self.rounds, self.depth, self.weight)


@dataclass
class Neighbours:
    """Votes or means of the nearest training rows, as a candidate of a search."""

    k: int = 5
    weights: str = "uniform"
    task: str = "classification"

    def fit(self, df: DataFrame) -> NeighboursModel:
        v = vector_to_array("features")
        return NeighboursModel(cut(df.select(F.monotonically_increasing_id().alias("id"), v.alias("v"), F.col("label").cast("double").alias("label"))), self.k, self.weights, self.task)


@dataclass
class NeighboursModel:
    """Training rows (id, v, label), searched exactly."""

    rows: DataFrame
    k: int
    weights: str
    task: str

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with predictions; rows with equal features are one question."""
        numbered = cut(df.withColumn("_v", vector_to_array("features")).withColumn("_row", F.monotonically_increasing_id()))
        asked = cut(numbered.groupBy("_v").agg(F.min("_row").alias("id")))
        told = (neighbours.vote if self.task == "classification" else neighbours.average)(asked.select("id", F.col("_v").alias("v")), self.rows, self.k, self.weights)
        return numbered.join(asked.join(told, "id").drop("id"), "_v", "left").drop("_v", "_row")

    def save(self, spark: SparkSession, path: str) -> None:
        self.rows.write.mode("overwrite").parquet(f"{path}/rows")
        spark.createDataFrame([(self.k, self.weights, self.task)], "k int, weights string, task string").coalesce(1).write.mode("overwrite").parquet(f"{path}/state")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> NeighboursModel:
        return cls(spark.read.parquet(f"{path}/rows"), *spark.read.parquet(f"{path}/state").select("k", "weights", "task").head())


def estimator(model: str, task: str, classes: int, params: dict):  # noqa: ANN201
    """The estimator of a model; binary ones are used one against the rest for more classes."""
    if model == "knn":
        return Neighbours(task=task, **params)
    if task == "classification":
        if model == "adaboost":
            return Boosting(**params)
        make = {"logistic_regression": C.LogisticRegression, "linear_svm": C.LinearSVC, "decision_tree": C.DecisionTreeClassifier, "random_forest": C.RandomForestClassifier, "gradient_boosting": C.GBTClassifier, "naive_bayes": C.NaiveBayes}[model]
        one = make(**params)
        return C.OneVsRest(classifier=one) if classes > 2 and model in ("linear_svm", "gradient_boosting") else one
    make = {"linear_regression": R.LinearRegression, "ridge": R.LinearRegression, "lasso": R.LinearRegression, "elastic_net": R.LinearRegression, "decision_tree": R.DecisionTreeRegressor, "random_forest": R.RandomForestRegressor, "gradient_boosting": R.GBTRegressor}[model]
    return make(**params)


DEFAULT_MODELS = {"classification": ("logistic_regression", "decision_tree", "random_forest"), "regression": ("ridge", "decision_tree", "random_forest")}


@dataclass
class Search:
    results: DataFrame
    best: Model
    best_name: str
    params: dict
    failures: list[tuple[str, str]] = field(default_factory=list)
    stopped: dict[str, int] = field(default_factory=dict)

    def save(self, spark: SparkSession, path: str) -> None:
        """Writes the table of results, the failures, and the best model with its name and parameters."""
        self.results.write.mode("overwrite").parquet(f"{path}/results")
        spark.createDataFrame(self.failures, "model string, error string").write.mode("overwrite").parquet(f"{path}/failures")
        own = isinstance(self.best, (AdaBoost, NeighboursModel, Trees))
        if own:
            self.best.save(spark, f"{path}/best")
        else:
            self.best.write().overwrite().save(f"{path}/best")
        state = [(self.best_name, json.dumps(self.params), type(self.best).__name__ if own else "", json.dumps(self.stopped))]
        spark.createDataFrame(state, "name string, params string, own string, stopped string").coalesce(1).write.mode("overwrite").parquet(f"{path}/state")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Search:
        name, params, own, stopped = spark.read.parquet(f"{path}/state").select("name", "params", "own", "stopped").head()
        kinds = {"AdaBoost": AdaBoost, "NeighboursModel": NeighboursModel, "Trees": Trees}
        best = kinds[own].load(spark, f"{path}/best") if own else DefaultParamsReader.loadParamsInstance(f"{path}/best", spark)
        return cls(spark.read.parquet(f"{path}/results"), best, name, json.loads(params), [tuple(r) for r in spark.read.parquet(f"{path}/failures").collect()], json.loads(stopped))


def evaluator(task: str, weight: str | None = None):  # noqa: ANN201
    weighted = {"weightCol": weight} if weight else {}
    return V.MulticlassClassificationEvaluator(metricName="f1", **weighted) if task == "classification" else V.RegressionEvaluator(metricName="r2", **weighted)


#: Models that learn the same from rows and from ``grouped`` rows; the others draw rows (see ``DRAWN``), or look for single ones.
BY_WEIGHT = ("logistic_regression", "linear_svm", "decision_tree", "naive_bayes", "adaboost", "linear_regression", "ridge", "lasso", "elastic_net")


def grouped(data: DataFrame, task: str) -> DataFrame:
    """fold, features, label, weight: ``data`` (fold, features, label) with a row for each label that the same features have in a fold.

    For numbers it is two rows of half the weight, at the mean less and plus the standard deviation: what squared errors
    are summed from (how many rows, the sum of their labels and of the squares) stays the same.
    """
    v = data.select("fold", vector_to_array("features").alias("v"), "label")
    if task == "classification":
        each = v.groupBy("fold", "v", "label").agg(F.count("*").cast("double").alias("weight"))
    else:
        sums = v.groupBy("fold", "v").agg(F.count("*").cast("double").alias("n"), F.avg("label").alias("m"), F.stddev_pop("label").alias("s"))
        at = F.when(F.col("s") > 0, F.array(F.col("m") - F.col("s"), F.col("m") + F.col("s"))).otherwise(F.array("m"))
        each = sums.withColumn("at", at).select("fold", "v", F.explode("at").alias("label"), (F.col("n") / F.size("at")).alias("weight"))
    return each.select("fold", array_to_vector("v").alias("features"), "label", "weight")


def _may_repeat(data: DataFrame, task: str, n: int) -> bool:
    """False where more than half of the ``n`` rows are sure to stay if ``data`` is ``grouped``: by an approximate count of what
    differs, 15 standard errors less. It shuffles nothing, so rows that do not repeat are not grouped to find that out."""
    error = 0.02
    kinds = F.xxhash64("fold", vector_to_array("features"), *["label"] * (task == "classification"))
    return data.agg(F.approx_count_distinct(kinds, error)).head()[0] * (1 - 15 * error) <= n / 2


@F.pandas_udf(DoubleType())
def _drawn(weight: pd.Series, mark: pd.Series, share: pd.Series) -> pd.Series:
    """How many of a row's ``weight`` equal rows are drawn: with replacement (``share`` 0), or each with that chance."""
    order = np.argsort(mark.to_numpy(), kind="stable")
    rng = np.random.default_rng(int(mark.to_numpy().astype(np.uint64).sum()))
    w, p, out = weight.to_numpy()[order], share.to_numpy()[order], np.zeros(len(weight))
    part = w - np.floor(w)  # half a row, of a group that ``grouped`` divides in two
    out[order] = np.where(p == 0, rng.poisson(w), rng.binomial(np.floor(w).astype(np.int64), p) + part * (rng.random(len(w)) < p))
    return pd.Series(out)


def _sample(df: DataFrame, seed: int, tree: int, share: float = 0.0) -> DataFrame:
    """``df`` (features, label, weight) with the weights drawn for a tree."""
    mark = F.xxhash64(F.lit(seed), F.lit(tree), vector_to_array("features"), "label")
    return df.withColumn("weight", _drawn("weight", mark, F.lit(share))).where("weight > 0")


@dataclass
class Trees:
    """Trees for numbers, added up by weights."""

    trees: list[Model]
    weights: list[float]

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802
        total = sum(w * t.featureImportances.toArray() for t, w in zip(self.trees, self.weights))
        return DenseVector(total / (total.sum() or 1.0))

    def transform(self, df: DataFrame) -> DataFrame:
        out = df.withColumn("_v", F.lit(0.0))
        for m, w in zip(self.trees, self.weights):
            out = m.transform(out).withColumn("_v", F.col("_v") + F.lit(w) * F.col("prediction")).drop("prediction")
        return out.withColumnRenamed("_v", "prediction")

    def save(self, spark: SparkSession, path: str) -> None:
        for i, m in enumerate(self.trees):
            m.write().overwrite().save(f"{path}/tree-{i}")
        spark.createDataFrame(list(enumerate(map(float, self.weights))), "tree int, weight double").coalesce(1).write.mode("overwrite").parquet(f"{path}/weights")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Trees:
        rows_ = spark.read.parquet(f"{path}/weights").orderBy("tree").collect()
        return cls([DefaultParamsReader.loadParamsInstance(f"{path}/tree-{r['tree']}", spark) for r in rows_], [r["weight"] for r in rows_])


def forest_by_weight(df: DataFrame, numTrees: int, seed: int, **params: object) -> Trees:  # noqa: N803
    """A random forest from ``grouped`` rows: for each tree, every row is drawn as often as its equal rows would be."""

    def grown(i: int) -> Model:
        return R.RandomForestRegressor(numTrees=1, bootstrap=False, seed=seed + i, **params).fit(_sample(df, seed, i))

    with ThreadPoolExecutor(4) as each:
        return Trees(list(each.map(grown, range(numTrees))), [1 / numTrees] * numTrees)


def boosted_by_weight(df: DataFrame, maxIter: int, seed: int, stepSize: float, subsamplingRate: float, **params: object) -> Trees:  # noqa: N803
    """Boosted trees for squared errors from ``grouped`` rows, each tree from a share of the equal rows, as Spark's are."""
    trees, weights, data = [], [], df.select("features", "label", "weight", F.lit(0.0).alias("_told"))
    for i in range(maxIter):
        left = data.withColumn("label", F.col("label") if i == 0 else 2 * (F.col("label") - F.col("_told")))
        trees.append(R.DecisionTreeRegressor(seed=seed, **params).fit(left if subsamplingRate >= 1 else _sample(left, seed, i, subsamplingRate)))
        weights.append(1.0 if i == 0 else stepSize)
        data = trees[-1].transform(data).withColumn("_told", F.col("_told") + F.lit(weights[-1]) * F.col("prediction")).drop("prediction")
        if i % 4 == 3:
            data = cut(data)
    return Trees(trees, weights)


#: Models for numbers that draw rows, as they learn from ``grouped`` rows.
DRAWN = {"random_forest": forest_by_weight, "gradient_boosting": boosted_by_weight}


def _by_weight(params: dict, total: float) -> dict:
    """``params`` for ``grouped`` rows of that total weight: the least number of rows in a leaf becomes a least weight."""
    out = dict(params)
    if "minInstancesPerNode" in out:
        out["minWeightFractionPerNode"] = min(0.499, (out.pop("minInstancesPerNode") - 0.5) / max(total, 1.0))
    return out


#: Parts of a grouped table at most, so that many small fits have few tasks.
GROUPED_PARTS = 64


def search(train: DataFrame, key: str, task: str, models: tuple[str, ...] | None = None, trials: int = 75, k: int = 5, seed: int = 42, give_up: int = 5, parallel: int = 4) -> Search:
    """Random search with k folds over ``train`` (key, features, label); models ranked by how well they generalise.

    Folds are dealt by a hash of the key within each class; ``parallel`` fits run at a time, so that small stages fill
    the cluster. A model's search ends after ``give_up`` failures in a row. A trial is stopped (and counted in
    ``stopped``) once it could not reach the best mean so far even with perfect scores, 1, on its other folds; so the
    result is that of a search that fits all folds. The best parameters of each model are fitted again on all training
    rows. Where half of the rows or more repeat the features of others in their fold, models are scored on ``grouped``
    rows, and those ``BY_WEIGHT`` learn from them; so do those for numbers that draw rows (``DRAWN``).
    """
    data = stored(rows.folds(train.select(key, "features", F.col("label").cast("double").alias("label")), key, "label" if task == "classification" else None, k, seed))
    n, classes = data.count(), int((data.agg(F.max("label")).head()[0] or 0)) + 1
    failures, table, fitted, stopped = [], [], {}, {}
    few, weights, repeated = data, {}, _may_repeat(data, task, n)
    if repeated:
        few = stored(grouped(data, task).coalesce(GROUPED_PARTS))
        weights = {r[0]: r[1] for r in few.groupBy("fold").agg(F.sum("weight")).collect()}  # a row for each fold
        repeated = few.count() <= n / 2
    measure, asked = (evaluator(task, "weight"), few) if repeated else (evaluator(task), data)

    def fit(name: str, params: dict, fold: int | None = None):  # noqa: ANN202
        """The model of all folds but one."""
        params, learn = repaired(name, params, n, task), data
        if repeated and (name in BY_WEIGHT or (task == "regression" and name in DRAWN)):
            params, learn = _by_weight(params, sum(w for f, w in weights.items() if f != fold)), few
            params["weight" if name == "adaboost" else "weightCol"] = "weight"
        learn = learn if fold is None else learn.where(F.col("fold") != fold)
        if repeated and task == "regression" and name in DRAWN:
            return DRAWN[name](learn, **params)
        return estimator(name, task, classes, params).fit(learn)

    def score(name: str, params: dict, fold: int) -> float:
        return measure.evaluate(fit(name, params, fold).transform(asked.where(F.col("fold") == fold)))

    def scored(name: str, params: dict, least: float) -> list[float] | None:
        """A score for each fold, or None once their mean cannot be above ``least``: one fold, then the others as threads are free."""
        known = {0: score(name, params, 0)}

        def next_(fold: int) -> None:
            so_far = list(known.values())
            if (sum(so_far) + k - len(so_far)) / k > least:
                known[fold] = score(name, params, fold)

        list(folds.map(next_, range(1, k)))
        return [known[f] for f in range(k)] if len(known) == k else None

    def tried(name: str) -> tuple[str, tuple[list[float], dict] | None, list[tuple[str, str]], int]:
        sampler, best, lost, errors, ended = Sampler(seed), None, 0, [], 0
        for _ in range(trials):
            params = draw(name, sampler, n)
            try:
                scores = scored(name, params, np.mean(best[0]) if best else -np.inf)
            except Exception as e:  # a trial may fail; the search goes on
                errors.append((name, str(e)[:200]))
                lost += 1
                if lost >= give_up:
                    break
                continue
            lost = 0
            if scores is None:
                ended += 1
            elif best is None or np.mean(scores) > np.mean(best[0]):
                best = (scores, params)
        return name, best, errors, ended

    names = models or DEFAULT_MODELS[task]
    with ThreadPoolExecutor(parallel) as folds, ThreadPoolExecutor(max(1, min(parallel, len(names)))) as each:
        for name, best, errors, ended in each.map(tried, names):
            failures += errors
            stopped[name] = ended
            if best is None:
                continue
            model = fit(name, best[1])
            fitted[name] = (model, best[1])
            table.append((name, float(measure.evaluate(model.transform(asked))), float(np.mean(best[0])), float(np.std(best[0]))))
    results = metrics.ranked(train.sparkSession.createDataFrame(table, "model string, train_score double, cv_score double, cv_std double"))
    top = results.where("rank = 1").head()["model"]
    return Search(results, fitted[top][0], top, fitted[top][1], failures, stopped)


def importance(model: Model, features: list[str], spark: SparkSession, top: int = 20) -> DataFrame:
    """feature, importance: of trees, or the size of coefficients; the ``top`` largest."""
    if hasattr(model, "featureImportances"):
        values = model.featureImportances.toArray()
    elif hasattr(model, "coefficientMatrix"):
        values = np.abs(model.coefficientMatrix.toArray()).mean(axis=0)
    elif hasattr(model, "coefficients"):
        values = np.abs(model.coefficients.toArray())
    else:
        values = np.zeros(len(features))
    ordered = sorted(zip(features, map(float, values)), key=lambda x: (-x[1], x[0]))[:top]
    return spark.createDataFrame(ordered, "feature string, importance double")


def stability(model: Model, predictions: DataFrame, train_score: float, cv_score: float) -> DataFrame:
    """check, failed: what makes a fitted model doubtful."""
    values = np.concatenate([np.ravel(getattr(model, a).toArray()) for a in ("coefficients", "coefficientMatrix", "featureImportances") if _has(model, a)] or [np.zeros(0)])
    p = predictions.agg(F.count_distinct("prediction").alias("kinds"), F.count_if(F.isnan("prediction") | F.col("prediction").isNull() | (F.abs("prediction") == float("inf"))).alias("odd"), F.var_pop("prediction").alias("v")).head()
    checks = [("coefficients", bool(values.size and (~np.isfinite(values)).any() or (np.abs(values) > 1e6).any())), ("predictions", p["odd"] > 0), ("single_class", p["kinds"] <= 1), ("zero_variance", (p["v"] or 0) == 0), ("gap", abs(train_score - cv_score) > 0.5), ("no_skill", cv_score <= 0 and train_score > 0.5), ("not_converged", _cut_short(model))]
    return predictions.sparkSession.createDataFrame([(a, bool(b)) for a, b in checks], "check string, failed boolean")


def _cut_short(model: Model) -> bool:
    """Whether an iterative fit ended because its iterations were used up."""
    if not _has(model, "summary") or not _has(model.summary, "totalIterations") or not model.hasParam("maxIter"):
        return False
    return model.summary.totalIterations >= model.getOrDefault("maxIter") > 0


def _has(model: Model, name: str) -> bool:
    try:
        getattr(model, name)
    except Exception:
        return False
    return True


def score(model: Model, df: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Predictions with ``confidence`` (highest probability), ``probabilities`` by label, and ``predicted`` (the label's name)."""
    out = model.transform(df)
    if "probability" in out.columns:
        p = vector_to_array("probability")
        out = out.withColumn("confidence", F.array_max(p))
        if labels:
            out = out.withColumn("probabilities", F.map_from_arrays(F.array(*map(F.lit, labels)), p))
    if labels:
        out = out.withColumn("predicted", F.get(F.array(*map(F.lit, labels)), F.col("prediction").cast("int")))
    return out


def fit_fixed(train: DataFrame, name: str, task: str = "classification", params: dict | None = None) -> PipelineModel:
    """One model with given parameters, as a pipeline that can be saved."""
    classes = int(train.agg(F.max("label")).head()[0] or 0) + 1
    return Pipeline(stages=[estimator(name, task, classes, params or {})]).fit(train)


# Boosting, forests of isolation, clusters


@dataclass
class AdaBoost:
    stumps: list[Model]
    weights: list[float]
    classes: int

    def transform(self, df: DataFrame) -> DataFrame:
        out = df.withColumn("_v", F.array(*[F.lit(0.0)] * self.classes))
        for m, w in zip(self.stumps, self.weights):
            told = F.array(*[F.when(F.col("prediction") == c, w).otherwise(0.0) for c in range(self.classes)])
            out = m.transform(out).withColumn("_v", F.zip_with("_v", told, lambda a, b: a + b)).drop("rawPrediction", "probability", "prediction")
        return out.withColumn("prediction", (F.array_position("_v", F.array_max("_v")) - 1).cast("double")).drop("_v")

    def save(self, spark: SparkSession, path: str) -> None:
        for i, m in enumerate(self.stumps):
            m.write().overwrite().save(f"{path}/stump-{i}")
        rows_ = [(i, float(w), self.classes) for i, w in enumerate(self.weights)]
        spark.createDataFrame(rows_, "stump int, weight double, classes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/weights")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> AdaBoost:
        rows_ = spark.read.parquet(f"{path}/weights").orderBy("stump").collect()
        stumps = [C.DecisionTreeClassificationModel.load(f"{path}/stump-{r['stump']}") for r in rows_]
        return cls(stumps, [r["weight"] for r in rows_], rows_[0]["classes"] if rows_ else 1)


def adaboost(train: DataFrame, rounds: int = 10, depth: int = 1, weight: str | None = None) -> AdaBoost:
    """SAMME: trees on reweighted rows; weights are a column, updated by expression, and cut from their lineage every 4 rounds.

    ``weight``: the column of the rows' first weights, if they are not 1.
    """
    data = train.select("features", F.col("label").cast("double").alias("label"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
    classes = int(data.agg(F.max("label")).head()[0]) + 1
    stumps, weights = [], []
    for i in range(rounds):
        model = C.DecisionTreeClassifier(maxDepth=depth, weightCol="w").fit(data)
        seen = model.transform(data).withColumn("miss", (F.col("prediction") != F.col("label")).cast("double"))
        err = seen.agg(F.sum(F.col("w") * F.col("miss")) / F.sum("w")).head()[0]
        if err >= 1 - 1 / classes:
            break
        alpha = math.log((1 - max(err, 1e-10)) / max(err, 1e-10)) + math.log(classes - 1)
        stumps.append(model)
        weights.append(alpha)
        if err <= 1e-10:
            break
        data = seen.select("features", "label", (F.col("w") * F.exp(F.lit(alpha) * F.col("miss"))).alias("w"))
        if i % 4 == 3:
            data = cut(data)
    return AdaBoost(stumps, weights, classes)


def _path_tree(x: np.ndarray, limit: int, rng: np.random.Generator) -> list:
    """Nodes (feature, threshold, left, right) or (-1, size): a random isolation tree."""
    nodes: list = []

    def grow(at: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append(None)
        span = x[at].max(axis=0) - x[at].min(axis=0) if at.size else np.zeros(x.shape[1])
        if depth >= limit or at.size <= 1 or not (span > 0).any():
            nodes[me] = [-1, float(at.size), 0, 0]
            return me
        f = int(rng.choice(np.flatnonzero(span > 0)))
        cut_at = float(rng.uniform(x[at, f].min(), x[at, f].max()))
        left = x[at, f] < cut_at
        nodes[me] = [f, cut_at, grow(at[left], depth + 1), grow(at[~left], depth + 1)]
        return me

    grow(np.arange(len(x)), 0)
    return nodes


def _average_path(n: float) -> float:
    return 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)


def _steps(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """A tree's nodes by what a row needs: component, threshold, the nodes below (of node i at 2i and 2i + 1; a leaf lies below itself), the
    length of the path to a leaf, and the number of levels."""
    inner, depth = np.flatnonzero(nodes[:, 0] >= 0), np.zeros(len(nodes))
    below = np.repeat(np.arange(len(nodes)), 2)
    for i in inner:  # nodes come before those below them
        below[2 * i : 2 * i + 2] = nodes[i, 2:4]
        depth[below[2 * i : 2 * i + 2]] = depth[i] + 1
    return np.maximum(nodes[:, 0], 0).astype(int), nodes[:, 1], below, depth + np.asarray([_average_path(s) for s in nodes[:, 1]]), int(depth.max(initial=0))


@dataclass
class IsolationForest:
    """Grown trees (nodes as rows of four numbers, and the rows each was grown from) and the score above which a row lies outside."""

    trees: list[tuple[np.ndarray, int]]
    edge: float = float("inf")

    def scored(self, rows_: DataFrame) -> DataFrame:
        """``rows_`` (v) with anomaly_score (higher: more isolated). The trees, of bounded size, are broadcast; works on streams too."""
        shared = rows_.sparkSession.sparkContext.broadcast([_steps(nodes) for nodes, _ in self.trees])
        c = (np.mean([_average_path(s) for _, s in self.trees]) if self.trees else 0.0) or 1.0

        @F.pandas_udf("double")
        def isolation(v: pd.Series) -> pd.Series:
            if not len(v) or not shared.value:
                return pd.Series([0.5] * len(v), dtype=float)
            x, total = np.stack(v.to_numpy()), np.zeros(len(v))
            x, row = x.ravel(), np.arange(len(x)) * x.shape[1]
            for component, edge, below, length, levels in shared.value:
                at = np.zeros(len(v), int)
                for _ in range(levels):
                    at = below[2 * at + (x[row + component[at]] >= edge[at])]
                total += length[at]
            return pd.Series(2 ** (-total / len(shared.value) / c))

        return rows_.withColumn("anomaly_score", isolation(F.col("v").cast("array<double>")))

    def transform(self, rows_: DataFrame) -> DataFrame:
        """``scored``, with anomaly_label: -1 outside, 1 inside."""
        return self.labelled(self.scored(rows_))

    def labelled(self, scored: DataFrame) -> DataFrame:
        return scored.withColumn("anomaly_label", F.when(F.col("anomaly_score") > F.lit(self.edge), -1).otherwise(1))

    def save(self, spark: SparkSession, path: str) -> None:
        table = [(i, size, self.edge, np.asarray(nodes, float).ravel().tolist()) for i, (nodes, size) in enumerate(self.trees)]
        spark.createDataFrame(table, _FOREST).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IsolationForest:
        table = spark.read.schema(_FOREST).parquet(path).orderBy("tree").collect()  # a row for each tree
        return cls([(np.asarray(r["nodes"]).reshape(-1, 4), r["size"]) for r in table], table[0]["edge"] if table else float("inf"))


_FOREST = "tree int, size int, edge double, nodes array<double>"


def _grown_forest(rows_: DataFrame, trees: int, sample: int, seed: int) -> IsolationForest:
    """A forest of ``rows_`` (id, v), without its edge. Each tree grows in a task from about ``sample`` rows drawn by hash."""
    n = rows_.count()
    share = min(1.0, sample / max(n, 1))
    picks = rows_.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    if share < 1:  # twelve digits of a hash, against the share in as many
        h = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "tree", "id").cast("binary")), 1, 12)
        picks = picks.where(h < f"{math.ceil(share * 16**12):012x}")

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf.sort_values("id")["v"].to_numpy())
        nodes = _path_tree(x, max(1, math.ceil(math.log2(max(len(x), 2)))), np.random.default_rng(seed * 1000 + int(key[0])))
        return pd.DataFrame({"tree": [int(key[0])], "size": [len(x)], "nodes": [np.asarray(nodes, float).ravel()]})

    grown = picks.groupBy("tree").applyInPandas(grow, "tree int, size int, nodes array<double>").orderBy("tree").collect()  # ``trees`` rows of bounded size
    return IsolationForest([(np.asarray(r["nodes"]).reshape(-1, 4), r["size"]) for r in grown])


def _edge(scored: DataFrame, contamination: float) -> float:
    """The exact percentile of ``scored`` (anomaly_score), a stored table."""
    edge = profile.quantiles(scored.select("anomaly_score"), ["anomaly_score"], [1 - contamination])["anomaly_score"][0]
    return float("inf") if edge is None else edge


def fit_isolation_forest(rows_: DataFrame, trees: int = 50, sample: int = 256, contamination: float = 0.1, seed: int = 42) -> IsolationForest:
    """A forest of ``rows_`` (id, v). Each tree grows in a task from about ``sample`` rows drawn by hash; the edge is
    the exact percentile of the rows' own scores."""
    forest = _grown_forest(rows_, trees, sample, seed)
    forest.edge = _edge(cut(forest.scored(rows_.select("v")).select("anomaly_score")), contamination)
    return forest


def isolation_forest(rows_: DataFrame, trees: int = 50, sample: int = 256, contamination: float = 0.1, seed: int = 42) -> DataFrame:
    """``rows_`` (id, v) with the scores and labels of a forest of their own; each row is scored once, and stored."""
    forest = _grown_forest(rows_, trees, sample, seed)
    scored = stored(forest.scored(rows_))
    forest.edge = _edge(scored, contamination)
    return forest.labelled(scored)


def kmeans(df: DataFrame, k: int, seed: int = 42) -> K.KMeansModel:
    return K.KMeans(k=k, seed=seed).fit(df)


def minibatch_kmeans(df: DataFrame, k: int, rounds: int = 10, batch: int = 4096, seed: int = 42) -> np.ndarray:
    """Centres (k x dimension) of ``df`` (id, v) by batches: each round about ``batch`` rows, drawn by a hash, move their centres.

    Spark sums each batch by centre; the driver holds the centres alone. Assign rows with ``nearest_centre``.
    """
    n = max(df.count(), 1)
    h = lambda r: F.pmod(F.xxhash64(F.lit(seed), F.lit(r), F.col("id")), F.lit(1 << 30)) / float(1 << 30)
    first = df.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(k).select("v").collect()
    centres, seen = np.asarray([r[0] for r in first], float), np.zeros(len(first))
    for r in range(rounds):
        near = nearest_centre(df.where(h(r) < min(1.0, batch / n)), centres)
        sums = near.select("prediction", F.posexplode("v").alias("i", "x")).groupBy("prediction", "i").agg(F.sum("x").alias("s"), F.count("*").alias("n")).collect()  # k * dimension rows
        total, count = np.zeros_like(centres), np.zeros(len(centres))
        for c, i, s, m in sums:
            total[c, i], count[c] = s, m
        seen += count
        moved = count > 0
        centres[moved] += (total[moved] - count[moved, None] * centres[moved]) / seen[moved, None]
    return centres


def save_centres(spark: SparkSession, centres: np.ndarray, path: str) -> None:
    rows_ = [(i, [float(x) for x in c]) for i, c in enumerate(centres)]
    spark.createDataFrame(rows_, "centre int, v array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def load_centres(spark: SparkSession, path: str) -> np.ndarray:
    return np.asarray([r["v"] for r in spark.read.parquet(path).orderBy("centre").collect()])  # a row for each centre


def nearest_centre(df: DataFrame, centres: np.ndarray) -> DataFrame:
    """``df`` (v) with ``prediction``, the number of the nearest centre; the smaller one of equals."""

    @F.pandas_udf("int")
    def nearest(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy()).astype(float) if len(v) else np.zeros((0, centres.shape[1]))
        return pd.Series(((centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T).argmin(axis=1).astype(np.int32))

    return df.withColumn("prediction", nearest("v"))


def bisecting(df: DataFrame, k: int, seed: int = 42) -> K.BisectingKMeansModel:
    return K.BisectingKMeans(k=k, seed=seed).fit(df)


def clustering_objective(silhouette: float, noise: float, largest: float) -> float:
    """Silhouette, less for much noise or one cluster that holds nearly all."""
    out = silhouette
    if noise > 0.5:
        out *= 1 - noise
    elif noise > 0.2:
        out *= 1 - 0.3 * noise
    return out * 0.5 if largest > 0.9 else out


def anomaly_objective(silhouette: float, ratio: float) -> float:
    """-1 if all rows are on one side, -0.5 for an unlikely share, the silhouette of the split otherwise."""
    if ratio in (0.0, 1.0):
        return -1.0
    return silhouette if 0.001 <= ratio <= 0.5 else -0.5
