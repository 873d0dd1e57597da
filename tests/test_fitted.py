"""Fitted steps and models: what they learn from some rows, kept in a folder, holds for other rows, tables and streams."""

import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from sluice.operators import metrics, neighbours, profile, quality, transforms
from sluice.plans import models, prepare
from sluice.streaming import scoring

WORDS = "river stone paper cloud seven green light market harbour winter".split()


def reloaded(spark, path, *steps):
    transforms.Chain(list(steps)).save(spark, path)
    return transforms.Chain.load(spark, path)


def prose(spark, n=60, seed=1):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.randrange(1, 9))), float(i % 7)) for i in range(n)]
    return spark.createDataFrame([*rows, (900, None, None), (901, "", 1.0), (902, "unheard of", 2.0)], "key long, text string, a double")


def test_texts_on_new_rows_and_streams(spark, tmp_path):
    train, new = prose(spark), prose(spark, 25, 2)
    step = transforms.fit_text(train, "key", ["text"], features=40)
    chain = reloaded(spark, str(tmp_path / "chain"), step)
    at = {r["at"]: (r["term"], r["idf"]) for r in transforms.terms_of(step, spark, "text").collect()}
    assert 0 < len(at) <= 40 and sorted(at) == list(range(len(at)))
    counts = {r["key"]: r["t"] for r in new.select("key", transforms.terms(F.col("text")).alias("t")).collect()}
    out = chain.transform(new)
    assert out.columns == ["key", "a", "text_tfidf"]
    for r in out.select("key", vector_to_array("text_tfidf").alias("v")).collect():
        w = np.asarray([(counts[r["key"]] or []).count(at[i][0]) * at[i][1] for i in range(len(at))])
        assert r["v"] == pytest.approx(w / (np.linalg.norm(w) or 1)), r["key"]
    new.write.parquet(str(tmp_path / "in"))
    arriving = scoring.stream(spark, str(tmp_path / "in"), new)
    scoring.write(chain.transform(arriving).select("key", vector_to_array("text_tfidf").alias("v")), str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
    assert {r["key"]: r["v"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {r["key"]: r["v"] for r in out.select("key", vector_to_array("text_tfidf").alias("v")).collect()}
    nothing = transforms.fit_text(train.where("key > 900"), "key", ["text"])
    assert nothing.transform(new).columns == ["key", "a"]


def test_neighbours_fill_new_rows(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    hole = lambda v: None if rng.random() < 0.3 else v
    rows = [(i, hole(float(rng.randrange(5))), hole(rng.gauss(0, 1)), hole(float(i % 3))) for i in range(90)]
    train = spark.createDataFrame(rows[:60], "key long, a double, b double, c double")
    new = spark.createDataFrame([*rows[60:], (200, None, None, None), (200, 1.0, None, None)], train.schema)
    for how in ("distance", "uniform"):
        chain = reloaded(spark, str(tmp_path / how), transforms.fit_impute_neighbours(train, "key", ["a", "b", "c"], k=3, weights=how))
        y = np.asarray([r[1:] for r in rows[:60]], float)
        expected = []
        for r in new.collect():
            x = np.asarray(r[1:], float)
            done = x.copy()
            for c in np.flatnonzero(np.isnan(x)):
                both = ~np.isnan(y) & ~np.isnan(x)
                d = [np.sqrt(3 / b.sum() * ((y[i] - x)[b] ** 2).sum()) if b.any() and not np.isnan(y[i, c]) else np.inf for i, b in enumerate(both)]
                near = [i for i in np.lexsort((np.arange(60), d))[:3] if np.isfinite(d[i])]
                w = [float(d[i] == 0) if any(d[j] == 0 for j in near) else 1 / d[i] for i in near] if how == "distance" else [1] * len(near)
                done[c] = np.average(y[near, c], weights=w) if near else np.nanmean(y[:, c])
            expected.append((r["key"], *done))
        for held in (10_000, 10):  # donors in the worker, or block by block
            monkeypatch.setattr(transforms, "DONORS_HELD", held)
            got = sorted(tuple(r) for r in chain.transform(new).collect())
            assert np.asarray(got) == pytest.approx(np.asarray(sorted(expected))), (how, held)


def test_neighbours_fill_a_stream(spark, tmp_path):
    train = spark.createDataFrame([(i, float(i), float(2 * i)) for i in range(20)], "key long, a double, b double")
    new = spark.createDataFrame([(50, 3.0, None), (51, None, 8.0)], train.schema)
    step = transforms.fit_impute_neighbours(train, "key", ["a", "b"], k=1)
    new.write.parquet(str(tmp_path / "in"))
    scoring.write(step.transform(scoring.stream(spark, str(tmp_path / "in"), new)), str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [(50, 3.0, 6.0), (51, 4.0, 8.0)]


@pytest.mark.parametrize("centre", [True, False])
def test_projection_of_new_rows(spark, tmp_path, centre):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 2)) @ rng.normal(size=(2, 5)) + 0.05 * rng.normal(size=(80, 5)) + 4
    names = [f"f{i}" for i in range(5)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "key long, " + ", ".join(f"{n} double" for n in names))
    step = transforms.fit_projection(df.where("key < 60"), names, variance=0.99, most=4, centre=centre)
    mean = x[:60].mean(axis=0) if centre else np.zeros(5)
    _, _, v = np.linalg.svd(x[:60] - mean)
    lines = np.asarray(step.state["directions"])
    assert np.abs((lines * v[: len(lines)]).sum(axis=1)) == pytest.approx(np.ones(len(lines)))
    chain = reloaded(spark, str(tmp_path / "chain"), step)
    out = {r["key"]: r["features"] for r in chain.transform(df.where("key >= 60")).collect()}
    assert len(out) == 20 and all(out[i] == pytest.approx((x[i] - mean) @ lines.T) for i in out)
    assert chain.transform(df.limit(0)).count() == 0


def test_prepared_tables_keep_texts_and_derived_features(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, i % 5 + 1, 2 * (i % 5 + 1) + (i % 100 == 0), " ".join(rng.choices(WORDS, k=14)) + f" nr {i}", i % 2, None if i % 4 == 0 else float(i % 11)) for i in range(200)]
    df = spark.createDataFrame(rows, "key long, rooms int, bedrooms int, note string, late int, part double")
    p = prepare.adaptive(df, "key", "late", family="linear")
    assert "note_tfidf" in p.features and {"rooms_minus_bedrooms", "bedrooms_minus_rooms"} & set(p.features), p.features
    chain_path = str(tmp_path / "chain")
    p.chain.save(spark, chain_path)
    again = transforms.Chain.load(spark, chain_path).transform(df.join(p.test.select("key"), "key"))
    vectors = lambda d: {r["key"]: r["features"].toArray().tolist() for r in prepare.vectors(d, p.features).select("key", "features").collect()}
    ours, theirs = vectors(p.test), vectors(again)
    assert ours.keys() == theirs.keys() and all(ours[k] == pytest.approx(theirs[k]) for k in ours)
    train = prepare.vectors(p.train, p.features).withColumn("label", F.col("late").cast("double"))
    assert models.fit_fixed(train, "logistic_regression").transform(prepare.vectors(p.test, p.features)).count() == p.test.count()
    assert "note_tfidf" not in prepare.adaptive(df, "key", "late", family="linear", text=False).features


def test_unsupervised_split_and_projection(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 6))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "key long, " + ", ".join(f"c{i} double" for i in range(6)))
    p = prepare.unsupervised(df, "key", most_features=3, ratio=0.25)
    assert p.features == ["features"] and (p.train.count(), p.test.count()) == (90, 30)
    p.chain.save(spark, str(tmp_path / "chain"))
    again = transforms.Chain.load(spark, str(tmp_path / "chain")).transform(df.join(p.test.select("key"), "key"))
    assert {r["key"]: r["features"] for r in again.collect()} == {r["key"]: r["features"] for r in p.test.collect()}


def test_forest_scores_new_rows(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3))
    df = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "id long, v array<double>")
    new = spark.createDataFrame([(1000, [9.0, -9.0, 9.0]), (1001, [0.0, 0.0, 0.0])], df.schema)
    forest = models.fit_isolation_forest(df, trees=20, contamination=0.05)
    forest.save(spark, str(tmp_path / "forest"))
    again = models.IsolationForest.load(spark, str(tmp_path / "forest"))
    a, b = ({r["id"]: (r["anomaly_score"], r["anomaly_label"]) for r in f.transform(new).collect()} for f in (forest, again))
    assert a == b and a[1000][1] == -1 and a[1001][1] == 1 and a[1000][0] > a[1001][0]
    assert forest.transform(df).where("anomaly_label = -1").count() == 15


def test_curves_of_each_class(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(3), [float(rng.randrange(8)), float(rng.randrange(200)), 1.0]) for _ in range(300)]
    df = spark.createDataFrame(rows, "label int, scores array<double>")
    area = {r["class"]: r["auc"] for r in metrics.auc_each(df).collect()}
    points = metrics.roc_each(df).collect()
    for k in range(3):
        pos, neg = ([s[k] for y, s in rows if (y == k) == is_] for is_ in (True, False))
        assert area[k] == pytest.approx(np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg]))
        for r in (r for r in points if r["class"] == k):
            assert r["tpr"] == pytest.approx(np.mean([p >= r["threshold"] for p in pos])) and r["fpr"] == pytest.approx(np.mean([n >= r["threshold"] for n in neg]))
    none = metrics.auc_each(df.where("label = 1"))
    assert {r["class"]: r["auc"] for r in none.collect()} == {0: None, 1: None, 2: None} and metrics.roc_each(df.limit(0)).count() == 0


@pytest.mark.parametrize("dims", [1, 2, 8])
def test_rows_within_a_radius(spark, dims):
    rng = np.random.default_rng(dims)
    x = rng.normal(size=(150, dims)) * 3
    x[:20] = x[0]
    df = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "id long, v array<double>")
    radius = {1: 0.05, 2: 0.6, 8: 5.0}[dims]
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    expected = {(i, j) for i, j in zip(*np.nonzero(d <= radius * radius)) if i != j}
    assert {(r["id"], r["nid"]) for r in neighbours.within(df, radius).collect()} == expected
    base, pairs = neighbours._cells(df, radius)
    boxes = {}
    for r in base.collect():
        boxes.setdefault(tuple(r["cell"]), []).append(r["v"])
    for r in pairs.collect():
        a, b = (np.asarray(boxes[tuple(c)]) for c in (r["cell"], r["other"]))
        gap = np.maximum(np.maximum(a.min(axis=0) - b.max(axis=0), b.min(axis=0) - a.max(axis=0)), 0)
        assert (gap**2).sum() <= radius * radius * (1 + 1e-9)
    assert neighbours.within(df.limit(0), radius).count() == 0


def test_empty_tables(spark):
    df = spark.createDataFrame([], "a double, b double, c string")
    assert quality.full_score(df, ["a", "b"], ["c"]).head()["score"] == 100
    assert profile.correlations(df, ["a"]).count() == 0 and profile.missing_total(df).head()["pct_cells"] == 0
    assert profile.outliers(df, ["a"]).head()["n_outliers"] == 0


def test_models_are_the_same_after_loading(spark, tmp_path):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, float(i % 10), rng.random(), float(i % 10 > 4)) for i in range(120)], "id long, a double, b double, label double")
    data = prepare.vectors(df, ["a", "b"])
    said = lambda m: {r["id"]: r["prediction"] for r in m.transform(data).collect()}
    boosted = models.adaboost(data, rounds=3)
    boosted.save(spark, str(tmp_path / "boosted"))
    assert said(boosted) == said(models.AdaBoost.load(spark, str(tmp_path / "boosted")))
    for names in (("knn",), ("adaboost",), ("decision_tree", "linear_svm")):
        found = models.search(data, "id", "classification", names, trials=1, k=2)
        found.save(spark, str(tmp_path / names[0]))
        again = models.Search.load(spark, str(tmp_path / names[0]))
        assert said(found.best) == said(again.best) and (again.best_name, again.params) == (found.best_name, found.params)
        assert sorted(map(str, again.results.collect())) == sorted(map(str, found.results.collect()))
    near = models.search(data, "id", "regression", ("knn",), trials=1, k=2)
    assert near.best_name == "knn" and len(said(near.best)) == 120
    v = data.select("id", vector_to_array("features").alias("v"))
    centres = models.minibatch_kmeans(v, 3, rounds=2)
    models.save_centres(spark, centres, str(tmp_path / "centres"))
    assert np.array_equal(models.load_centres(spark, str(tmp_path / "centres")), centres)


def test_similar_values(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdé", k=rng.randrange(1, 14))) for _ in range(60)]
    words += [w[:3] + rng.choice("xyz") + w[4:] for w in words if len(w) > 6] + [w + "q" for w in words[:20]] + ["", "wörter", "worter", "wortern"]
    df = spark.createDataFrame([(w, "same") for w in words for _ in range(1 + len(w) % 2)] + [(None, None)], "a string, b string")

    def edits(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            row, last = [i], row
            for j, e in enumerate(y, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != e)))
        return row[-1]

    count = {w: sum(1 + len(x) % 2 for x in words if x == w) for w in words if w}
    expected = set()
    for x in count:
        for y in count:
            s = 1 - edits(x, y) / max(len(x), len(y))
            if x != y and s >= 0.8 - 1e-9 and (count[x] < count[y] or count[x] == count[y] and x > y):
                expected.add(("a", x, count[x], y, count[y], round(s, 9)))
    assert len(expected) > 20
    assert {(*tuple(r)[:5], round(r["similarity"], 9)) for r in profile.similar_values(df, ["a", "b"]).collect()} == expected


def test_search_learns_from_grouped_rows(spark, monkeypatch):
    """Repeated rows are learned from and asked about once, with the same models and scores."""
    rng = random.Random(8)
    rows_ = [(i, float(rng.randrange(4)), float(rng.randrange(3))) for i in range(400)]
    rows_ = [(i, a, b, a * 2 - b + rng.random(), float(a + rng.random() > 2)) for i, a, b in rows_]
    data = prepare.vectors(spark.createDataFrame(rows_, "id long, a double, b double, y double, c double"), ["a", "b"]).cache()
    sizes = []
    made = models.estimator

    def watched(name, task, classes, params):
        est = made(name, task, classes, params)
        fit = est.fit
        est.fit = lambda df: (sizes.append(df.count()), fit(df))[1]
        return est

    for task, label, names in (("regression", "y", ("ridge", "lasso", "decision_tree")), ("classification", "c", ("logistic_regression", "decision_tree", "adaboost"))):
        labelled = data.withColumn("label", F.col(label))
        few = models.grouped(labelled.withColumn("fold", F.lit(0)), task)
        for name in names:
            params = {"minInstancesPerNode": 30} if name == "decision_tree" else {"depth": 1, "rounds": 2} if name == "adaboost" else {"regParam": 0.1, "elasticNetParam": float(name == "lasso")}
            weighted = models._by_weight(params, 400.0) | {"weight" if name == "adaboost" else "weightCol": "weight"}
            whole, small = made(name, task, 2, params).fit(labelled), made(name, task, 2, weighted).fit(few)
            told = [{tuple(r.features): round(r.prediction, 6) for r in m.transform(few).collect()} for m in (whole, small)]
            assert told[0] == told[1], name
        monkeypatch.setattr(models, "estimator", watched)
        models.search(labelled.select("id", "features", "label"), "id", task, names[:1], trials=1, k=2)
        monkeypatch.setattr(models, "estimator", made)
        assert max(sizes) <= 2 * 2 * 12
    asked = []
    vote = models.neighbours.vote
    monkeypatch.setattr(models.neighbours, "vote", lambda test, *a: (asked.append(test.count()), vote(test, *a))[1])
    near = models.Neighbours(3).fit(data.withColumn("label", F.col("c")))
    assert near.transform(data.select("id", "features")).where("prediction is not null").count() == 400 and asked == [12]


def test_search_groups_no_rows_that_do_not_repeat(spark, monkeypatch):
    """Rows with features of their own are not shuffled to see whether they repeat."""
    rng = random.Random(5)
    rows_ = [(i, rng.random(), float(i % 3)) for i in range(300)]
    data = prepare.vectors(spark.createDataFrame([(i, a, b, float(a + b / 4 > 0.7)) for i, a, b in rows_], "id long, a double, b double, label double"), ["a", "b"])
    calls, group = [], models.grouped
    monkeypatch.setattr(models, "grouped", lambda d, t: (calls.append(t), group(d, t))[1])
    found = models.search(data, "id", "classification", ("decision_tree",), trials=1, k=3)
    assert not calls and not found.failures and found.results.head()["cv_score"] > 0.9
    assert not models._may_repeat(data.withColumn("fold", F.lit(0)), "classification", 300)
    assert models._may_repeat(data.withColumn("fold", F.lit(0)), "classification", 600)


def test_forests_and_boosting_learn_from_grouped_rows(spark, monkeypatch, tmp_path):
    """No fit of numbers reads all of many equal rows, and what is told is near what Spark's own learn from all rows."""
    rng = random.Random(8)
    rows = [(i, float(a), float(b), a * a + 3.0 * b + rng.gauss(0, 1)) for i in range(600) for a, b in [(rng.randrange(4), rng.randrange(3))]]
    data = prepare.vectors(spark.createDataFrame(rows, "id long, a double, b double, label double"), ["a", "b"])
    sizes = []
    for made in (models.R.RandomForestRegressor, models.R.GBTRegressor, models.R.DecisionTreeRegressor):
        keep = made.fit
        monkeypatch.setattr(made, "fit", lambda self, df, *a, keep=keep: (sizes.append(df.count()), keep(self, df, *a))[1])
    plain = {"random_forest": models.R.RandomForestRegressor(numTrees=4, maxDepth=4, featureSubsetStrategy="all", seed=7), "gradient_boosting": models.R.GBTRegressor(maxIter=3, maxDepth=3, stepSize=0.3, subsamplingRate=0.7, seed=7)}
    drawn = {"random_forest": {"numTrees": 4, "maxDepth": 4, "seed": 7, "minInstancesPerNode": 1, "featureSubsetStrategy": "all"}, "gradient_boosting": {"maxIter": 3, "maxDepth": 3, "stepSize": 0.3, "subsamplingRate": 0.7, "seed": 7}}
    monkeypatch.setattr(models, "draw", lambda name, s, n: dict(drawn[name]))
    for name in plain:
        found = models.search(data.select("id", "features", "label"), "id", "regression", (name,), trials=1, k=2)
        assert not found.failures and sizes and max(sizes) <= 2 * 2 * 12
        told = [r[0] for r in found.best.transform(data).orderBy("id").select("prediction").collect()]
        expected = [r[0] for r in plain[name].fit(data).transform(data).orderBy("id").select("prediction").collect()]
        sizes.clear()
        assert np.abs(np.subtract(told, expected)).max() < 0.8, name
        found.save(spark, str(tmp_path / name))
        again = models.Search.load(spark, str(tmp_path / name)).best
        assert [r[0] for r in again.transform(data).orderBy("id").select("prediction").collect()] == told
        assert models.importance(again, ["a", "b"], spark).head()["feature"] == "a"
