"""The fitted transforms as stages of pipelines: parameters, round trips, streams, grids and cross-validation."""

import random

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import functions as F

from sluice.operators import columns, transforms
from sluice.plans import models, prepare, stages
from sluice.streaming import scoring


def table(spark, n, seed):
    rng = random.Random(seed)
    hole = lambda v: None if rng.random() < 0.2 else v
    rows = []
    for i in range(n):
        a = rng.gauss(0, 1)
        rows.append((i, hole(a), a * 2 + rng.gauss(0, 0.01), hole(rng.expovariate(1.0)), 1.0, hole(rng.choice("xyz")), rng.choice(["u", "v"] * 20 + ["w"]), rng.choice(["red green", "green blue", "blue red red"]), f"2024-0{1 + i % 9}-0{1 + i % 7} 1{i % 10}:00:00", "?", float(a > 0), i % 3))
    names = "key long, lot_area double, lot_width double, c double, flat double, letter string, kind string, prose string, at string, gone string, label double, fold int"
    return spark.createDataFrame(rows, names).withColumn("at", F.col("at").cast("timestamp"))


def every_kind():
    """One stage of each kind, as they can stand behind each other."""
    return [
        stages.MissingIndicators(inputCols=["lot_area", "lot_width", "c"]),
        stages.NeighbourImputer(inputCols=["lot_area", "lot_width", "c"], fillCols=["lot_area"], keyCol="key", k=3),
        stages.ColumnImputer(inputCols=["c"], strategy="mean"),
        stages.ColumnImputer(inputCols=["letter"], strategy="constant", fill="none"),
        stages.DerivedFeatures(inputCols=["lot_area", "lot_width"], family="distance", limit=0.95),
        stages.OutlierCapper(inputCols=["c"], k=1.5),
        stages.SelectivePowers(inputCols=["lot_area", "c"]),
        stages.ColumnScaler(inputCols=["c"], how="robust"),
        stages.RareGrouper(inputCols=["kind"], share=0.1),
        stages.OrdinalCodes(inputCols=["kind"]),
        stages.IndicatorColumns(inputCols=["letter"], dropFirst=True),
        stages.DateFeatures(inputCols=["at"], family="distance"),
        stages.TextVectorizer(inputCols=["prose"], keyCol="key", most=1.0),
        stages.VarianceFilter(inputCols=["flat", "c"]),
        stages.ColumnDropper(inputCols=["gone"]),
        stages.FeatureVector(inputCols=["lot_area", "c", "kind", "letter", "at", "prose"]),
        stages.Projection(inputCols=["lot_area", "c"], most=1),
    ]


def rows_of(df):
    out = df.withColumns({c: vector_to_array(c) for c in ("features", "prose_tfidf") if c in df.columns})
    return sorted(map(repr, (r.asDict() for r in out.collect())))


def test_every_kind_is_saved_loaded_and_streamed(spark, tmp_path):
    train, new = table(spark, 120, 1), table(spark, 40, 2)
    assert {type(s) for s in every_kind()} == {c for c in vars(stages).values() if isinstance(c, type) and issubclass(c, stages._Fits) and c is not stages._Fits}
    Pipeline(stages=every_kind()).write().save(str(tmp_path / "unfitted"))
    unfitted = Pipeline.load(str(tmp_path / "unfitted"))
    for one, other in zip(every_kind(), unfitted.getStages()):
        assert type(one) is type(other)
        assert {p.name: v for p, v in one.extractParamMap().items()} == {p.name: v for p, v in other.extractParamMap().items()}
    fitted = unfitted.fit(train)
    assert [s.uid for s in fitted.stages] == [s.uid for s in unfitted.getStages()]
    kinds = {x.kind for s in fitted.stages for x in s.chain.steps}
    assert kinds == set(transforms._APPLY)
    expected = rows_of(fitted.transform(new))
    assert len(expected) == 40
    fitted.write().save(str(tmp_path / "fitted"))
    loaded = PipelineModel.load(str(tmp_path / "fitted"))
    assert rows_of(loaded.transform(new)) == expected
    new.write.parquet(str(tmp_path / "in"))
    scoring.write(loaded.transform(scoring.stream(spark, str(tmp_path / "in"), new)), str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
    assert rows_of(spark.read.parquet(str(tmp_path / "out"))) == expected


def test_stages_do_what_their_transforms_do(spark):
    train, new = table(spark, 60, 3), table(spark, 30, 4)
    pairs = [
        (stages.ColumnImputer(inputCols=["c"]), transforms.fit_impute(train, ["c"], "median")),
        (stages.OutlierCapper(inputCols=["c"], k=0.5), transforms.fit_cap(train, ["c"], 0.5)),
        (stages.ColumnScaler(inputCols=["lot_width"], how="minmax"), transforms.fit_scale(train, ["lot_width"], "minmax")),
        (stages.RareGrouper(inputCols=["kind"], share=0.3), transforms.fit_rare(train, ["kind"], 0.3)),
        (stages.DateFeatures(inputCols=["at"]), transforms.fit_dates(train, ["at"], "tree")),
    ]
    for stage, step in pairs:
        assert rows_of(stage.fit(train).transform(new)) == rows_of(step.transform(new)), type(stage)
    assert stages.SelectivePowers(inputCols=["lot_width", "c"], skewness=100.0).fit(train).transform(new).collect() == new.collect()
    bent = stages.SelectivePowers(inputCols=["lot_width", "c"]).fit(train).chain.steps[0].state["powers"]
    assert set(bent) == {"c"}
    k = stages.OutlierCapper(inputCols=["c"])
    assert k.fit(train, {k.k: 0.5}).chain.steps[0].state == transforms.fit_cap(train, ["c"], 0.5).state
    assert k.getOrDefault("k") == 2.5


def test_stages_on_odd_tables(spark):
    train = table(spark, 30, 5)
    chosen = lambda: [stages.ColumnImputer(inputCols=["c"]), stages.OutlierCapper(inputCols=["c"]), stages.OrdinalCodes(inputCols=["letter"]), stages.FeatureVector(inputCols=["c", "letter"])]
    fitted = Pipeline(stages=chosen()).fit(train)
    assert fitted.transform(train.limit(0)).collect() == []
    unknown = train.limit(2).withColumns({"c": F.lit(None).cast("double"), "letter": F.lit("new")})
    assert all(r["v"][1] == -1 for r in fitted.transform(unknown).select(vector_to_array("features").alias("v")).collect())
    nothing = Pipeline(stages=chosen()).fit(train.limit(0))
    assert all(r["v"][1] == -1 for r in nothing.transform(train).select(vector_to_array("features").alias("v")).collect())
    odd = train.withColumnRenamed("c", "a.b c")
    assert stages.ColumnScaler(inputCols=["a.b c"]).fit(odd).transform(odd).count() == 30


def test_grid_of_preparation_and_model(spark, tmp_path):
    df = table(spark, 150, 6)
    cap, logistic = stages.OutlierCapper(inputCols=["lot_area"]), LogisticRegression(maxIter=5, regParam=0.01)
    chain = Pipeline(stages=[stages.ColumnImputer(inputCols=["lot_area"]), cap, stages.FeatureVector(inputCols=["lot_area", "letter"]), logistic])
    chain.setStages([chain.getStages()[0], cap, stages.OrdinalCodes(inputCols=["letter"]), *chain.getStages()[2:]])
    grid = ParamGridBuilder().addGrid(cap.k, [0.01, 2.5]).addGrid(logistic.regParam, [0.01, 1.0]).build()
    measure = MulticlassClassificationEvaluator(metricName="f1")
    validator = CrossValidator(estimator=chain, estimatorParamMaps=grid, evaluator=measure, numFolds=3, foldCol="fold", parallelism=2)
    validator.write().save(str(tmp_path / "validator"))
    found = CrossValidator.load(str(tmp_path / "validator")).fit(df)
    for params, got in zip(grid, found.avgMetrics):
        own = [measure.evaluate(chain.fit(df.where(F.col("fold") != f), params).transform(df.where(F.col("fold") == f))) for f in range(3)]
        assert got == pytest.approx(sum(own) / 3)
    assert len({round(x, 6) for x in found.avgMetrics}) > 1
    found.write().save(str(tmp_path / "found"))
    again = CrossValidatorModel.load(str(tmp_path / "found"))
    same = lambda m: sorted((r["key"], r["prediction"]) for r in m.transform(df).collect())
    assert same(again) == same(found)


def test_preparation_and_model_as_one_pipeline(spark, tmp_path):
    df = table(spark, 150, 7).drop("gone", "fold")
    p = prepare.fixed(df, "key", "label", scale="robust", encode="ordinal")
    model = models.fit_fixed(prepare.vectors(p.train, p.features), "logistic_regression")
    whole = stages.pipeline(p.chain, stages.Step(transforms.Chain([transforms.fit_vector(p.features)])), model)
    whole.write().save(str(tmp_path / "whole"))
    by_hand = scoring.scored(df, p.chain, model, p.features).select("key", "prediction").collect()
    assert sorted(PipelineModel.load(str(tmp_path / "whole")).transform(df).select("key", "prediction").collect()) == sorted(by_hand)


def test_columns_are_judged_alike_however_they_are_counted(spark):
    """Ids, constants and dominated columns by exact counts in plain Python."""
    rng = random.Random(8)
    n = 400
    data = {
        "row_id": list(range(1, n + 1)), "near_id": [*range(n - 15), *[0] * 15], "off_id": [*range(n - 40), *[0] * 40], "half_id": [i // 2 for i in range(n)], "shuffled": rng.sample(range(n), n),
        "dull": [1.0] * (n - 10) + [1.1] * 10, "wild": [1.0] * (n - 10) + [500.0] * 10, "less": [1.0] * (n - 30) + [1.1] * 30, "same": [7] * n, "holes_id": [None if i % 5 else i for i in range(n)],
        "none": [None] * n, "words": ["nan" if i % 3 else f"w{i}" for i in range(n)], "value": [rng.random() for _ in range(n)],
    }
    kinds = {c: "string" if c in ("words", "none") else "double" if isinstance(v[0], float) else "long" for c, v in data.items()}
    df = spark.createDataFrame(list(zip(*data.values())), ", ".join(f"{c} {k}" for c, k in kinds.items()))

    def facts(c):
        known = [v for v in data[c] if v is not None]
        whole = kinds[c] != "string" and known and int(max(known)) - int(min(known)) + 1 == len(known) == len(set(known))
        return known, len(set(known)) / len(known) if known else 0, whole

    ids = {mode: {r["column"]: r["is_id"] for r in columns.id_columns(df, mode).collect()} for mode in ("adaptive", "basic", "unsupervised")}
    for c in data:
        known, unique, whole = facts(c)
        named = c.endswith("_id")
        assert ids["adaptive"][c] == (named and unique > 0.95), c
        assert ids["basic"][c] == (named or unique == 1), c
        assert ids["unsupervised"][c] == ((named and unique > 0.95) or bool(whole)), c
    found = {r["column"]: r["verdict"] for r in columns.verdicts(df).collect()}
    assert found == {"row_id": "id", "near_id": "id", "holes_id": "id", "dull": "low_variance", "same": "constant", "none": "high_missing", "words": "high_missing"}
    assert columns.verdicts(df.limit(0)).collect() == []
    assert columns.verdicts(df.select("row_id", "same", "value")).collect() == []


def test_trials_that_cannot_win_are_stopped(spark, monkeypatch):
    """The search's result is that of one which fits every fold; folds of lost trials are not fitted."""
    df = table(spark, 120, 9).select("key", F.col("label"), "lot_width", "c").dropna()
    data = prepare.vectors(df, ["lot_width", "c"]).select("key", "features", "label")
    fits, true = [], models.estimator

    def counted(name, task, classes, params):
        fits.append(name)
        return true(name, task, classes, params)

    monkeypatch.setattr(models, "estimator", counted)
    names = ("decision_tree",)
    found = models.search(data, "key", "classification", names, trials=6, k=3, parallel=1)
    assert found.failures == [] and set(found.stopped) == set(names)
    assert len(fits) <= 6 * 3 + 1
    assert sum(found.stopped.values()) == 0 or len(fits) < 6 * 3 + 1
    row = found.results.head()
    scores = []
    for f in range(3):
        split = transforms.cut(models.rows.folds(data, "key", "label", 3, 42))
        model = true(found.best_name, "classification", 2, models.repaired(found.best_name, found.params, data.count())).fit(split.where(F.col("fold") != f))
        scores.append(models.evaluator("classification").evaluate(model.transform(split.where(F.col("fold") == f))))
    assert row["cv_score"] == pytest.approx(sum(scores) / 3)
