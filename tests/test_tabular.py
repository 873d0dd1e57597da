"""The tabular operators on small frames: each branch, ties, nulls, empty tables, and the properties of splits and state."""

import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.functions import normalize, scalar
from sluice.operators import catalog, columns, correlate, metrics, neighbours, profile, quality, resample, rows, transforms
from sluice.plans import models, policy, prepare
from sluice.sources import readers
from sluice.streaming import scoring


def frame(spark, n=60):
    data = [(i, float(i % 7), None if i % 5 == 0 else float(i * 3 % 11), "abc"[i % 3], "yes" if i % 4 == 0 else "no") for i in range(n)]
    return spark.createDataFrame(data, "key long, a double, b double, c string, y string")


def one(df):
    return df.head().asDict()


def test_null_tokens_and_numbers(spark):
    df = spark.createDataFrame([(" N/A ", float("nan")), ("?", float("inf")), ("-1", 1.0), ("ok", None)], "s string, x double")
    got = [tuple(r) for r in normalize.normalise(df).collect()]
    assert got == [(None, None), (None, None), ("-1", 1.0), ("ok", None)]
    assert normalize.normalise(df, numeric_sentinels=True).where("s is null").count() == 3


@pytest.mark.parametrize("values, kind, first", [(["2,6", "1,5", None], "double", 2.6), (["18.00.00", "07.30.00"], "time", "18:00:00"), (["31-12-2024", "01-02-2024"], "timestamp", None), (["1", "2", "3", "4", "x"], "string", "1"), (["1", "2", "3", "4", "5", "x"], "double", 1.0)])
def test_types_are_found(spark, values, kind, first):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    out, kinds = normalize.infer_types(df)
    assert kinds == {"v": kind}
    if first is not None:
        assert out.head()[0] == first
    elif kind == "timestamp":
        assert [r[0] for r in out.select(F.month("v")).collect()] == [12, 2]


def test_outlier_bounds_without_spread(spark):
    df = spark.createDataFrame([(5.0,)] * 18 + [(100.0,), (-100.0,)], "x double")
    low, high = profile.bounds_dict(profile.outlier_bounds(df))["x"]
    assert low == pytest.approx(5.0 - 0.5 - 3 * np.std([5.0] * 18 + [100, -100], ddof=1), abs=1) and high > 50
    assert rows.drop_outliers(df, ["x"]).count() == 19


def test_moments_are_those_of_a_sample(spark):
    x = [1.0, 2.0, 2.0, 3.0, 10.0]
    r = one(profile.distribution(spark.createDataFrame([(v,) for v in x], "x double")))
    n, m = len(x), np.mean(x)
    g1 = np.mean((np.array(x) - m) ** 3) / np.std(x) ** 3
    assert r["skewness"] == pytest.approx(g1 * (n * (n - 1)) ** 0.5 / (n - 2)) and r["std"] == pytest.approx(np.std(x, ddof=1))


@pytest.mark.parametrize("name, is_id", [("id", True), ("x_id", True), ("id_x", True), ("width", False), ("identifier", True), ("valid", False)])
def test_id_names(name, is_id):
    assert profile.id_like(name) == is_id


def test_problem_columns_and_safety(spark):
    df = spark.createDataFrame([(i, 1, None if i % 10 else 1.0, i % 3, i % 4) for i in range(50)], "row_id long, k int, m double, p int, q int")
    assert {r["column"]: r["verdict"] for r in columns.verdicts(df).collect()} == {"row_id": "id", "k": "constant", "m": "high_missing"}
    assert columns.verdicts(df.select("row_id", "k", "p")).count() == 0


def test_low_variance_keeps_what_varies(spark):
    df = spark.createDataFrame([(1000.0 if i == 0 else 1.0, 1.1 if i == 0 else 1.0) for i in range(50)], "wild double, tame double")
    assert {r["column"]: r["is_low"] for r in columns.low_variance_columns(df).collect()} == {"wild": False, "tame": True}


@pytest.mark.parametrize("keep, ids", [("first", [1, 3]), ("last", [2, 3]), ("none", [3])])
def test_duplicates(spark, keep, ids):
    df = spark.createDataFrame([(1, None, "a"), (2, None, "a"), (3, 1, "a")], "k long, x int, s string")
    assert sorted(r["k"] for r in rows.drop_duplicates(df, ["x", "s"], "k", keep).collect()) == ids
    assert one(profile.duplicates(df, ["x", "s"]))["n_duplicates"] == 1


def test_split_is_a_stratified_partition(spark):
    df = frame(spark, 101)
    out = rows.train_test_split(df, "key", "y")
    assert out.count() == 101 and out.where("split = 'test'").count() == 21
    for y, n in df.groupBy("y").count().collect():
        assert abs(out.where((F.col("y") == y) & (F.col("split") == "test")).count() - 0.2 * n) <= 1
    assert rows.train_test_split(df, "key").where("split = 'test'").count() == 21
    assert rows.train_test_split(df.limit(0), "key").count() == 0
    sizes = [r["count"] for r in rows.folds(df, "key", "y").groupBy("y", "fold").count().collect()]
    assert len(sizes) == 10


def test_selected_columns(spark):
    df = frame(spark, 3)
    assert rows.select_columns(df, ["a"], "y").columns == ["a", "y"]
    for bad in ([], ["nope"]):
        with pytest.raises(ValueError):
            rows.select_columns(df, bad)


def test_scales(spark):
    df = frame(spark)
    out = transforms.fit_scale(df, ["a"], "standard").transform(df)
    r = one(out.agg(F.avg("a").alias("m"), F.stddev_pop("a").alias("s")))
    assert abs(r["m"]) < 1e-9 and abs(r["s"] - 1) < 1e-9
    flat = spark.createDataFrame([(3.0,)] * 4, "a double")
    for how in ("standard", "minmax", "robust"):
        assert {r[0] for r in transforms.fit_scale(flat, ["a"], how).transform(flat).collect()} == {0.0}


def test_power_is_of_greatest_likelihood(spark):
    x = np.exp(np.random.default_rng(0).standard_normal(400)) - 1
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    power = transforms.fit_power(df, ["x"]).state["powers"]["x"]

    def like(p):
        y = np.where(x >= 0, np.log1p(x) if p == 0 else ((np.abs(x) + 1) ** p - 1) / p, -(((1 - np.minimum(x, 0)) ** (2 - p)) - 1) / (2 - p))
        return -len(x) / 2 * np.log(y.var()) + (p - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()

    assert like(power) >= max(like(p) for p in np.linspace(-2, 1.9, 79)) - 1e-3


def test_encoders_and_unknown_values(spark):
    train, new = spark.createDataFrame([("b",), ("a",), (None,)], "c string"), spark.createDataFrame([("z",), ("a",), (None,)], "c string")
    assert [r[0] for r in transforms.fit_ordinal(train, ["c"]).transform(new).collect()] == [-1.0, 0.0, -1.0]
    assert [tuple(r) for r in transforms.fit_one_hot(train, ["c"]).transform(new).collect()] == [(0.0, 0.0), (1.0, 0.0), (0.0, 0.0)]
    assert transforms.fit_one_hot(train, ["c"], drop_first=True).transform(new).columns == ["c_b"]


def test_many_values_are_joined(spark, monkeypatch, tmp_path):
    df = spark.createDataFrame([(f"v{i % 50:02d}", i) for i in range(200)], "c string, k long")
    small = transforms.fit_ordinal(df, ["c"])
    monkeypatch.setattr(transforms, "LITERALS", 10)
    large = transforms.fit_ordinal(df, ["c"])
    new = df.union(spark.createDataFrame([("zz", 900), (None, 901)], df.schema))
    assert large.state["tables"] and sorted(map(tuple, large.transform(new).collect())) == sorted(map(tuple, small.transform(new).collect()))
    decoded = lambda f: sorted(map(tuple, transforms.decode(f.transform(new), "c", f, "c").select("k", "decoded").collect()))
    assert decoded(large) == decoded(small)
    assert sorted(map(tuple, transforms.encoding_report(large, spark).collect())) == sorted(map(tuple, transforms.encoding_report(small, spark).collect()))
    transforms.Chain([large]).save(spark, str(tmp_path / "chain"))
    shutil.rmtree(large.state["tables"]["c"].removeprefix("file:"))  # the shared folder is cleared
    again = transforms.Chain.load(spark, str(tmp_path / "chain"))
    assert sorted(map(tuple, again.transform(new).collect())) == sorted(map(tuple, small.transform(new).collect()))


def test_terms_without_accents(spark):
    df = spark.createDataFrame([(1, "The Café cafe naïve"), (2, "café NAIVE e\u0301t\u0301 zz"), (3, None)], "k long, t string")
    got = {(r["k"], r["term"]): r["weight"] for r in transforms.tfidf(df, "k", "t", least=1, most=1.0).collect()}
    assert {t for k, t in got if k == 1} == {"cafe", "naive", "cafe cafe", "cafe naive"} and (2, "cafe naive") in got and (2, "et") in got
    assert all(abs(sum(w * w for (k, _), w in got.items() if k == key) - 1) < 1e-9 for key in (1, 2))
    few = spark.createDataFrame([(f"v{i}",) for i in range(30)], "c string")
    with pytest.raises(ValueError):
        transforms.fit_one_hot(few, ["c"], most=20)


def test_chain_is_saved_and_loaded(spark, tmp_path):
    df = frame(spark)
    chain = transforms.Chain([transforms.fit_indicators(df, ["a", "b"]), transforms.fit_impute(df, ["b", "c"], {"b": "median", "c": "mode"}), transforms.fit_cap(df, ["b"]), transforms.fit_ordinal(df, ["c"])])
    chain.save(spark, str(tmp_path / "chain"))
    again = transforms.Chain.load(spark, str(tmp_path / "chain"))
    assert again.transform(df).collect() == chain.transform(df).collect() and "missingindicator_a" not in chain.transform(df).columns


def test_dates_by_family(spark):
    df = spark.sql("select * from values (timestamp_ntz'2024-01-01 10:00:00'), (timestamp_ntz'2024-02-03 20:30:00'), (null) t(ts)")
    tree = transforms.fit_dates(df, ["ts"], "tree").transform(df)
    assert tree.columns == ["ts_year", "ts_month", "ts_day", "ts_dayofweek", "ts_quarter", "ts_is_weekend", "ts_hour", "ts_is_business_hours"]
    assert [r["ts_is_weekend"] for r in tree.collect()] == [0, 1, None]
    assert "ts_weekday" in transforms.fit_dates(df, ["ts"], "linear").transform(df).columns
    assert "ts_hour_sin" in transforms.fit_dates(df, ["ts"], "distance").transform(df).columns


def test_correlated_groups_form_a_chain():
    assert correlate.groups([("a", "b"), ("b", "c"), ("x", "y")]) == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}


def test_related_names(spark):
    pairs = [("start_year", "end_year"), ("garage_area", "GarageCars"), ("lot_area", "lot_frontage"), ("bedroom", "rooms_above"), ("size_mean", "size_worst"), ("average", "garage"), ("a_x", "a_y")]
    got = [r["relation"] for r in correlate.relation_table(spark, pairs).collect()]
    assert got == ["temporal_difference", "area_per_unit", "area_ratio", "count_difference", "same_category", "none", "none"]


@pytest.mark.parametrize("family, left", [("tree", ["k", "r_mean", "r_worst", "z"]), ("linear", ["k", "r_mean", "z"]), ("distance", ["k", "r_mean", "z"])])
def test_reduction_by_family(spark, family, left):
    df = spark.createDataFrame([(i, float(i), i * 2.0 + 0.01 * (i % 2), float(i * i % 13)) for i in range(40)], "k long, r_mean double, r_worst double, z double")
    assert correlate.reduce_features(df, correlate.pair_report(df, ["r_mean", "r_worst", "z"]), family)[0].columns == left


def test_metrics_with_a_class_never_predicted(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1), (2, 0)], "label int, prediction int")
    assert metrics.confusion(df).count() == 9
    two = [r for r in metrics.per_class(df).collect() if r["class"] == 2][0]
    assert (two["precision"], two["recall"], two["f1"]) == (0.0, 0.0, 0.0)
    assert one(metrics.classification(df))["accuracy"] == pytest.approx(0.4)


def test_auc_counts_ties_half(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.1)], "label int, score double")
    assert one(metrics.auc(df))["auc"] == pytest.approx((0.5 + 1 + 0 + 1) / 4)
    assert max(r["tpr"] for r in metrics.roc(df).collect()) == 1.0


@pytest.mark.parametrize("train, cv, penalty, rejected", [(0.95, 0.7, 5, True), (0.9, 0.75, 3, False), (0.9, 0.86, 2, False)])
def test_overfit_penalty(spark, train, cv, penalty, rejected):
    r = one(metrics.generalization(spark.createDataFrame([("m", train, cv)], "model string, train_score double, cv_score double")))
    assert r["penalty"] == pytest.approx((train - cv) * penalty) and r["rejected"] == rejected


def test_all_rejected_falls_back_to_the_smallest_gap(spark):
    df = spark.createDataFrame([("a", 1.0, 0.5), ("b", 0.9, 0.6)], "model string, train_score double, cv_score double")
    assert metrics.ranked(df).where("rank = 1").head()["model"] == "b"


def points(spark, n=200):
    x = np.random.default_rng(3).standard_normal((n, 3))
    x[: n // 2] += 6
    return x, spark.createDataFrame([(i, [float(c) for c in v], int(i < n // 2)) for i, v in enumerate(x)], "id long, v array<double>, label int")


def test_neighbours_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    x, df = points(spark)
    got = {}
    for r in neighbours.knn(df, df, 4).collect():
        got.setdefault(r["id"], {})[r["rank"]] = r["nid"]
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        assert [got[i][k] for k in (1, 2, 3, 4)] == np.lexsort((np.arange(len(x)), d))[:4].tolist()
    near = neighbours.approximate_knn(df, 4)
    hits = near.join(neighbours.knn(df, df, 4).select("id", "nid"), ["id", "nid"]).count()
    assert hits / (4 * len(x)) > 0.95
    close = {(i, j) for i in range(len(x)) for j in range(len(x)) if i != j and ((x[i] - x[j]) ** 2).sum() <= 0.6}
    assert {(r["id"], r["nid"]) for r in neighbours.within(df, 0.6**0.5).collect()} == close


def test_approximate_neighbours_of_the_given_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    exact = neighbours.knn(rows, rows, 5).select("id", "nid")
    assert neighbours.approximate_knn(rows, 5).select("id", "nid").intersect(exact).count() / exact.count() >= 0.9


@pytest.mark.parametrize("few", [20_000, 5])
def test_quantiles_are_exact(spark, monkeypatch, few):
    monkeypatch.setattr(profile, "FEW", few)
    monkeypatch.setattr(profile, "ACCURACY", 50)
    rng = np.random.default_rng(few)
    x, y = np.round(rng.standard_normal(3000) ** 3, 2), rng.integers(0, 4, 3000).astype(float)
    data = [(float(a), None if i % 3 == 0 else float(b), None) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(data, "x double, y double, z double")
    probabilities = [0.0, 0.25, 0.5, 0.731, 0.95, 1.0]
    got = profile.quantiles(df, ["x", "y", "z"], probabilities)
    known = np.asarray([d[1] for d in data if d[1] is not None])
    assert got["x"] == pytest.approx(np.quantile(x, probabilities)) and got["y"] == pytest.approx(np.quantile(known, probabilities)) and got["z"] == [None] * 6
    assert profile.quantiles(df.limit(1), ["x"], [0.3])["x"] == [data[0][0]] and profile.quantiles(df, [], [0.5]) == {}
    assert profile.outliers(df, ["z"]).head()["n_outliers"] == 0 and profile.outliers(df, []).count() == 0


def test_clusters_votes_and_factors(spark):
    x, df = points(spark)
    clusters = neighbours.dbscan(df, 1.5, 4)
    sizes = sorted(r["n"] for r in metrics.cluster_sizes(clusters).where("cluster >= 0").collect())
    assert len(sizes) == 2 and sizes[0] > 70
    assert neighbours.vote(df.where("id % 5 = 0"), df.where("id % 5 <> 0")).join(df, "id").where("prediction <> label").count() == 0
    outlier = spark.createDataFrame([(999, [30.0, 30.0, 30.0], 0)], df.schema)
    assert neighbours.lof(df.union(outlier), 10).orderBy(F.desc("lof")).head()["id"] == 999
    assert neighbours.silhouette(df.withColumnRenamed("label", "cluster")).agg(F.avg("silhouette")).head()[0] > 0.6
    assert one(metrics.cluster_indices(df, "v", "label"))["davies_bouldin"] < 1


def test_impute_by_neighbours(spark):
    df = spark.createDataFrame([(1, 1.0, 10.0), (2, 1.1, None), (3, 1.2, 20.0), (4, 9.0, 90.0)], "k long, a double, b double")
    got = {r["k"]: r["b"] for r in neighbours.impute(df, "k", ["a", "b"], 2).collect()}
    assert got[2] == pytest.approx(15.0) and got[1] == 10.0


def test_rebalancing(spark):
    df = spark.createDataFrame([(i, int(i < 6)) for i in range(40)], "k long, y int")
    assert {r["y"]: r["count"] for r in resample.oversample(df, "y", "k").groupBy("y").count().collect()} == {0: 34, 1: 34}
    _, p = points(spark, 80)
    some = p.where("label = 0 or id < 12")
    made = resample.smote(some)
    assert {r["count"] for r in made.groupBy("label").count().collect()} == {40} and made.where("id is null").count() == 28
    assert resample.smote_tomek(some).count() <= 80
    assert resample.policy(df, "y")[0] == "smote" and resample.policy(df.where("k % 5 < 3 or y = 1"), "y")[0] == "smote_tomek"
    even = spark.createDataFrame([(i, i % 5) for i in range(50)], "k long, y int")
    assert one(profile.class_balance(even, "y"))["imbalanced"]  # a fifth each is below a quarter


def test_preparation_does_not_leak(spark):
    df = frame(spark, 120).withColumn("a", F.col("key") * 1.5)
    p = prepare.adaptive(df, "key", "y", family="linear")
    test = {r["key"] for r in p.test.select("key").collect()}
    changed = df.withColumn("b", F.when(F.col("key").isin(*test), F.col("b") * 3).otherwise(F.col("b")))
    q = prepare.adaptive(changed, "key", "y", family="linear")
    learned = lambda x: [(s.kind, {k: v for k, v in s.state.items() if k != "tables"}, {c: sorted(map(str, spark.read.parquet(t).collect())) for c, t in s.state.get("tables", {}).items()}) for s in x.chain.steps]
    assert learned(p) == learned(q)
    assert p.train.count() + p.test.count() == 120
    assert p.train.dropna().count() == p.train.count() and p.task == "classification"


def test_policies(spark):
    df = spark.createDataFrame([(None if i % 10 < 9 else 1.0, None if i % 10 < 6 else 1.0, float(i), "x" if i % 10 else None) for i in range(100)], "m double, h double, f double, s string")
    assert policy.as_dict(policy.imputation(df, ["m", "h", "f", "s"])) == {"m": "drop", "h": "constant", "f": "none", "s": "mode"}
    assert set(policy.as_dict(policy.scaling(df, ["f"], "tree")).values()) == {"none"} and policy.family_of("regression", "ridge") == "linear"


def test_search_score_and_stream(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i % 10), float(i % 3), "hi" if i % 10 > 4 else "lo") for i in range(200)], "key long, a double, b double, y string")
    p = prepare.fixed(df, "key", "y")
    train = prepare.vectors(p.train, p.features).withColumn("label", F.col("y").cast("double"))
    found = models.search(train, "key", "classification", ("logistic_regression", "decision_tree", "no_such_model")[:2], trials=1, k=2)
    assert found.results.where("rank = 1").head()["cv_score"] > 0.9
    scored = models.score(found.best, prepare.vectors(p.test, p.features), ["hi", "lo"])
    assert scored.where("predicted not in ('hi', 'lo')").count() == 0
    df.select("key", "a", "b").write.parquet(str(tmp_path / "in"))
    arriving = scoring.stream(spark, str(tmp_path / "in"), df.select("key", "a", "b")).withColumn("y", F.lit(None).cast("string"))
    scoring.score_stream(arriving, p.chain, found.best, p.features, str(tmp_path / "out"), str(tmp_path / "progress"), ["key", "prediction"]).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 200
    assert {r["check"] for r in models.stability(found.best, scored, 0.9, 0.9).collect()} >= {"gap", "predictions"}


def test_search_goes_on_after_failures(spark):
    df = spark.createDataFrame([(i, float(i % 10), int(i % 10 > 4)) for i in range(60)], "key long, a double, label int")
    found = models.search(prepare.vectors(df, ["a"]), "key", "regression", ("linear_svm", "decision_tree"), trials=9, k=2, give_up=3)
    assert found.best_name == "decision_tree" and [f[0] for f in found.failures] == ["linear_svm"] * 3
    assert models.repaired("logistic_regression", {"regParam": 0.0, "elasticNetParam": 1.0}, 10) == {"regParam": 0.0}
    assert models.repaired("decision_tree", {"minInstancesPerNode": 50}, 10) == {"minInstancesPerNode": 5}


def test_batches_move_the_centres(spark):
    x, df = points(spark)
    centres = models.minibatch_kmeans(df, 2)
    near = {r["id"]: r["prediction"] for r in models.nearest_centre(df, centres).collect()}
    assert len({near[i] for i in range(100)}) == 1 and near[0] != near[150]
    shares = prepare.truncated_svd(prepare.vectors(df.select("id", *[F.col("v")[i].alias(f"f{i}") for i in range(3)]), ["f0", "f1", "f2"]), 3)
    assert shares.orderBy(F.desc("component")).head()["cumulative"] == pytest.approx(1.0) and prepare.parsimony_score(shares, 3) == pytest.approx(0.9)
    split = metrics.split_silhouette(df.withColumn("c", F.col("label")), "c", "v").head()[0]
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    a = [d[i, (np.arange(200) < 100) == (i < 100)].sum() / 99 for i in range(200)]
    b = [d[i, (np.arange(200) < 100) != (i < 100)].mean() for i in range(200)]
    assert split == pytest.approx(np.mean([(q - p) / max(p, q) for p, q in zip(a, b)]))


def test_isolation_forest_and_boosting(spark):
    _, df = points(spark)
    far = spark.createDataFrame([(999, [40.0, -40.0, 40.0], 0)], df.schema)
    out = models.isolation_forest(df.union(far), trees=25, contamination=0.02)
    assert out.orderBy(F.desc("anomaly_score")).head()["id"] == 999
    data = prepare.vectors(df.select("id", *[F.col("v")[i].alias(f"f{i}") for i in range(3)], "label"), ["f0", "f1", "f2"])
    boosted = models.adaboost(data, rounds=3).transform(data)
    assert boosted.where("prediction <> label").count() == 0


def test_isolation_forest_scores_each_row_once(spark):
    """A forest and its rows' scores, read twice, take each row twice: as trees draw it, and as it is scored."""
    _, df = points(spark, 600)
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def counted(v):
        seen.add(1)
        return v

    out = models.isolation_forest(df.select("id", counted("v").alias("v")), trees=9, sample=64)
    got = {r["id"]: r["anomaly_score"] for r in out.collect()}
    assert out.where("anomaly_label = -1").count() == 60 and 0 < seen.value <= 1200
    forest = models.fit_isolation_forest(df, trees=9, sample=64)
    c = np.mean([models._average_path(s) for _, s in forest.trees])
    for i, v in df.select("id", "v").collect():
        total = 0.0
        for nodes, _ in forest.trees:
            at, depth = 0, 0
            while nodes[at, 0] >= 0:
                at, depth = int(nodes[at, 3 if v[int(nodes[at, 0])] >= nodes[at, 1] else 2]), depth + 1
            total += depth + models._average_path(nodes[at, 1])
        assert got[i] == 2 ** (-total / 9 / c)


@pytest.mark.parametrize("text, sep, header, shape", [("a;b\n1;2\n3;4\n", ";", True, (2, ["a", "b"])), ("1,2,x\n3,4,y\n", ",", False, (2, ["Column1", "Column2", "Column3"])), ("a\tb\n1\t?\n", "\t", True, (1, ["a"])), ("1 2  3\n4 5 6\n", r"\s+", False, (2, ["Column1", "Column2", "Column3"]))])
def test_files_are_read_as_they_are(spark, tmp_path, text, sep, header, shape):
    (tmp_path / "f.csv").write_text(text)
    lines = text.splitlines()
    assert readers.separator(lines) == sep and readers.has_header(lines, sep) == header
    df = readers.read_table(spark, str(tmp_path / "f.csv"))
    assert (df.count(), df.columns) == shape


def test_encoding_and_names(spark, tmp_path):
    (tmp_path / "l.csv").write_bytes("näme,wert\nä,1\n".encode("iso-8859-1"))
    assert readers.encoding(spark, str(tmp_path / "l.csv")) == "iso-8859-1"
    assert readers.read_table(spark, str(tmp_path / "l.csv")).columns == ["näme", "wert"]
    for charset in ("iso-8859-1", "utf-16"):
        (tmp_path / "w.txt").write_bytes("näme  wert\nä 1\nö  2\n".encode(charset))
        assert readers.encoding(spark, str(tmp_path / "w.txt")) == charset
        got = readers.read_table(spark, str(tmp_path / "w.txt"))
        assert got.columns == ["näme", "wert"] and sorted(map(tuple, got.collect())) == [("ä", "1"), ("ö", "2")]
    (tmp_path / "u.csv").write_bytes("a;wört\n1;é\n2;ü\n".encode("utf-16"))
    assert sorted(map(tuple, readers.read_table(spark, str(tmp_path / "u.csv")).collect())) == [("1", "é"), ("2", "ü")]
    df = spark.createDataFrame([(1, 2, None, 3)], "` a  b ` int, x int, `Unnamed: 2` int, X2 int").withColumnRenamed("X2", "x ")
    assert readers.clean_names(df).columns == ["a b", "x", "x_1"]


def test_scalar_expressions(spark):
    r = one(spark.range(1).select(scalar.squeeze(F.lit("  a   b ")).alias("s"), scalar.base_name(F.lit("Area_mean")).alias("b"), scalar.ratio(F.lit(3), F.lit(0)).alias("r"), scalar.clip(F.lit(None).cast("double"), 0.0, 1.0).alias("c"), scalar.yeo_johnson(F.lit(3.0), 0.0).alias("y")))
    assert r["s"] == "a b" and r["b"] == "area" and r["r"] == 3 and r["c"] is None and r["y"] == pytest.approx(np.log(4))


def test_quality_and_catalog(spark):
    df = frame(spark)
    assert one(quality.basic_score(df))["band"] in ("excellent", "good")
    assert 0 <= one(quality.full_score(df, ["a", "b"], ["c", "y"]))["score"] <= 100
    assert quality.recommendations(df.select("a"), ["a"], []).head()["category"] == "duplicates"
    assert quality.recommendations(df.select("key"), ["key"], []).head()["type"] == "success"
    checks = {r["check"]: r["passed"] for r in rows.output_checks(df.select("a", "b"), ["a", "b", "row_id"]).collect()}
    assert checks == {"numeric": True, "no_nulls": False, "finite": True, "width": False, "no_ids": False, "scaled": False}
    m, s = spark.createDataFrame([(1, "m", 7, 0.5), (2, "n", 9, 0.7)], "model_id int, name string, dataset_id int, score double"), spark.createDataFrame([(7, "set", True, 1)], "dataset_id int, name string, processed boolean, at int")
    assert sorted(r["dataset_name"] for r in catalog.with_dataset(m, s).collect()) == ["Unknown", "set"]
    assert one(catalog.dashboard(m, s))["best_model"] == "n" and catalog.find(m, {"model_id": 1}, exists={"name": True}).count() == 1


def test_entry_without_the_corpus_part(tmp_path):
    """The entry points import, and have their queries, where the corpus operators and the pipeline are gone."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "sluice"), tmp_path / "sluice", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), set(e.oracle_sql()) <= set(e.queries()), any(q.startswith('op') for q in e.queries()))"], cwd=tmp_path, env=env, capture_output=True, text=True)
    n, within, corpus = said.stdout.split()
    assert int(n) > 100 and within == "True" and corpus == "False", said.stderr


def test_histogram_bins_are_those_of_the_division(spark):
    """Values at and next to the borders of bins, where a quotient that is rounded otherwise gives another bin."""
    for low, high in ((0.1, 20.1), (0.01, 490.02), (0.0, 0.7), (0.03, 99.97)):
        width = (high - low) / 20
        borders = np.concatenate([low + np.arange(21) * width, low + (high - low) * np.arange(21) / 20])
        near = np.concatenate([borders, np.nextafter(borders, 1e9), np.nextafter(borders, -1e9)])
        values = [low, high, *near[(near >= low) & (near <= high)].tolist()]
        at = [min(int(np.floor((v - low) / width)) + 1, 20) for v in values]
        got = profile.histogram(spark.createDataFrame([(v,) for v in values], "x double"), "x", 20)
        assert {r["bin"]: r["n"] for r in got.collect()} == {b: at.count(b) for b in at}


def test_preparation_reads_its_input_a_few_times(spark):
    """What follows the removal of repeated rows starts from a stored table, not from the input."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    source = spark.range(0, 300, 1, 2).selectExpr("id AS k", "id % 50 + id / 1000 AS x", "id * id % 997 AS y", "date_add(DATE'2020-01-01', CAST(id % 400 AS INT)) AS d", "concat('c', id % 4) AS s", "IF(id % 3 = 0, 'a', 'b') AS t")
    df = source.mapInPandas(counted, source.schema)
    p = prepare.adaptive(df, "k", "t", family="linear")
    assert p.train.count() + p.test.count() == 300
    assert seen.value <= 7 * 300  # three kinds of columns, dominant values, their spread, texts, and the table itself
