"""Preparation of a table for models: decisions from profiles, fitted on training rows alone, applied to both splits."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import columns, correlate, profile, rows, transforms
from ..session import cut, stored
from . import policy


@dataclass
class Prepared:
    """Prepared splits, what was fitted, and the decisions in order (category, subject, decision)."""

    train: DataFrame
    test: DataFrame
    chain: transforms.Chain
    features: list[str]
    task: str
    family: str
    log: list[tuple[str, str, str]] = field(default_factory=list)

    def decisions(self) -> DataFrame:
        return self.train.sparkSession.createDataFrame([(i, *x) for i, x in enumerate(self.log)], "step int, category string, subject string, decision string")


def vectors(df: DataFrame, features: list[str], output: str = "features") -> DataFrame:
    """``df`` with the features as one vector; nulls count as 0. Features may be vectors or arrays themselves."""
    return transforms.fit_vector(features, output).transform(df)


def adaptive(df: DataFrame, key: str, target: str | None = None, model: str | None = None, family: str | None = None, ratio: float = 0.2, k: float = 2.5, outliers: str = "cap", seed: int = 42, text: bool = True) -> Prepared:
    """Decides per column, and fits on training rows.

    Steps: drop problem columns and repeated rows; split; per column impute (constant, mode, mean, median or by
    neighbours); cap or remove outliers (training rows only); features from dates; correlated pairs, with their
    differences and ratios; power transform of skewed columns (not for trees); scale; group rare values; encode;
    term weights of text columns (``text``; else they are dropped).
    """
    log: list[tuple[str, str, str]] = []
    task = columns.task_type(df, target)
    family = family or policy.family_of(task, model)
    log.append(("task", target or "-", f"{task}, {family}"))
    role = columns.roles(df.drop(key), target)
    prose = list(role.text) if text else []
    keep = [*role.numerical, *role.categorical, *role.datetime, *prose]
    for kind in ("ids", "constant", "high_missing", "low_variance", *["text"] * (not text)):
        log += [("columns", c, f"dropped: {kind}") for c in getattr(role, kind)]
    base = df.select(key, *keep, *[target] * bool(target))
    if target:
        base = base.where(F.col(target).isNotNull())
    # The table is read many times, a few columns each: what was expensive to make is stored, and read by columns.
    base = stored(rows.drop_duplicates(base, [*keep, *[target] * bool(target)], key))
    split = stored(rows.train_test_split(base, key, target if task == "classification" else None, ratio, seed))
    train, test = split.where("split = 'train'").drop("split"), split.where("split = 'test'").drop("split")
    steps: list[transforms.Fitted] = []

    def add(step: transforms.Fitted) -> None:
        nonlocal train
        steps.append(step)
        train = step.transform(train)

    named = [*role.numerical, *role.categorical]
    lacking = [r["column"] for r in profile.missing(train, named).where("n_missing > 0").collect()] if named else []
    how = dict.fromkeys(named, "none") | (policy.as_dict(policy.imputation(train, lacking)) if lacking else {})  # complete columns need no quartiles for that
    log += [("impute", c, h) for c, h in sorted(how.items()) if h != "none"]
    add(transforms.fit_indicators(train, [c for c in role.numerical if how.get(c) not in (None, "none", "drop")]))
    gone = [c for c, h in how.items() if h == "drop"]
    add(transforms.fit_drop(gone))
    numbers, texts = [c for c in role.numerical if c not in gone], [c for c in role.categorical if c not in gone]
    by_neighbours = [c for c in numbers if how.get(c) == "knn"]
    plain = {c: {"none": "median"}.get(how[c], how[c]) for c in numbers if c not in by_neighbours} | {c: {"none": "mode"}.get(how[c], how[c]) for c in texts}
    constants = {c: -999 for c in numbers} | {c: "MISSING" for c in texts}
    if by_neighbours:
        add(transforms.fit_impute_neighbours(train, key, numbers, by_neighbours))
    add(transforms.fit_impute(train, [*plain], plain, constants))
    if outliers == "remove" and numbers:
        train = rows.drop_outliers(train, numbers, k)
    elif outliers == "cap" and numbers and family != "tree":
        add(transforms.fit_cap(train, numbers, k))
    if role.datetime:
        add(transforms.fit_dates(train, role.datetime, family))
        new = [c for c in profile.numeric_columns(train) if any(c.startswith(f"{d}_") for d in role.datetime)]
        flat = [r["column"] for r in columns.low_variance_columns(train, new).collect() if r["is_low"]] if new else []
        add(transforms.fit_drop(flat))
        log += [("dates", c, family) for c in role.datetime]
        texts += [c for c in profile.text_columns(train) if any(c == f"{d}_weekday" for d in role.datetime)]
        train = stored(train)  # parts of dates are costly to take again
    if family != "tree" and len(numbers) > 1:
        actions = correlate.pair_actions(train.columns, correlate.pair_report(train, numbers), family, target)
        new = [(c, what, a, b) for what, c, a, b in actions if what != "drop"]
        dropped = [c for what, c, _, _ in actions if what == "drop"]
        add(transforms.fit_derive(new))
        add(transforms.fit_drop(dropped))
        numbers = [c for c in [*numbers, *[name for name, *_ in new]] if c not in dropped]
        log += [("correlation", c, what) for what, c, _, _ in actions]
    if family != "tree" and numbers:
        bent = [r["column"] for r in profile.skewed(train, numbers).collect()]
        if bent:
            add(transforms.fit_power(train, bent))
            log += [("power", c, "yeo-johnson") for c in bent]
        scales = policy.as_dict(policy.scaling(train, numbers, family))
        for kind in ("standard", "minmax", "robust"):
            if chosen := [c for c in numbers if scales[c] == kind]:
                add(transforms.fit_scale(train, chosen, kind))
                log += [("scale", c, kind) for c in chosen]
    if texts:
        add(transforms.fit_rare(train, texts))
        codes = policy.as_dict(policy.encoding(train, texts, family))
        log += [("encode", c, codes.get(c, "ordinal")) for c in texts]
        if hot := [c for c in texts if codes.get(c) == "one_hot"]:
            add(transforms.fit_one_hot(train, hot))
        if coded := [c for c in texts if codes.get(c) != "one_hot"]:
            add(transforms.fit_ordinal(train, coded))
    if prose:
        step = transforms.fit_text(train, key, prose)
        add(step)
        log += [("text", c, f"{step.state['sizes'][c]} terms") for c in prose]
    if target and task == "classification":
        add(transforms.fit_ordinal(train, [target]))
    elif target and not isinstance(df.schema[target].dataType, transforms.T.NumericType):
        train, test = transforms.date_target(train, target), transforms.date_target(test, target)
    chain = transforms.Chain(steps)
    features = [c for c in train.columns if c not in (key, target)]
    return Prepared(train, chain.transform(test), chain, features, task, family, log)


def fixed(df: DataFrame, key: str, target: str, impute: str = "mean", encode: str = "one_hot", scale: str = "standard", outliers: str | None = None, ratio: float = 0.2, drop_first: bool = False) -> Prepared:
    """One chosen way for all columns: impute (mean, median or knn), encode (one_hot, with codes for columns of very many values, or ordinal), scale, outliers (clip or remove)."""
    task = columns.task_type(df, target)
    numbers = [c for c in profile.numeric_columns(df) if c not in (key, target)]
    texts = [c for c in profile.text_columns(df) if c not in (key, target)]
    split = rows.train_test_split(df.select(key, *numbers, *texts, target), key, target if task == "classification" else None, ratio)
    train, test = split.where("split = 'train'").drop("split"), split.where("split = 'test'").drop("split")
    steps: list[transforms.Fitted] = []
    if outliers == "remove":
        train = rows.drop_outliers_in_turn(train, numbers)
    coded = _many_values(train, texts) if encode == "one_hot" else texts
    todo = [
        lambda d: transforms.fit_impute_neighbours(d, key, numbers, weights="uniform") if impute == "knn" and numbers else transforms.fit_drop([]),
        lambda d: transforms.fit_cap(d, numbers, 1.5) if outliers == "clip" else transforms.fit_drop([]),
        lambda d: transforms.fit_impute(d, [*(numbers if impute != "knn" else []), *texts], {**{c: impute for c in numbers}, **{c: "mode" for c in texts}}),
        lambda d: transforms.fit_scale(d, numbers, scale),
        lambda d: transforms.fit_ordinal(d, coded),
        lambda d: transforms.fit_one_hot(d, [c for c in texts if c not in coded], drop_first),
        lambda d: transforms.fit_ordinal(d, [target]) if task == "classification" else transforms.fit_drop([]),
    ]
    for make in todo:
        step = make(train)
        steps.append(step)
        train = step.transform(train)
    chain = transforms.Chain(steps)
    return Prepared(train, chain.transform(test), chain, [c for c in train.columns if c not in (key, target)], task, policy.family_of(task))


def _many_values(df: DataFrame, names: list[str], most: int = 1000) -> list[str]:
    """Columns with more values than a table should have 0/1 columns for."""
    if not names:
        return []
    sizes = profile.value_counts(df, names).where("value is not null").groupBy("column").count()
    return [r["column"] for r in sizes.where(F.col("count") > most).collect()]


def unsupervised(df: DataFrame, key: str, most_values: int = 15, most_features: int = 50, variance: float = 0.95, ratio: float = 0.0) -> Prepared:
    """Fitted on all rows but a share ``ratio``, the test split. Median and robust scaling; few values as 0/1 columns without the first, many as codes scaled to 0..1; flat
    columns go; above ``most_features`` features, the principal components that hold ``variance``."""
    drop = {r["column"] for r in columns.id_columns(df.drop(key), "unsupervised").where("is_id").collect()} | {r["column"] for r in columns.constant_columns(df.drop(key)).where("is_constant").collect()} | {r["column"] for r in columns.missing_columns(df.drop(key)).where("is_high").collect()}
    base = df.drop(*drop)
    low = {r["column"] for r in columns.binary_or_low(base.drop(key)).where("is_low_integer").collect()} if profile.numeric_columns(base.drop(key)) else set()
    numbers = [c for c in profile.numeric_columns(base) if c != key and c not in low]
    texts = [*[c for c in profile.text_columns(base) if c != key], *sorted(low)]
    base = base.select(key, *numbers, *[F.col(c).cast("string").alias(c) for c in texts])
    n = {r["column"]: r["n_distinct"] for r in columns.constant_columns(base, texts).collect()} if texts else {}
    hot, coded = [c for c in texts if n[c] <= most_values], [c for c in texts if n[c] > most_values]
    steps: list[transforms.Fitted] = []
    train, test = base, base.limit(0)
    if ratio:
        split = cut(rows.train_test_split(base, key, None, ratio))
        train, test = split.where("split = 'train'").drop("split"), split.where("split = 'test'").drop("split")
    shape = [r["column"] for r in profile.skewed(train, numbers, 1.0).collect()] if numbers else []
    todo = [
        lambda d: transforms.fit_impute(d, [*numbers, *texts], {**{c: "median" for c in numbers}, **{c: "mode" for c in texts}}),
        lambda d: transforms.fit_power(d, shape) if shape else transforms.fit_drop([]),
        lambda d: transforms.fit_scale(d, numbers, "robust"),
        lambda d: transforms.fit_one_hot(d, hot, drop_first=True),
        lambda d: transforms.fit_ordinal(d, coded),
        lambda d: transforms.fit_scale(d, coded, "minmax"),
        lambda d: transforms.fit_variance(d, [c for c in d.columns if c != key]),
    ]
    for make in todo:
        step = make(train)
        steps.append(step)
        train = step.transform(train)
    features = [c for c in train.columns if c != key]
    if len(features) > most_features:
        step = transforms.fit_projection(train, features, variance)
        steps.append(step)
        train, features = step.transform(train), ["features"]
    chain = transforms.Chain(steps)
    return Prepared(train, chain.transform(test), chain, features, "unsupervised", "distance")


def centred(df: DataFrame, column: str = "features") -> DataFrame:
    """``df`` with the vectors of ``column`` shifted to mean 0."""
    from pyspark.ml.feature import StandardScaler

    model = StandardScaler(inputCol=column, outputCol="_centred", withMean=True, withStd=False).fit(df)
    return model.transform(df).drop(column).withColumnRenamed("_centred", column)


def components(df: DataFrame, variance: float = 0.95, most: int | None = None) -> DataFrame:
    """``df`` with ``pca``: as many principal components of ``features`` as hold that share of the variance."""
    dim = df.select(F.size(vector_to_array("features"))).head()[0]
    base = centred(df)
    model = PCA(k=min(most or dim, dim), inputCol="features", outputCol="_pca").fit(base)
    total, k = 0.0, 0
    for share in model.explainedVariance.toArray():
        total, k = total + share, k + 1
        if total >= variance:
            break
    return model.transform(base).withColumn("pca", array_to_vector(F.slice(vector_to_array("_pca"), 1, k))).drop("_pca")


def explained_variance(df: DataFrame, k: int) -> DataFrame:
    """component, share, cumulative of the first k principal components of ``features``."""
    model = PCA(k=k, inputCol="features", outputCol="_pca").fit(centred(df))
    shares = [float(x) for x in model.explainedVariance.toArray()]
    rows_ = [(i + 1, s, sum(shares[: i + 1])) for i, s in enumerate(shares)]
    return df.sparkSession.createDataFrame(rows_, "component int, share double, cumulative double")


def truncated_svd(df: DataFrame, k: int) -> DataFrame:
    """component, share, cumulative: variance that the first k singular directions of the uncentred ``features`` hold."""
    v = df.select(vector_to_array("features").alias("v"))
    dim = v.select(F.size("v")).head()[0]
    names = [f"f{i}" for i in range(dim)]
    step = transforms.fit_projection(v.select(*[F.get("v", F.lit(i)).alias(n) for i, n in enumerate(names)]), names, variance=2.0, most=k, centre=False)
    shares = step.state["shares"]
    table = [(j + 1, float(s), float(sum(shares[: j + 1]))) for j, s in enumerate(shares)]
    return df.sparkSession.createDataFrame(table, "component int, share double, cumulative double")


def parsimony_score(shares: DataFrame, dimension: int) -> float:
    """Variance held, less a tenth for using all dimensions."""
    one = shares.agg(F.max("cumulative"), F.count("*")).head()
    return one[0] * (1 - one[1] / dimension * 0.1)
