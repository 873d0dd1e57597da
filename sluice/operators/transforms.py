"""Fitted column transforms. Each is fitted on training rows to a few numbers or values, and applied as plain expressions.

A ``Fitted`` holds its state as JSON and turns a DataFrame into a DataFrame, so that transforms can be chained,
saved, and used on streams.
"""

from __future__ import annotations

import json
import unicodedata
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar
from ..session import cut, shared_dir
from . import profile

OTHER = "__OTHER__"
#: Values of a column that a fitted encoding keeps in its state.
LITERALS = 5000


@dataclass
class Fitted:
    """A fitted transform: its kind and state."""

    kind: str
    state: dict

    def transform(self, df: DataFrame) -> DataFrame:
        return _APPLY[self.kind](df, self.state)

    def to_json(self) -> str:
        return json.dumps({"kind": self.kind, "state": self.state})


@dataclass
class Chain:
    """Transforms in a row."""

    steps: list[Fitted]

    def transform(self, df: DataFrame) -> DataFrame:
        for s in self.steps:
            df = s.transform(df)
        return df

    def save(self, spark: SparkSession, path: str) -> None:
        """Writes the steps, and the tables that they use, into one folder."""
        rows = []
        for i, s in enumerate(self.steps):
            tables = {c: f"tables/{i}-{k}" for k, c in enumerate(s.state.get("tables", {}))}
            for c, name in tables.items():
                spark.read.parquet(s.state["tables"][c]).write.mode("overwrite").parquet(f"{path}/{name}")
            rows.append((i, Fitted(s.kind, s.state | ({"tables": tables} if tables else {})).to_json()))
        spark.createDataFrame(rows, "step int, fitted string").coalesce(1).write.mode("overwrite").json(f"{path}/steps")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Chain:
        steps = []
        for r in spark.read.schema("step int, fitted string").json(f"{path}/steps").orderBy("step").collect():
            s = Fitted(**json.loads(r["fitted"]))
            if s.state.get("tables"):
                s.state["tables"] = {c: f"{path}/{name}" for c, name in s.state["tables"].items()}
            steps.append(s)
        return cls(steps)


def _row(df: DataFrame, columns: Sequence[str], make) -> dict[str, dict]:  # noqa: ANN001
    return {r["column"]: {k: v for k, v in r.asDict().items() if k != "column"} for r in profile.per_column(df, columns, make).collect()} if columns else {}


def _double(name: str) -> Column:
    return F.col(f"`{name}`").cast("double")


# Imputation


def fit_impute(df: DataFrame, columns: Sequence[str], how: str | dict[str, str] = "median", constants: dict | None = None) -> Fitted:
    """mean, median, mode (the smallest of the most frequent) or constant, for all columns or each by name."""
    by = {c: how if isinstance(how, str) else how[c] for c in columns}
    values: dict = {c: (constants or {}).get(c) for c, h in by.items() if h == "constant"}
    numbers = [c for c, h in by.items() if h in ("mean", "median")]
    values |= {c: r["mean"] for c, r in _row(df, [c for c in numbers if by[c] == "mean"], lambda c: {"mean": F.avg(c.cast("double"))}).items()}
    values |= {c: q[0] for c, q in profile.quantiles(df, [c for c in numbers if by[c] == "median"], [0.5]).items()}
    modal = [c for c, h in by.items() if h == "mode"]
    if modal:
        best = Window.partitionBy("column").orderBy(F.desc("n"), "value")
        counts = profile.value_counts(df, modal).where("value is not null").withColumn("r", F.row_number().over(best)).where("r = 1")
        values |= {r["column"]: r["value"] for r in counts.collect()}
    return Fitted("impute", {"values": values})


def _impute(df: DataFrame, s: dict) -> DataFrame:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    fill = {}
    for c, v in s["values"].items():
        if v is not None and c in kinds:
            text = isinstance(kinds[c], (T.StringType, T.BooleanType))
            fill[c] = F.coalesce(F.col(f"`{c}`"), F.lit(v).cast(kinds[c])) if text else F.coalesce(_double(c), F.lit(float(v)))
    return df.withColumns(fill)


def fit_indicators(df: DataFrame, columns: Sequence[str]) -> Fitted:
    """A 0/1 column for each column that has nulls when fitted."""
    found = [r["column"] for r in profile.missing(df, columns).where("n_missing > 0").collect()]
    return Fitted("indicators", {"columns": [c for c in columns if c in found]})


def _indicators(df: DataFrame, s: dict) -> DataFrame:
    return df.withColumns({f"missingindicator_{c}": F.col(f"`{c}`").isNull().cast("int") for c in s["columns"]})


# Outliers, shape and scale


def fit_cap(df: DataFrame, columns: Sequence[str], k: float = 2.5) -> Fitted:
    return Fitted("cap", {"bounds": {c: list(b) for c, b in profile.bounds_dict(profile.outlier_bounds(df, columns, k, population=True)).items()}})


def _cap(df: DataFrame, s: dict) -> DataFrame:
    return df.withColumns({c: scalar.clip(_double(c), low, high) for c, (low, high) in s["bounds"].items()})


def fit_power(df: DataFrame, columns: Sequence[str]) -> Fitted:
    """Yeo-Johnson powers of greatest likelihood: a grid of powers is tried in one pass, three times over, each finer.

    The likelihood of a power follows from the variance of the transformed values and a sum of logarithms.
    """
    centre, width = {c: 1.0 for c in columns}, 4.0
    for _ in range(3):
        grid = {c: [round(centre[c] + width * (i / 10 - 1), 6) for i in range(21)] for c in columns}
        for lo in range(0, len(columns), 4):
            part = columns[lo : lo + 4]
            aggs = []
            for c in part:
                x = _double(c)
                aggs += [F.count(x).alias(f"n_{c}"), F.sum(F.signum(x) * F.log1p(F.abs(x))).alias(f"s_{c}")]
                aggs += [F.var_pop(scalar.yeo_johnson(x, p)).alias(f"v_{c}_{i}") for i, p in enumerate(grid[c])]
            r = df.agg(*aggs).head().asDict()
            for c in part:
                n, s = r[f"n_{c}"], r[f"s_{c}"]
                like = [(-n / 2 * np.log(v) + (p - 1) * s if (v := r[f"v_{c}_{i}"]) and np.isfinite(v) else -np.inf) for i, p in enumerate(grid[c])]
                centre[c] = grid[c][int(np.argmax(like))]
        width /= 10
    return Fitted("power", {"powers": centre})


def _power(df: DataFrame, s: dict) -> DataFrame:
    return df.withColumns({c: scalar.yeo_johnson(_double(c), p) for c, p in s["powers"].items()})


def fit_scale(df: DataFrame, columns: Sequence[str], how: str = "standard") -> Fitted:
    """standard (population deviation), minmax or robust (median and quartiles); a spread of 0 counts as 1."""

    def stats(c: Column) -> dict[str, Column]:
        c = c.cast("double")
        if how == "standard":
            return {"a": F.avg(c), "b": F.stddev_pop(c)}
        return {"a": F.min(c), "b": F.max(c) - F.min(c)}

    if how == "robust":
        rows = {c: {"a": q[1], "b": None if q[0] is None else q[2] - q[0]} for c, q in profile.quantiles(df, columns, [0.25, 0.5, 0.75]).items()}
    else:
        rows = _row(df, columns, stats)
    return Fitted("scale", {"scales": {c: [r["a"] or 0.0, r["b"] or 1.0] for c, r in rows.items()}})


def _scale(df: DataFrame, s: dict) -> DataFrame:
    return df.withColumns({c: (_double(c) - a) / b for c, (a, b) in s["scales"].items()})


# Categories


def fit_rare(df: DataFrame, columns: Sequence[str], share: float = 0.01) -> Fitted:
    """Values that are not frequent when fitted become one. The frequent ones are kept: at most 1 / share of them."""
    out: dict = {c: [] for c in columns}
    if columns:
        for r in profile.value_shares(df, columns).where(F.col("share") >= share).select("column", "value").collect():
            out[r["column"]].append(r["value"])
    return Fitted("rare", {"values": {c: sorted(v) for c, v in out.items()}})


def _rare(df: DataFrame, s: dict) -> DataFrame:
    return df.withColumns({c: F.when(F.col(f"`{c}`").isin(v) | F.col(f"`{c}`").isNull(), F.col(f"`{c}`")).otherwise(OTHER) for c, v in s["values"].items()})


def _categories(df: DataFrame, columns: Sequence[str]) -> dict[str, list]:
    """Sorted values of each column; numbers sort as numbers."""
    numbers = set(profile.numeric_columns(df))
    out: dict = {c: [] for c in columns}
    for r in profile.value_counts(df, columns).where("value is not null").select("column", "value").collect() if columns else []:
        out[r["column"]].append(r["value"])
    return {c: sorted(v, key=float) if c in numbers else sorted(v) for c, v in out.items()}


def fit_one_hot(df: DataFrame, columns: Sequence[str], drop_first: bool = False, most: int = 1000) -> Fitted:
    """A 0/1 column for each value (but the first, if asked); values unknown when fitted give zeros.

    Columns are bounded by what a table can have: more than ``most`` values are an error, for which there are codes.
    """
    sizes = profile.value_counts(df, columns).where("value is not null").groupBy("column").count().where(F.col("count") > most).collect() if columns else []
    if sizes:
        raise ValueError(f"too many values for 0/1 columns: {', '.join(sorted(r['column'] for r in sizes))}")
    return Fitted("one_hot", {"values": {c: v[int(drop_first) :] for c, v in _categories(df, columns).items()}})


def _one_hot(df: DataFrame, s: dict) -> DataFrame:
    new = {f"{c}_{v}": F.coalesce(F.col(f"`{c}`").cast("string") == v, F.lit(False)).cast("double") for c, values in s["values"].items() for v in values}
    return df.withColumns(new).drop(*s["values"])


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """value, code (from 0, sorted): the encoding dictionary as a table.

    Values are sorted by ranges; a code is the place within the range after all earlier ranges.
    """
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = values.repartitionByRange(parts, "value").sortWithinPartitions("value").select("value", F.monotonically_increasing_id().alias("m"))
    placed = cut(placed.select("value", F.shiftright("m", 33).alias("part"), F.col("m").bitwiseAND(F.lit((1 << 33) - 1)).alias("nth")))
    before, total = [], 0
    for part, n in sorted(map(tuple, placed.groupBy("part").count().collect())):  # a row for each range
        before += [F.lit(part), F.lit(total)]
        total += n
    if not before:
        return placed.select("value", F.col("nth").cast("int").alias("code"))
    return placed.select("value", (F.col("nth") + F.create_map(*before)[F.col("part")]).cast("int").alias("code"))


def fit_ordinal(df: DataFrame, columns: Sequence[str]) -> Fitted:
    """Codes from 0 in sorted order; -1 for null and for values unknown when fitted.

    Up to ``LITERALS`` values of a column are kept in the state; more are a table in the shared folder, which is
    joined.
    """
    if not columns:
        return Fitted("ordinal", {"values": {}, "tables": {}})
    sizes = {r["column"]: r["n"] for r in profile.value_counts(df, columns).where("value is not null").groupBy("column").agg(F.count("*").alias("n")).collect()}
    large = [c for c in columns if sizes.get(c, 0) > LITERALS]
    tables = {}
    for c in large:
        tables[c] = f"{shared_dir(df.sparkSession)}/codes-{uuid.uuid4().hex}"
        dictionary(df, c).select(F.col("value").cast("string").alias("value"), "code").write.parquet(tables[c])
    return Fitted("ordinal", {"values": _categories(df, [c for c in columns if c not in large]), "tables": tables})


def _ordinal(df: DataFrame, s: dict) -> DataFrame:
    new = {}
    for c, values in s["values"].items():
        codes = F.create_map(*[F.lit(x) for i, v in enumerate(values) for x in (v, float(i))]) if values else None
        new[c] = F.coalesce(F.try_element_at(codes, F.col(f"`{c}`").cast("string")), F.lit(-1.0)) if values else F.lit(-1.0)
    df = df.withColumns(new)
    for c, path in s.get("tables", {}).items():
        codes = df.sparkSession.read.schema("value string, code int").parquet(path).select(F.col("value").alias("_v"), F.col("code").cast("double").alias("_c"))
        joined = df.join(codes, F.col(f"`{c}`").cast("string") == F.col("_v"), "left")
        df = joined.select(*[F.coalesce("_c", F.lit(-1.0)).alias(x) if x == c else F.col(f"`{x}`") for x in df.columns])
    return df


def decode(df: DataFrame, code: str, fitted: Fitted, column: str) -> DataFrame:
    """``df`` with the value that a code of a fitted ordinal encoding stands for, in ``decoded``; null for other codes."""
    if column in fitted.state.get("tables", {}):
        codes = df.sparkSession.read.schema("value string, code int").parquet(fitted.state["tables"][column]).select(F.col("code").alias("_code"), F.col("value").alias("decoded"))
        return df.join(codes, F.col(code).cast("int") == F.col("_code"), "left").drop("_code")
    values = fitted.state["values"][column]
    if not values:
        return df.withColumn("decoded", F.lit(None).cast("string"))
    names = F.create_map(*[F.lit(x) for i, v in enumerate(values) for x in (i, v)])
    return df.withColumn("decoded", F.try_element_at(names, F.col(code).cast("int")))


def encoding_report(fitted: Fitted, spark: SparkSession) -> DataFrame:
    """column, code, value of a fitted encoding."""
    rows = [(c, i, v) for c, values in fitted.state["values"].items() for i, v in enumerate(values)]
    out = spark.createDataFrame(rows, "column string, code int, value string")
    for c, path in fitted.state.get("tables", {}).items():
        out = out.unionByName(spark.read.schema("value string, code int").parquet(path).withColumn("column", F.lit(c)))
    return out


# Dates


def fit_dates(df: DataFrame, columns: Sequence[str], family: str = "tree") -> Fitted:
    """What a family of models gets from each date: parts (tree), parts and the weekday's name (linear), or cycles (distance)."""

    def stats(c: Column) -> dict[str, Column]:
        times = F.hour(c) * 60 + F.minute(c)
        return {"year": F.min(F.year(c)), "start": F.min(F.unix_seconds(c.cast("timestamp"))), "times": F.min(times) != F.max(times), "days": F.min(c.cast("date")) != F.max(c.cast("date"))}

    return Fitted("dates", {"family": family, "columns": _row(df, columns, stats)})


def _dates(df: DataFrame, s: dict) -> DataFrame:
    new: dict[str, Column] = {}
    for name, r in s["columns"].items():
        c, p = F.col(f"`{name}`"), f"{name}_"
        if s["family"] == "tree":
            if r["days"]:
                new |= {p + "year": F.year(c), p + "month": F.month(c), p + "day": F.dayofmonth(c), p + "dayofweek": F.weekday(c), p + "quarter": F.quarter(c), p + "is_weekend": scalar.is_weekend(c)}
            if r["times"]:
                new |= {p + "hour": F.hour(c), p + "is_business_hours": scalar.business_hours(c)}
        elif s["family"] == "linear":
            if r["days"]:
                new |= {p + "years_since_min": F.year(c) - F.lit(r["year"]), p + "month": F.month(c), p + "day": F.dayofmonth(c), p + "weekday": F.date_format(c, "EEEE")}
            if r["times"]:
                new |= {p + "hour": F.hour(c)}
        else:
            if r["days"]:
                for part, value, period in (("month", F.month(c), 12), ("day", F.dayofmonth(c), 31), ("weekday", F.weekday(c), 7)):
                    new[p + part + "_sin"], new[p + part + "_cos"] = scalar.cyclic(value, period)
                new[p + "days_since_start"] = F.floor((F.unix_seconds(c.cast("timestamp")) - F.lit(r["start"])) / 86400)
            if r["times"]:
                new[p + "hour_sin"], new[p + "hour_cos"] = scalar.cyclic(F.hour(c), 24)
    return df.withColumns(new).drop(*s["columns"])


def date_target(df: DataFrame, column: str) -> DataFrame:
    """A date target as a number: seconds of the day if all rows have one day, seconds since 1970 otherwise."""
    c = F.col(column)
    one_day = df.agg((F.min(c.cast("date")) == F.max(c.cast("date"))).alias("x")).head()[0]
    return df.withColumn(column, scalar.seconds_of_day(c).cast("double") if one_day else scalar.unix_seconds(c))


# Choice of columns


def fit_variance(df: DataFrame, columns: Sequence[str], least: float = 0.01) -> Fitted:
    """Drops columns whose population variance is not above ``least``."""
    rows = _row(df, columns, lambda c: {"v": F.var_pop(c.cast("double"))})
    return Fitted("drop", {"columns": [c for c, r in rows.items() if not (r["v"] or 0) > least]})


def fit_drop(columns: Sequence[str]) -> Fitted:
    return Fitted("drop", {"columns": list(columns)})


def _drop(df: DataFrame, s: dict) -> DataFrame:
    return df.drop(*s["columns"])


# Texts

# English words that carry no topic.
STOP_WORDS = (
    "a about above after again all am an and any are as at be because been before being below between both but by can did do does doing down "
    "during each few for from further had has have having he her here hers him his how i if in into is it its itself just me more most my no "
    "nor not now of off on once only or other our ours out over own same she should so some such than that the their theirs them then there "
    "these they this those through to too under until up very was we were what when where which while who whom why will with you your yours"
)


def _accents() -> tuple[str, str]:
    """Letters with marks and what is left of them (by Unicode's decomposition), then the marks alone, which go."""
    marked, plain = [], []
    for code in range(0xC0, 0x2000):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code):
            marked.append(chr(code))
            plain.append(base)
    return "".join(marked) + "".join(map(chr, range(0x300, 0x370))), "".join(plain)


def terms(c: Column, stop_words: str = STOP_WORDS) -> Column:
    """Words of two and more letters or digits, lower-cased and without accents and stop words, and pairs of neighbours among them."""
    once = lambda value, make: F.get(F.transform(F.array(value), make), F.lit(0))  # noqa: E731  evaluates ``value`` one time
    words = F.filter(F.regexp_extract_all(F.lower(F.translate(c, *_accents())), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)), lambda w: ~w.isin(stop_words.split()))
    n = lambda w: F.greatest(F.size(w) - 1, F.lit(0))
    return once(words, lambda w: F.concat(w, F.zip_with(F.slice(w, F.lit(1), n(w)), F.slice(w, F.lit(2), n(w)), lambda a, b: F.concat_ws(" ", a, b))))


def term_counts(df: DataFrame, key: str, column: str) -> DataFrame:
    """key, term, tf: how often a row's text has each term."""
    return df.select(key, F.explode(terms(F.col(column))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def vocabulary(counts: DataFrame, n: int, least: int = 2, most: float = 0.95, features: int = 5000) -> DataFrame:
    """term, df, cf, idf of the most frequent terms of ``n`` rows, in ``least`` rows at least and a share ``most`` at most."""
    terms_ = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).where((F.col("df") >= least) & (F.col("df") <= most * n))
    return terms_.orderBy(F.desc("cf"), "term").limit(features).withColumn("idf", F.log((1.0 + n) / (1.0 + F.col("df"))) + 1)


def tfidf(df: DataFrame, key: str, column: str, least: int = 2, most: float = 0.95, features: int = 5000) -> DataFrame:
    """key, term, weight: tf * (ln((1 + n) / (1 + df)) + 1), of length 1 for each row, for the most frequent terms.

    ``features`` is the size of the vocabulary that is asked for. A row (also one with a null text) without a term of
    the vocabulary is the zero vector: it has no rows here. Terms are counted once and read from there.
    """
    counts = cut(term_counts(df, key, column))
    weighted = counts.join(F.broadcast(vocabulary(counts, df.count(), least, most, features)), "term").withColumn("w", F.col("tf") * F.col("idf"))  # ``features`` rows
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return weighted.select(key, "term", (F.col("w") / length).alias("weight"))


def fit_text(df: DataFrame, key: str, columns: Sequence[str], least: int = 2, most: float = 0.95, features: int = 5000) -> Fitted:
    """Each text column becomes a vector, ``<column>_tfidf``: the weights of ``tfidf`` with the terms and rarities of these rows.

    The vocabulary (``features`` terms at most) is a table; place ``at`` of the vector is its row ``at``. A null text,
    and one that has no term of the vocabulary, is the zero vector. A column without any term is dropped.
    """
    n, tables, sizes = df.count(), {}, {}
    for c in columns:
        words = vocabulary(term_counts(df, key, c), n, least, most, features).orderBy("term").select("term", "df", "idf")
        rows = [(i, *r) for i, r in enumerate(words.collect())]  # ``features`` rows
        tables[c], sizes[c] = f"{shared_dir(df.sparkSession)}/vocabulary-{uuid.uuid4().hex}", len(rows)
        df.sparkSession.createDataFrame(rows, _VOCABULARY).coalesce(1).write.parquet(tables[c])
    return Fitted("text", {"columns": list(columns), "sizes": sizes, "tables": tables})


_VOCABULARY = "at int, term string, df long, idf double"


def terms_of(fitted: Fitted, spark: SparkSession, column: str) -> DataFrame:
    """at, term, df, idf of a fitted text column."""
    return spark.read.schema(_VOCABULARY).parquet(fitted.state["tables"][column])


def _text(df: DataFrame, s: dict) -> DataFrame:
    from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
    from pyspark.ml.linalg import Vectors

    for c in s["columns"]:
        if not s["sizes"][c]:
            df = df.drop(c)
            continue
        words = df.sparkSession.read.schema(_VOCABULARY).parquet(s["tables"][c]).orderBy("at").collect()  # as many rows as the vocabulary has
        a, b, w = (f"_{x}_{c}" for x in ("terms", "counts", "weights"))
        df = df.withColumn(a, F.coalesce(terms(F.col(f"`{c}`").cast("string")), F.array().cast("array<string>")))
        df = CountVectorizerModel.from_vocabulary([r["term"] for r in words], a, b).transform(df)
        df = ElementwiseProduct(scalingVec=Vectors.dense([r["idf"] for r in words]), inputCol=b, outputCol=w).transform(df)
        df = Normalizer(inputCol=w, outputCol=f"{c}_tfidf").transform(df).drop(a, b, w, c)
    return df


# Features from others


def fit_derive(features: Sequence[tuple[str, str, str, str]]) -> Fitted:
    """(name, operation, first, second): the difference or the ratio (a divisor of 0 counts as 1) of two columns."""
    return Fitted("derive", {"features": [list(f) for f in features]})


def _derive(df: DataFrame, s: dict) -> DataFrame:
    make = {"difference": lambda a, b: a - b, "ratio": scalar.ratio}
    return df.withColumns({name: make[what](F.col(f"`{a}`"), F.col(f"`{b}`")) for name, what, a, b in s["features"]})


def fit_projection(df: DataFrame, columns: Sequence[str], variance: float = 0.95, most: int | None = None, centre: bool = True, output: str = "features") -> Fitted:
    """``columns`` become one array, ``output``: their first principal components, as many as hold ``variance`` and ``most`` at most.

    ``centre=False`` takes the singular directions of the uncentred columns. Nulls count as the mean (as 0, uncentred).
    Sums of products come from one pass in blocks of rows; what reaches the driver has a number for each pair of columns.
    """
    d = len(columns)

    def products(batches):  # noqa: ANN001, ANN202
        total, n = np.zeros((d + 1, d + 1)), 0
        for b in batches:
            x = np.column_stack([np.ones(len(b)), b.to_numpy(dtype=float, na_value=np.nan)]) if len(b) else np.zeros((0, d + 1))
            x[:, 1:] = np.where(np.isnan(x[:, 1:]), fill, x[:, 1:])
            x[:, 1:] -= shift
            total, n = total + x.T @ x, n + len(b)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["at", "x"])

    def blocks(batches):  # noqa: ANN001, ANN202
        return products(b.to_pandas() for b in batches)

    means = _row(df, columns, lambda c: {"m": F.avg(c.cast("double"))})
    mean = np.asarray([means[c]["m"] or 0.0 for c in columns])
    fill, shift = (mean, mean) if centre else (np.zeros(d), np.zeros(d))
    numbers = df.select(*[_double(c).alias(f"_{i}") for i, c in enumerate(columns)])
    sums = np.zeros((d + 1) ** 2)
    for at, x in numbers.mapInArrow(blocks, "at long, x double").groupBy("at").agg(F.sum("x")).collect():  # a row for each pair of columns
        sums[at] = x
    gram = sums.reshape(d + 1, d + 1)
    n = gram[0, 0]
    spread = gram[1:, 1:] - np.outer(gram[0, 1:], gram[0, 1:]) / n if n else gram[1:, 1:]
    values, directions = np.linalg.eigh(spread if centre else gram[1:, 1:])
    order = np.argsort(-values, kind="stable")
    directions = directions[:, order].T
    signs = np.sign(directions[np.arange(d), np.abs(directions).argmax(axis=1)])
    directions = directions * np.where(signs == 0, 1, signs)[:, None]
    held = np.asarray([v @ spread @ v for v in directions])
    shares = held / held.sum() if held.sum() > 0 else np.zeros(d)
    k = min(most or d, d, int(np.searchsorted(np.cumsum(shares), variance - 1e-12)) + 1)
    return Fitted("projection", {"columns": list(columns), "fill": fill.tolist(), "shift": shift.tolist(), "directions": directions[:k].tolist(), "shares": shares[:k].tolist(), "output": output})


def _projection(df: DataFrame, s: dict) -> DataFrame:
    values = F.array(*[F.coalesce(F.nanvl(_double(c), F.lit(f)), F.lit(f)) - F.lit(m) for c, f, m in zip(s["columns"], s["fill"], s["shift"])])
    lines = F.array(*[F.array(*[F.lit(float(x)) for x in line]) for line in s["directions"]])
    along = lambda v: F.transform(lines, lambda line: F.aggregate(F.zip_with(line, v, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b))
    new = F.get(F.transform(F.array(values), along), F.lit(0))  # the values are read once
    kept = [F.col(f"`{c}`") for c in df.columns if c not in s["columns"] and c != s["output"]]
    return df.select(*kept, new.alias(s["output"]))


def fit_vector(columns: Sequence[str], output: str = "features") -> Fitted:
    """The columns (numbers, vectors or arrays) as one vector, ``output``; nulls count as 0. The columns stay."""
    return Fitted("vector", {"columns": list(columns), "output": output})


def _vector(df: DataFrame, s: dict) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import VectorUDT

    kinds = {f.name: f.dataType for f in df.schema.fields}

    def ready(c: str) -> Column:
        if isinstance(kinds[c], VectorUDT):
            return F.col(f"`{c}`")
        if isinstance(kinds[c], T.ArrayType):
            return array_to_vector(F.col(f"`{c}`").cast("array<double>"))
        return F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0))

    filled = df.withColumns({f"_f{i}": ready(c) for i, c in enumerate(s["columns"])})
    return VectorAssembler(inputCols=[f"_f{i}" for i in range(len(s["columns"]))], outputCol=s["output"]).transform(filled).drop(*[f"_f{i}" for i in range(len(s["columns"]))])


# Imputation by neighbours

#: Donors that a worker holds; with more, new rows are compared with them block by block.
DONORS_HELD = 10_000


def fit_impute_neighbours(df: DataFrame, key: str, columns: Sequence[str], fill: Sequence[str] | None = None, k: int = 5, weights: str = "distance") -> Fitted:
    """Nulls of ``fill`` (all ``columns``, if not given) become means over the k nearest of these rows that know the value.

    Distances are over those ``columns`` that both rows know, scaled up for the others. The rows are kept as a table of
    donors; so are the means of the columns, for rows that share no known column with any donor.
    """
    means = _row(df, columns, lambda c: {"m": F.avg(c.cast("double"))})
    path = f"{shared_dir(df.sparkSession)}/donors-{uuid.uuid4().hex}"
    nid = F.col(f"`{key}`").cast("long") if isinstance(df.schema[key].dataType, T.IntegralType) else F.xxhash64(f"`{key}`")
    donors = df.select(nid.alias("nid"), F.array(*[_double(c) for c in columns]).alias("v"))
    donors.where(F.exists("v", lambda x: x.isNotNull())).write.parquet(path)
    state = {"columns": list(columns), "fill": list(fill or columns), "k": k, "weights": weights, "means": [means[c]["m"] for c in columns]}
    return Fitted("impute_neighbours", state | {"tables": {"donors": path}})


def _impute_neighbours(df: DataFrame, s: dict) -> DataFrame:
    from . import neighbours

    spark, names = df.sparkSession, s["columns"]
    donors = spark.read.schema("nid long, v array<double>").parquet(s["tables"]["donors"])
    v = F.array(*[_double(c) for c in names])
    at = {c: names.index(c) for c in s["fill"]}
    if df.isStreaming or donors.count() <= DONORS_HELD:
        held = donors.orderBy("nid").limit(DONORS_HELD + 1).collect()
        if len(held) > DONORS_HELD:
            raise ValueError(f"a stream can draw on {DONORS_HELD} donors at most")
        ids = np.asarray([r["nid"] for r in held], np.int64)
        y = np.asarray([r["v"] for r in held], float).reshape(len(held), len(names))

        @F.pandas_udf("array<double>")
        def filled(rows: pd.Series) -> pd.Series:
            x = np.asarray([np.asarray(r, float) for r in rows]).reshape(len(rows), len(names))
            return pd.Series(list(neighbours.filled(x, ids, y, s["k"], s["weights"])))

        (got,) = _free(df, "filled")
        out = df.withColumn(got, F.when(F.exists(v, lambda x: x.isNull()), filled(v)))
        return out.withColumns({c: F.coalesce(_double(c), F.nanvl(F.get(F.col(got), F.lit(i)), F.lit(None)), F.lit(s["means"][i])) for c, i in at.items()}).drop(got)
    row, got = _free(df, "row", "filled")
    numbered = cut(df.withColumn(row, F.monotonically_increasing_id()))
    found = neighbours.filled_from(numbered.select(F.col(row).alias("id"), v.alias("v")), donors, s["k"], s["weights"]).select(F.col("id").alias(row), F.col("v").alias(got))
    out = numbered.join(found, row, "left")
    return out.withColumns({c: F.coalesce(_double(c), F.get(F.col(got), F.lit(i)), F.lit(s["means"][i])) for c, i in at.items()}).select(df.columns)


def _free(df: DataFrame, *names: str) -> list[str]:
    taken = {c.lower() for c in df.columns}
    return [next(x for x in (f"{'_' * n}{name}" for n in range(1, len(taken) + 2)) if x.lower() not in taken) for name in names]


_APPLY = {
    "impute": _impute, "indicators": _indicators, "cap": _cap, "power": _power, "scale": _scale, "rare": _rare, "one_hot": _one_hot,
    "ordinal": _ordinal, "dates": _dates, "drop": _drop, "text": _text, "derive": _derive, "projection": _projection, "impute_neighbours": _impute_neighbours,
    "vector": _vector,
}
