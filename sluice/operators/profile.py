"""Column profiles: a long table, with a row per column (or pair, or value), from few passes over the data.

Aggregates that need no distinct values come from one ``agg`` over all columns; distinct counts, modes and top
values come from one ``groupBy(column, value)`` over the unpivoted table, which needs no expansion for each
column. Results of fitted size (rows for each column) are the only data that reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut

#: Columns in one aggregate; more are done in several, so that generated code stays small.
BATCH = 40
#: Accuracy of the approximate passes of ``quantiles``, values of a bracket for the driver, and parts of a narrowing step.
ACCURACY, FEW, STEPS = 10_000, 20_000, 64


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BooleanType))]


def per_column(df: DataFrame, columns: Sequence[str], make) -> DataFrame:  # noqa: ANN001
    """A row per column of aggregates: ``make(column) -> {name: aggregate}``."""
    out = None
    for lo in range(0, len(columns), BATCH):
        structs = [F.struct(F.lit(c).alias("column"), *[v.alias(k) for k, v in make(F.col(f"`{c}`")).items()]) for c in columns[lo : lo + BATCH]]
        part = df.agg(F.array(*structs).alias("a")).select(F.inline("a"))
        out = part if out is None else out.unionByName(part)
    if out is None:  # no columns, no rows
        none = F.lit(None).cast("double")
        one = F.struct(F.lit("").alias("column"), *[v.alias(k) for k, v in make(none).items()])
        return df.agg(F.array(one).alias("a")).select(F.inline("a")).where(F.lit(False))
    return out


def _ranks(n: int, p: float) -> tuple[int, int, float]:
    """The two places (from 0) between which a percentile of n values lies, and how far it is from the first."""
    at = p * (n - 1)
    return int(at), min(n - 1, int(at) + 1), at - int(at)


def quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> dict[str, list[float | None]]:
    """Exact percentiles (with linear interpolation) of each column, in order; nulls do not count.

    An approximate pass puts a bracket around each; another counts the rows below the bracket and the values in it.
    Where a bracket holds many values, each of the two ranks that make a percentile is narrowed down on its own, as
    they may lie on both sides of a gap: approximate percentiles of the bracket's different values cut it into parts of
    about as many values, and only the part with the rank stays. No task holds the values of a column, and the driver
    gets at most ``FEW`` values of a bracket. Infinities and NaN (which comes last) are counted apart.
    """
    names = list(columns)
    if not names:
        return {}
    number = {c: F.col(f"`{c}`").cast("double") for c in names}
    infinite = float("inf")
    finite = lambda c: F.when((c > -infinite) & (c < infinite), c)  # noqa: E731  NaN is above infinity

    def facts(c: Column) -> dict[str, Column]:
        x = c.cast("double")
        return {"n": F.count(x), "low": F.count_if(x == -infinite), "high": F.count_if(x == infinite), "nan": F.count_if(F.isnan(x)), "lo": F.min(finite(x)), "hi": F.max(finite(x))}

    ends = {r["column"]: r for r in per_column(df, names, facts).collect()}
    inner = {c: r["n"] - r["low"] - r["high"] - r["nan"] for c, r in ends.items()}
    live = [c for c in names if inner[c]]
    slack = {c: 2 / ACCURACY + 3 / inner[c] for c in live}
    double = {c: finite(number[c]) for c in names}

    def ranks(c: str, p: float) -> tuple[int, int, float]:
        """The ranks of ``p`` among the finite values: below 0 and from their number on, they lie outside."""
        first, second, far = _ranks(ends[c]["n"], p)
        return first - ends[c]["low"], second - ends[c]["low"], far

    asked = {}  # of finite values: (column, place among the probabilities) -> share of the finite values
    for c in live:
        for k, p in enumerate(probabilities):
            wanted = [r for r in ranks(c, p)[:2] if 0 <= r < inner[c]]
            if wanted:
                asked[c, k] = [r / max(1, inner[c] - 1) for r in (wanted[0], wanted[-1])]
    near = {}
    for lo in range(0, len(live), BATCH):
        part = [c for c in live[lo : lo + BATCH] if any(a == c for a, _ in asked)]
        shares = {c: [min(1.0, max(0.0, s)) for (a, _), (x, y) in asked.items() if a == c for s in (x - slack[c], y + slack[c])] for c in part}
        if part:
            got = df.agg(*[F.percentile_approx(double[c], shares[c], ACCURACY).alias(f"q{i}") for i, c in enumerate(part)]).head()
            near |= {c: iter(got[f"q{i}"]) for i, c in enumerate(part)}
    brackets = []  # (column, place, lowest, highest)
    for (c, k), (x, y) in asked.items():
        lowest, highest = next(near[c]), next(near[c])
        brackets.append((c, k, lowest if x > slack[c] else ends[c]["lo"], highest if y < 1 - slack[c] else ends[c]["hi"]))
    values = _at_ranks(df, double, brackets, [ranks(c, probabilities[k])[:2] for c, k, _, _ in brackets]) if brackets else []
    inside = {(c, k): v for (c, k, _, _), v in zip(brackets, values)}
    out: dict[str, list[float | None]] = {c: [] for c in names}
    for c in names:
        for k, p in enumerate(probabilities):
            if not ends[c]["n"]:
                out[c].append(None)
                continue
            first, second, far = ranks(c, p)
            a, b = (-infinite if r < 0 else inside[c, k][i] if r < inner[c] else infinite if r < inner[c] + ends[c]["high"] else float("nan") for i, r in enumerate((first, second)))
            out[c].append(a if a == b or not far else a + (b - a) * far)
    return out


def _at_ranks(df: DataFrame, double: dict[str, Column], brackets: list[tuple[str, int, float, float]], ranks: list[tuple[int, int]]) -> list[tuple[float | None, float | None]]:
    """For each bracket (column, -, lowest, highest), the values of two ranks that lie in it."""
    below: dict[int, int] = {}
    for start in range(0, len(brackets), BATCH):
        part = df.agg(*[F.count_if(double[c] < F.lit(lo)) for c, _, lo, _ in brackets[start : start + BATCH]]).head()
        below |= {start + i: n for i, n in enumerate(part)}
    inside = [double[c].between(F.lit(lo), F.lit(hi)) for c, _, lo, hi in brackets]
    marks = [F.when(held, F.struct(F.lit(i).alias("b"), double[c].alias("x"))) for i, (held, (c, *_)) in enumerate(zip(inside, brackets))]
    counts = df.where(reduce(lambda a, b: a | b, inside)).select(F.explode(F.filter(F.array(*marks), lambda m: m.isNotNull())).alias("m"))
    counts = cut(counts.groupBy("m.b", "m.x").agg(F.count("*").alias("n")))  # few rows lie in the brackets
    sizes = {r["b"]: r["v"] for r in counts.groupBy("b").agg(F.count("*").alias("v")).collect()}
    wide = [b for b, v in sizes.items() if v > FEW]
    few = counts.where(~F.col("b").isin(wide)) if wide else counts
    lists: dict[int, list[tuple[float, int]]] = {}  # of each rank (2 * bracket, and one more for the second): its values and their counts
    for b, x, n in _sorted_rows(few):
        for r in (2 * b, 2 * b + 1):
            lists.setdefault(r, []).append((x, n))
    under = {2 * b + i: n for b, n in below.items() for i in (0, 1)}
    rest = counts.where(F.col("b").isin(wide)).select(F.explode(F.array(2 * F.col("b"), 2 * F.col("b") + 1)).alias("b"), "x", "n") if wide else None
    while rest is not None:
        parts = {r["b"]: sorted(set(r["m"])) for r in rest.groupBy("b").agg(F.percentile_approx("x", [i / STEPS for i in range(1, STEPS)], ACCURACY).alias("m")).collect()}
        edges = F.create_map(*[v for r, m in parts.items() for v in (F.lit(r), F.array(*[F.lit(x) for x in m]))])[F.col("b")]
        steps = rest.groupBy("b", F.size(F.filter(edges, lambda m: m < F.col("x"))).alias("s")).agg(F.count("*").alias("v"), F.sum("n").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()  # STEPS rows a rank
        keep, done = [], []
        for r in parts:
            seen, mine = under.get(r, 0), sorted((t for t in steps if t["b"] == r), key=lambda t: t["s"])
            for step in mine:
                if seen + step["n"] > ranks[r // 2][r % 2]:
                    under[r] = seen
                    (keep if step["v"] > FEW and len(mine) > 1 else done).append((r, step["lo"], step["hi"]))  # a single part narrows no further
                    break
                seen += step["n"]
        within = lambda some: reduce(lambda a, b: a | b, [(F.col("b") == r) & F.col("x").between(lo, hi) for r, lo, hi in some])
        if done:
            for r, x, n in _sorted_rows(rest.where(within(done))):
                lists.setdefault(r, []).append((x, n))
        rest = cut(rest.where(within(keep))) if keep else None

    def value(r: int) -> float | None:
        seen = under.get(r, 0)
        for x, n in lists.get(r, []):
            seen += n
            if seen > ranks[r // 2][r % 2]:
                return x
        return None  # a rank outside of the finite values

    return [(value(2 * b), value(2 * b + 1)) for b in range(len(brackets))]


def _sorted_rows(counts: DataFrame) -> list[tuple[int, float, int]]:
    table = counts.select("b", "x", "n").orderBy("b", "x").toArrow()
    return list(zip(*(table.column(c).to_pylist() for c in ("b", "x", "n"))))


def _named(values: dict[str, list[float | None]], at: int) -> Column:
    """A fitted number of each column, by the column's name."""
    pairs = [F.lit(x) for c, v in values.items() for x in (c, float("nan") if v[at] is None else float(v[at]))]
    return F.nanvl(F.create_map(*pairs)[F.col("column")], F.lit(None).cast("double")) if pairs else F.lit(None).cast("double")


def column_kinds(df: DataFrame) -> DataFrame:
    """A row per column: its type and kind. Needs no data."""
    kind = {**dict.fromkeys(numeric_columns(df), "numeric"), **dict.fromkeys(text_columns(df), "categorical")}
    rows = [(f.name, f.dataType.simpleString(), kind.get(f.name, "datetime" if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)) else "other")) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "column string, type string, kind string")


def basic_info(df: DataFrame) -> DataFrame:
    """One row: rows, columns and columns of each kind."""
    kinds = [r["kind"] for r in column_kinds(df).collect()]
    count = lambda k: F.lit(sum(x == k for x in kinds)).cast("long")
    return df.agg(F.count("*").alias("n_rows")).select("n_rows", F.lit(len(kinds)).cast("long").alias("n_columns"), *[count(k).alias(f"n_{k}") for k in ("numeric", "categorical", "datetime")])


def missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, n_missing, pct_missing (2 digits)."""
    rows = per_column(df, columns or df.columns, lambda c: {"n_missing": F.count_if(c.isNull()), "share": F.avg(c.isNull().cast("double"))})
    return rows.select("column", "n_missing", F.round(F.col("share") * 100, 2).alias("pct_missing"))


def missing_total(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: missing cells, their percentage of all cells, and columns with any."""
    names = columns or df.columns
    rows = per_column(df, names, lambda c: {"n": F.count_if(c.isNull()), "rows": F.count("*")})
    return rows.agg(F.sum("n").alias("n_missing"), F.round(F.coalesce(F.try_divide(F.sum("n") * 100.0, F.sum("rows")), F.lit(0.0)), 2).alias("pct_cells"), F.count_if(F.col("n") > 0).alias("n_columns"))


def moments(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Moments of numeric columns; skewness and excess kurtosis corrected for bias, as samples."""

    def stats(c: Column) -> dict[str, Column]:
        c = c.cast("double")
        return {"n": F.count(c), "mean": F.avg(c), "std": F.stddev_samp(c), "min": F.min(c), "max": F.max(c), "g1": F.skewness(c), "g2": F.kurtosis(c)}

    rows = per_column(df, numeric_columns(df) if columns is None else columns, stats)
    n = F.col("n").cast("double")
    skew = F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6))
    return rows.select("column", "n", "mean", "std", "min", "max", skew.alias("skewness"), kurt.alias("kurtosis"))


def distribution(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Moments and exact quartiles of numeric columns."""
    names = numeric_columns(df) if columns is None else list(columns)
    q = quantiles(df, names, [0.25, 0.5, 0.75])
    return moments(df, names).select("column", "n", "mean", "std", "min", "max", *[_named(q, i).alias(k) for i, k in enumerate(("q25", "median", "q75"))], "skewness", "kurtosis")


def skewed(df: DataFrame, columns: Sequence[str] | None = None, limit: float = 0.75) -> DataFrame:
    """Skewed columns, what their values allow, and the power transform to use."""
    names = columns or numeric_columns(df)
    shape = moments(df, names).where(F.abs("skewness") > limit).select("column", "skewness", "min", "max")
    signs = per_column(df, names, lambda c: {"has_zero": F.coalesce(F.bool_or(c == 0), F.lit(False)), "has_negative": F.coalesce(F.bool_or(c < 0), F.lit(False))})
    return shape.join(F.broadcast(signs), "column").withColumn("method", F.when(F.col("min") > 0, "box-cox").otherwise("yeo-johnson"))  # a row for each column


def outlier_bounds(df: DataFrame, columns: Sequence[str] | None = None, k: float = 2.5, population: bool = False) -> DataFrame:
    """column, low, high: quartiles -+ k interquartile ranges; mean -+ 3 standard deviations where the range is 0."""

    names = numeric_columns(df) if columns is None else list(columns)
    q = quantiles(df, names, [0.25, 0.75])
    q1, q3 = _named(q, 0), _named(q, 1)
    rows = per_column(df, names, lambda c: {"mean": F.avg(c.cast("double")), "std": (F.stddev_pop if population else F.stddev_samp)(c.cast("double"))})
    flat = q3 - q1 < 1e-10
    low = F.when(flat, F.col("mean") - 3 * F.col("std")).otherwise(q1 - k * (q3 - q1))
    high = F.when(flat, F.col("mean") + 3 * F.col("std")).otherwise(q3 + k * (q3 - q1))
    return rows.select("column", low.alias("low"), high.alias("high"))


def bounds_dict(bounds: DataFrame) -> dict[str, tuple[float, float]]:
    """Bounds as numbers for the driver: a row for each column."""
    return {r["column"]: (r["low"], r["high"]) for r in bounds.collect() if r["low"] is not None}


def is_outlier(c: Column, low: float, high: float) -> Column:
    return (c < low) | (c > high)


def id_like(name: str, substring: bool = False) -> bool:
    low = name.lower()
    return "id" in low if substring else low == "id" or low.endswith("_id") or low.startswith("id_") or "identifier" in low


def outliers(df: DataFrame, columns: Sequence[str] | None = None, k: float = 2.5) -> DataFrame:
    """Bounds, count, share and the spread of the values outside, by column. Columns named like ids are left out; a
    column without values has no bounds and no outliers."""
    names = [c for c in (numeric_columns(df) if columns is None else columns) if not id_like(c)]
    bounds = bounds_dict(outlier_bounds(df, names, k))

    def stats(name: str) -> Column:
        c, (low, high) = F.col(f"`{name}`").cast("double"), (F.lit(x).cast("double") for x in bounds.get(name, (None, None)))
        out = F.coalesce(is_outlier(c, low, high), F.lit(False))
        x = F.when(out, c)
        values = {"low": low, "high": high, "n_outliers": F.count_if(out), "pct": F.round(F.count_if(out) * 100.0 / F.nullif(F.count(c), F.lit(0)), 2), "mean": F.avg(x), "std": F.stddev_samp(x), "min": F.min(x), "max": F.max(x)}
        return F.struct(F.lit(name).alias("column"), *[v.alias(a) for a, v in values.items()])

    rows = df.agg(F.array(*[stats(n) for n in names or df.columns[:1]]).alias("a")).select(F.inline("a"))
    return rows if names else rows.where(F.lit(False))


def outlier_sample(df: DataFrame, column: str, key: str, k: float = 2.5, n_out: int = 100, n_in: int = 200) -> DataFrame:
    """The first values outside (``n_out``) and inside (``n_in``) the bounds, in key order: a report, so limited."""
    low, high = bounds_dict(outlier_bounds(df, [column], k))[column]
    rows = df.select(F.col(key).alias("key"), F.col(column).cast("double").alias("value")).where("value is not null")
    out, inn = rows.where(is_outlier(F.col("value"), low, high)), rows.where(~is_outlier(F.col("value"), low, high))
    return out.orderBy("key").limit(n_out).withColumn("outside", F.lit(True)).union(inn.orderBy("key").limit(n_in).withColumn("outside", F.lit(False)))


def correlations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """f1, f2, r of every two columns, over the rows where both are known; f1 before f2 in column order. None for fewer than two columns."""
    names = list(columns or numeric_columns(df))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    out = None
    for lo in range(0, len(pairs), 4 * BATCH):
        part = df.agg(F.array(*[F.struct(F.lit(a).alias("f1"), F.lit(b).alias("f2"), F.corr(F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double")).alias("r")) for a, b in pairs[lo : lo + 4 * BATCH]]).alias("a"))
        part = part.select(F.inline("a"))
        out = part if out is None else out.union(part)
    if out is None:  # fewer than two columns
        return df.sparkSession.createDataFrame([], "f1 string, f2 string, r double")
    return out.where("r is not null")


def correlated_pairs(df: DataFrame, columns: Sequence[str] | None = None, limit: float = 0.7) -> DataFrame:
    return correlations(df, columns).where(F.abs("r") > limit)


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, value (text; null counts too), n."""
    long = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns]).unpivot([], list(columns), "column", "value")
    return long.groupBy("column", "value").agg(F.count("*").alias("n"))


def categorical(df: DataFrame, columns: Sequence[str] | None = None, top: int = 5) -> DataFrame:
    """Distinct values, mode, top values and cardinality band by column."""
    counts = value_counts(df, columns or text_columns(df)).where("value is not null")
    sizes = counts.groupBy("column").agg(F.count("*").alias("n_distinct"))
    best = leading(counts, top).groupBy("column").agg(
        F.max(F.when(F.col("rank") == 1, F.col("value"))).alias("mode"),
        F.max(F.when(F.col("rank") == 1, F.col("n"))).alias("mode_count"),
        F.array_sort(F.collect_list(F.struct("rank", "value", "n"))).alias("best"),
    )
    band = F.when(F.col("n_distinct") > 50, "high").when(F.col("n_distinct") > 10, "medium").otherwise("low")
    listed = F.array_join(F.transform("best", lambda b: F.concat_ws(":", b["value"], b["n"].cast("string"))), ",")
    return sizes.join(F.broadcast(best), "column").select("column", "n_distinct", "mode", "mode_count", band.alias("cardinality"), listed.alias("top"))  # a row for each column


def leading(counts: DataFrame, top: int) -> DataFrame:
    """The ``top`` most frequent values of each column, with their rank: Spark drops the others before the shuffle."""
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))).where(F.col("rank") <= top)


def top_map(df: DataFrame, columns: Sequence[str], top: int = 5) -> DataFrame:
    """The most frequent values of each column as a map."""
    counts = value_counts(df, columns).where("value is not null")
    return leading(counts, top).groupBy("column").agg(F.map_from_entries(F.collect_list(F.struct("value", "n"))).alias("top"))


def value_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts with each value's share within its column."""
    counts = value_counts(df, columns).where("value is not null")
    totals = counts.groupBy("column").agg(F.sum("n").alias("of"))  # a row for each column
    return counts.join(F.broadcast(totals), "column").select("column", "value", "n", (F.col("n") / F.col("of")).alias("share"))


def rare_values(df: DataFrame, columns: Sequence[str], rare: float = 0.02, dominant: float = 0.1) -> DataFrame:
    """Values below ``rare`` in columns where at least two values hold over ``dominant``; with the three largest values."""
    shares = value_shares(df, columns)
    large = shares.groupBy("column").agg(F.count_if(F.col("share") > dominant).alias("large")).where("large >= 2")
    lead = leading(shares, 3).groupBy("column").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]), ",").alias("dominant"))
    heads = large.join(F.broadcast(lead), "column").select("column", "dominant")  # a row for each column
    return shares.where(F.col("share") < rare).join(F.broadcast(heads), "column").select("column", "value", "n", "share", "dominant")


def _segments(length: int, apart: int) -> list[tuple[int, int]]:
    """(start, length) of apart + 1 segments of about equal length."""
    n = apart + 1
    short, longer = divmod(length, n)
    out, at = [], 0
    for i in range(n):
        size = short + (i >= n - longer)
        out.append((at, size))
        at += size
    return out


def similar_values(df: DataFrame, columns: Sequence[str], least: float = 0.8) -> DataFrame:
    """column, value, n, similar, n_similar, similarity: different values of a column that may be one, misspelt.

    Similarity is 1 - edits / length of the longer value, as characters, and ``least`` (over 0.5) at the least;
    ``value`` is the rarer of both (the later one in the alphabet of equals). Values within t edits share one of t + 1
    segments of the shorter one, at about its place, so values meet by segments and only those are compared in full.
    """
    counts = cut(value_counts(df, columns).where("value <> ''"))

    def signatures(batches):  # noqa: ANN001, ANN202
        edits = lambda n: int((1 - least) * n + 1e-9)  # noqa: E731  of a pair whose longer value has n characters
        for b in batches:
            out = []
            for column, value, n in zip(b["column"], b["value"], b["n"]):
                size = len(value)
                for t in sorted({edits(m) for m in range(size, int(size / least + 1e-9) + 1)} - {0}):  # as the shorter value
                    out += [(column, value, n, True, f"{size}|{t}|{i}|{value[at : at + k]}") for i, (at, k) in enumerate(_segments(size, t)) if k]
                t = edits(size)
                for other in range(size - t, size + 1) if t else ():  # as the longer one
                    for i, (at, k) in enumerate(_segments(other, t)):
                        near = {value[j : j + k] for j in range(max(0, at - t), min(size - k, at + t) + 1)} if k else ()
                        out += [(column, value, n, False, f"{other}|{t}|{i}|{x}") for x in near]
            yield pd.DataFrame(out, columns=["column", "value", "n", "shorter", "key"])

    signed = cut(counts.mapInPandas(signatures, "`column` string, value string, n long, shorter boolean, key string"))
    a = signed.where("shorter").select("column", "key", F.col("value").alias("a"), F.col("n").alias("na"))
    b = signed.where("not shorter").select("column", "key", F.col("value").alias("b"), F.col("n").alias("nb"))
    met = a.join(b, ["column", "key"]).where("a <> b").select("column", "a", "na", "b", "nb").distinct()
    alike = 1 - F.levenshtein("a", "b") / F.greatest(F.length("a"), F.length("b"))
    met = met.withColumn("similarity", alike).where(F.col("similarity") >= least - 1e-9)
    first = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") > F.col("b")))
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return met.select("column", pick("a", "b").alias("value"), pick("na", "nb").alias("n"), pick("b", "a").alias("similar"), pick("nb", "na").alias("n_similar"), "similarity").distinct()


def duplicates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: rows that repeat an earlier one, their percentage, and whether there are any."""
    groups = df.groupBy(*(columns or df.columns)).agg(F.count("*").alias("n"))
    total = groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))
    return total.select("n_duplicates", F.round(F.try_divide(F.col("n_duplicates") * 100.0, F.col("n_rows")), 2).alias("pct"), (F.col("n_duplicates") > 0).alias("has_duplicates"))


def duplicate_groups(df: DataFrame, columns: Sequence[str], key: str, groups: int = 20, ids: int = 10) -> DataFrame:
    """The first groups of equal rows, how often each occurs and its first keys: a report, so limited."""
    each = df.groupBy(*columns).agg(F.count("*").alias("n"), F.min(key).alias("first_key")).where("n > 1").orderBy(*columns).limit(groups)
    rows = df.join(F.broadcast(each.select(*columns)), list(columns))  # at most ``groups`` rows
    ranked = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*columns).orderBy(key))).where(F.col("nth") <= ids)
    listed = ranked.groupBy(*columns).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", F.col(key).alias("k")))), lambda s: s["k"].cast("string")), ",").alias("keys"))
    return each.join(listed, list(columns)).select(*columns, "n", "keys")


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """One row: classes, smallest and largest share, ratio, and whether the classes are imbalanced."""
    n = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    one = n.agg(F.count("*").alias("n_classes"), (F.min("n") * 100.0 / F.sum("n")).alias("minority_pct"), (F.max("n") / F.min("n")).alias("ratio"))
    return one.withColumn("imbalanced", (F.col("minority_pct") < 25) | (F.col("ratio") > 3))


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """bin (from 1), n. Bins of equal width; the largest value lies in the last."""
    c = F.col(column).cast("double")
    low, high = df.agg(F.min(c), F.max(c)).head()
    if low is None or low == high:
        return df.where(c.isNotNull()).groupBy(F.lit(1).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    at = F.least(F.floor((c - F.lit(low)) / F.lit((high - low) / bins)) + 1, F.lit(bins))
    return df.where(c.isNotNull()).groupBy(at.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def box_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The five numbers of a box, and the widths between them."""
    d = distribution(df, columns)
    return d.select("column", "min", "q25", "median", "q75", "max", (F.col("q25") - F.col("min")).alias("w1"), (F.col("median") - F.col("q25")).alias("w2"), (F.col("q75") - F.col("median")).alias("w3"), (F.col("max") - F.col("q75")).alias("w4"))
