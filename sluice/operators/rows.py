"""Which rows stay: duplicates, outliers, rare values, splits, folds and what-if counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from . import profile


def select_columns(df: DataFrame, columns: Sequence[str], target: str | None = None) -> DataFrame:
    """The named columns; the target is added again if it was left out. Unknown names and an empty list are errors."""
    if not columns:
        raise ValueError("no columns selected")
    unknown = [c for c in columns if c not in df.columns]
    if unknown:
        raise ValueError(f"no such columns: {', '.join(unknown)}")
    return df.select(*columns, *[target] * (target is not None and target not in columns))


def drop_values(df: DataFrame, values: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rows without the given (trimmed) values; nulls stay."""
    for column, listed in values.items():
        df = df.where(~F.trim(F.col(column)).isin(list(listed)) | F.col(column).isNull())
    return df


def drop_values_report(df: DataFrame, values: Mapping[str, Sequence[str]], target: str | None = None) -> DataFrame:
    """column, n_rows, n_removed, by column alone, with what would be left after all: from one pass.

    ``hits_target``: values of the target itself would go, so that a class may be left with too few rows to split.
    """
    hit = {c: F.coalesce(F.trim(F.col(c)).isin(list(v)), F.lit(False)) for c, v in values.items()}
    any_hit = F.lit(False)
    for h in hit.values():
        any_hit = any_hit | h
    rows = df.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.count("*").alias("n_rows"), F.count_if(h).alias("n_removed"), F.count_if(~any_hit).alias("n_left"), F.lit(c == target and bool(values[c])).alias("hits_target")) for c, h in hit.items()]).alias("a"))
    return rows.select(F.inline("a"))


def guard(df: DataFrame, target: str, least_rows: int = 10) -> DataFrame:
    """One row: whether enough rows and class members are left to go on."""
    counts = df.groupBy(target).agg(F.count("*").alias("n"))
    one = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.min("n").alias("smallest"))
    return one.select("n_rows", "smallest", (F.col("n_rows") >= least_rows).alias("enough_rows"), (F.col("smallest") >= 2).alias("enough_members"), (F.col("smallest") < 4).alias("warn"))


def drop_outliers(df: DataFrame, columns: Sequence[str], k: float = 2.5) -> DataFrame:
    """Rows within the bounds of all columns; nulls stay. The bounds are a few numbers, put into the filter."""
    for c, (low, high) in profile.bounds_dict(profile.outlier_bounds(df, columns, k)).items():
        df = df.where(F.col(c).isNull() | ~profile.is_outlier(F.col(c), low, high))
    return df


def drop_outliers_in_turn(df: DataFrame, columns: Sequence[str], k: float = 1.5) -> DataFrame:
    """As ``drop_outliers``, but column after column with new bounds each time, and without the nulls."""
    for c in columns:
        bounds = profile.bounds_dict(profile.outlier_bounds(df, [c], k))
        if c in bounds:
            df = df.where(F.col(c).between(*bounds[c]))
    return df


def drop_duplicates(df: DataFrame, columns: Sequence[str], key: str, keep: str = "first") -> DataFrame:
    """Rows whose ``columns`` differ: of equal ones the first or last by ``key``, or none at all.

    An aggregate, so that rows of a large group are combined before the shuffle.
    """
    if keep != "none" and sorted(df.columns) == sorted([*columns, key]) and key not in columns:  # equal rows differ in the key alone
        best = (F.max if keep == "last" else F.min)(key).alias(key)
        return df.groupBy(*columns).agg(best).select(df.columns)
    row, pick = F.struct(*df.columns), F.max_by if keep == "last" else F.min_by
    groups = df.groupBy(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(columns)]).agg(pick(row, F.col(key)).alias("_row"), F.count("*").alias("_n"))
    return (groups.where("_n = 1") if keep == "none" else groups).select("_row.*")


def exclude(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among ``ids``."""
    return df.join(ids.select(key), key, "left_anti")


def final_fill(df: DataFrame) -> DataFrame:
    """What is still missing: 0 in numbers, empty in texts."""
    return df.fillna(0).fillna("")


def validation(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, n_null, n_infinite, scaled: checks of prepared output."""

    def stats(c: Column) -> dict[str, Column]:
        d = c.cast("double")
        return {"n_null": F.count_if(d.isNull() | F.isnan(d)), "n_infinite": F.count_if(F.abs(d) == float("inf")), "mean": F.avg(d), "std": F.stddev_pop(d)}

    rows = profile.per_column(df, columns or profile.numeric_columns(df), stats)
    return rows.select("column", "n_null", "n_infinite", F.coalesce((F.abs("mean") < 0.5) & (F.abs(F.col("std") - 1) < 0.5), F.lit(False)).alias("scaled"))


def output_checks(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """check, passed, severity: whether prepared features are numbers, complete, finite, as many as their names, and none an id."""
    numeric = set(profile.numeric_columns(df))
    whole = validation(df, [c for c in df.columns if c in numeric]).agg(F.coalesce(F.sum("n_null"), F.lit(0)) == 0, F.coalesce(F.sum("n_infinite"), F.lit(0)) == 0, F.count_if("scaled") > 0).head()
    checks = [
        ("numeric", numeric == set(df.columns), "error"), ("no_nulls", whole[0], "error"), ("finite", whole[1], "error"), ("width", len(df.columns) == len(names), "error"),
        ("no_ids", not any(profile.id_like(c) for c in names), "warning"), ("scaled", whole[2], "info"),
    ]
    return df.sparkSession.createDataFrame([(n, bool(p), k) for n, p, k in checks], "`check` string, passed boolean, severity string")


def schema_difference(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """kind (missing or extra), column: wanted columns that hold no value in any row, and columns with values that are not wanted."""
    held = df.agg(F.array(*[F.when(F.count(f"`{c}`") > 0, F.lit(c)) for c in df.columns]).alias("held")).select(F.array_compact("held").alias("held"))
    want = F.array(*map(F.lit, wanted))
    return held.select(F.explode(F.array_except(want, F.col("held"))).alias("column")).select(F.lit("missing").alias("kind"), "column").union(held.select(F.explode(F.array_except("held", want)).alias("column")).select(F.lit("extra").alias("kind"), "column"))


def _order(key: str, seed: int) -> Column:
    """An order by hash of the key, the same in any engine."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")).cast("binary"))


def hash_edges(df: DataFrame, h: Column, label: Column, wanted: Mapping[tuple[str, int], int]) -> dict[tuple[str, int], str]:
    """For each (class, number) the text up to which exactly so many hashes of the class lie.

    Hashes are counted by their first digits, three more each time, within the groups that a border falls into: a
    few thousand counts for each border, and no sort. ``label`` is the class as text. Rows that share a key share a
    hash and fall on one side together, so that quotas are exact for keys that do not repeat.
    """
    rows = df.select(label.alias("c"), h.alias("h"))
    done = {k: "" for k, n in wanted.items() if n <= 0}
    open_ = {k: ("", n) for k, n in wanted.items() if n > 0}
    size = 0
    while open_:
        heads = {f"{c}|{prefix}" for (c, _), (prefix, _) in open_.items()}
        within = rows if not size else rows.where(F.concat_ws("|", "c", F.substring("h", 1, size)).isin(*heads))
        counts: dict[str, list[tuple[str, int]]] = {}
        for r in within.groupBy("c", F.substring("h", 1, size + 3).alias("p")).count().collect():
            counts.setdefault(r["c"], []).append((r["p"], r["count"]))
        size += 3
        for k, (prefix, left) in list(open_.items()):
            for p, n in sorted(x for x in counts.get(k[0], []) if x[0].startswith(prefix)):
                if n < left:
                    left -= n
                    continue
                if n == left or size >= 32:
                    done[k] = p + "~"  # behind every digit
                    del open_[k]
                else:
                    open_[k] = (p, left)
                break
            else:
                done[k] = "~"
                del open_[k]
    return done


def _class(label: str | None) -> Column:
    return F.lit("") if label is None else F.coalesce(F.col(label).cast("string"), F.lit("\0"))


def train_test_split(df: DataFrame, key: str, label: str | None = None, ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """``df`` with ``split``: exactly ceil(n * ratio) test rows, in each class its share (largest remainders).

    Of each class the rows with the lowest hashes of the key are for testing. Not stratified if a class has under
    two rows.
    """
    counts = {r[0]: r[1] for r in df.groupBy(_class(label)).count().collect()}  # a row for each class
    if label is not None and min(counts.values(), default=0) < 2:
        return train_test_split(df, key, None, ratio, seed)
    exact = {c: n * ratio for c, n in counts.items()}
    take = {c: int(x) for c, x in exact.items()}
    for c in sorted(counts, key=lambda c: (take[c] - exact[c], c))[: max(0, ceil(sum(counts.values()) * ratio) - sum(take.values()))]:
        take[c] += 1
    h = _order(key, seed)
    edges = hash_edges(df, h, _class(label), {(c, 0): n for c, n in take.items()})
    test = F.lit(False)
    for (c, _), edge in edges.items():
        test = test | ((_class(label) == F.lit(c)) & (h <= F.lit(edge)))
    return df.withColumn("split", F.when(test, "test").otherwise("train"))


def folds(df: DataFrame, key: str, label: str | None = None, k: int = 5, seed: int = 42) -> DataFrame:
    """``df`` with ``fold``: 0 to k - 1, of even size within each class, by the order of a hash of the key."""
    counts = {r[0]: r[1] for r in df.groupBy(_class(label)).count().collect()}  # a row for each class
    wanted = {(c, j): sum(n // k + (i < n % k) for i in range(j)) for c, n in counts.items() for j in range(1, k)}
    h, fold = _order(key, seed), F.lit(0)
    for (c, _), edge in hash_edges(df, h, _class(label), wanted).items():
        fold = fold + ((_class(label) == F.lit(c)) & (h > F.lit(edge))).cast("int")
    return df.withColumn("fold", fold)


def search(df: DataFrame, text: str, columns: Sequence[str]) -> DataFrame:
    """Rows with ``text`` in any of the columns, whatever the case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(F.col(c)).contains(text.lower()), F.lit(False))
    return df.where(hit)


def preview(df: DataFrame, key: str, rows: int = 10, columns: int = 30) -> DataFrame:
    """The first rows and columns, with the number of columns left out: a report, so limited."""
    shown = df.columns[:columns]
    return df.orderBy(key).limit(rows).select(*shown).withColumn("hidden_columns", F.lit(max(0, len(df.columns) - columns)))


def preview_splits(df: DataFrame, key: str, train: int = 8, test: int = 2) -> DataFrame:
    """The first rows of each split."""
    rank = F.row_number().over(Window.partitionBy("split").orderBy(key))
    return df.withColumn("_r", rank).where(F.col("_r") <= F.when(F.col("split") == "train", train).otherwise(test)).drop("_r")


def ranked(df: DataFrame, groups: Sequence[str], order: Sequence[str], name: str = "place", tasks: int | None = None) -> DataFrame:
    """``df`` with the place of each row (from 1) in its group, by ``order`` (which should leave no ties).

    Rows are spread over ranges of (group, order), so that no task holds all of a large group; a range's places go on
    from the rows that its group has in earlier ranges. Nulls are a group of their own and come first in the order.
    """
    keys = [F.col(f"`{c}`") for c in (*groups, *order)]
    parted = df.repartitionByRange(tasks, *keys) if tasks else df.repartitionByRange(*keys)
    parted = cut(parted.withColumn("_range", F.spark_partition_id()))
    named = [F.col(f"`{c}`").alias(f"_g{i}") for i, c in enumerate(groups)]
    held = [f"_g{i}" for i in range(len(groups))]
    sizes = parted.groupBy(*named, F.col("_range").alias("_r")).agg(F.count("*").alias("_n"))  # a row for each range, and for each group
    earlier = Window.partitionBy(*held).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    same = F.col("_range") == F.col("_r")
    for c, h in zip(groups, held):
        same = same & F.col(f"`{c}`").eqNullSafe(F.col(h))
    inside = F.row_number().over(Window.partitionBy(*keys[: len(groups)], "_range").orderBy(*keys[len(groups) :]))
    return parted.withColumn("_inside", inside).join(before, same).select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_before") + F.col("_inside")).alias(name))
