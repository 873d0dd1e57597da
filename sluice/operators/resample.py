"""Class rebalancing: random oversampling, synthetic minority rows, and removal of Tomek links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import neighbours, profile
from .rows import hash_edges


def _unit(*parts: Column) -> Column:
    """A number in [0, 1) from a hash, the same on every run."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary")), 1, 12), 16, 10).cast("double") / float(16**12)


def oversample(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """Each class up to the largest: rows repeat as often as needed, and the rest by a hash of the key.

    ``copy`` is 0 for the row itself. Rows of a class are counted in groups by hash, so none is sorted whole.
    """
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect() if r[0] is not None}  # a row for each class
    most = max(counts.values(), default=0)
    h = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")).cast("binary"))
    named = F.col(label).cast("string")
    edges = hash_edges(df.where(F.col(label).isNotNull()), h, named, {(str(c), 0): most % n for c, n in counts.items() if most % n})
    whole = F.create_map(*[F.lit(x) for c, n in counts.items() for x in (c, most // n)])[F.col(label)]
    extra = F.lit(0)
    for (c, _), e in edges.items():
        extra = F.when((named == F.lit(c)) & (h <= F.lit(e)), 1).otherwise(extra)
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.coalesce(whole, F.lit(1)) + extra - 1)))


def smote(rows: DataFrame, label: str = "label", k: int = 5, seed: int = 42) -> DataFrame:
    """``rows`` (id, v, label) with synthetic rows (id null) for every class below the largest.

    A synthetic row lies between a row and one of its k nearest of the same class; both that choice and the place
    follow from a hash of the row and the number of the copy.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}  # a row for each class
    most = max(counts.values(), default=0)
    out = rows.select("id", "v", label)
    for c, n in counts.items():
        if n == most or n < 2:
            continue
        mine = rows.where(F.col(label) == F.lit(c))
        kk = min(k, n - 1)
        near = neighbours.knn(mine, mine, kk).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "nid"))).alias("near"))
        each, rest = divmod(most - n, n)
        h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string")).cast("binary"))
        edge = hash_edges(mine, h, F.lit(""), {("", 0): rest})[("", 0)] if rest else None
        number = F.lit(each) + (F.when(h <= F.lit(edge), 1).otherwise(0) if rest else F.lit(0))
        made = mine.join(near, "id").withColumn("n", number).where("n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
        pick = F.get("near", F.floor(_unit(F.lit(seed), F.col("id"), F.col("copy")) * F.size("near")).cast("int"))["nid"]
        made = made.select("id", "v", label, pick.alias("nid"), _unit(F.lit(seed + 1), F.col("id"), F.col("copy")).alias("u"))
        other = mine.select(F.col("id").alias("nid"), F.col("v").alias("w"))
        made = made.join(other, "nid").select(F.lit(None).cast("long").alias("id"), F.transform(F.zip_with("v", "w", lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda s: s["a"] + F.col("u") * (s["b"] - s["a"])).alias("v"), label)
        out = out.unionByName(made)
    return out


def smote_tomek(rows: DataFrame, label: str = "label", k: int = 5, seed: int = 42) -> DataFrame:
    """``smote``, then both rows of every Tomek link go."""
    every = smote(rows, label, k, seed)
    numbered = every.withColumn("id", F.coalesce("id", F.xxhash64(F.col("v"), F.col(label))))
    links = neighbours.tomek_links(numbered.withColumnRenamed(label, "label") if label != "label" else numbered)
    gone = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return numbered.join(gone, "id", "left_anti")


def policy(df: DataFrame, label: str) -> tuple[str, DataFrame]:
    """What to do about the classes (none, oversample, smote, smote_tomek), and the row it follows from."""
    one = profile.class_balance(df, label)
    r = one.head()
    smallest = df.groupBy(label).count().agg(F.min("count")).head()[0] or 0
    if not r["imbalanced"]:
        return "none", one
    if smallest >= 6 and r["ratio"] > 5:
        return "smote", one
    if smallest >= 6 and r["ratio"] > 2.5:
        return "smote_tomek", one
    return "oversample", one


def balanced(rows: DataFrame, label: str = "label", k: int = 5, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """``rows`` (id, v, label) rebalanced by ``policy``, and a report: class, policy, before, after.

    What cannot be made (a class of one row has no neighbours) leaves the rows as they are.
    """
    how = policy(rows, label)[0]
    try:
        out = rows if how == "none" else smote(rows, label, k, seed) if how == "smote" else smote_tomek(rows, label, k, seed) if how == "smote_tomek" else oversample(rows, label, "id", seed).drop("copy")
        out = cut(out.select("id", "v", label))
    except Exception:  # an input that the method cannot handle
        how, out = f"{how}_failed", rows.select("id", "v", label)
    count = lambda df, name: df.groupBy(F.col(label).alias("class")).agg(F.count("*").alias(name))
    return out, count(rows, "before").join(count(out, "after"), "class", "left").select("class", F.lit(how).alias("policy"), "before", F.coalesce("after", F.lit(0)).alias("after"))
