"""Profiles, quality, columns and rows (A, F and W operators)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog, columns, profile, quality, rows
from . import load, query
from .inputs import LINES_SQL, NUMBERS, ORDERS_SQL, each, lines, orders

_BOUNDS = """quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3, avg({c}) AS m, stddev_samp({c}) AS sd"""


def _r(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


@query("a01_basic_info", f"WITH t AS ({ORDERS_SQL}) SELECT count(*) AS n_rows, 9::BIGINT AS n_columns, 6::BIGINT AS n_numeric, 2::BIGINT AS n_categorical, 1::BIGINT AS n_datetime FROM t")
def a01(spark: SparkSession, d: str) -> DataFrame:
    return profile.basic_info(orders(spark, d))


@query("a02_missing", each([*NUMBERS, "flag", "status"], "count(*) - count({c}) AS n_missing, round((count(*) - count({c})) * 100.0 / count(*), 2) AS pct_missing", LINES_SQL))
def a02(spark: SparkSession, d: str) -> DataFrame:
    return profile.missing(lines(spark, d))


@query("a02_missing_total", f"WITH t AS ({LINES_SQL}), m AS (" + " UNION ALL ".join(f"SELECT count(*) - count({c}) AS n, count(*) AS r FROM t" for c in [*NUMBERS, "flag", "status"]) + ") SELECT sum(n)::BIGINT AS n_missing, round(sum(n) * 100.0 / sum(r), 2) AS pct_cells, count(*) FILTER (n > 0) AS n_columns FROM m")
def a02_total(spark: SparkSession, d: str) -> DataFrame:
    return profile.missing_total(lines(spark, d))


@query("a03_duplicates", "WITH g AS (SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus, l_linenumber, l_quantity) SELECT (sum(n) - count(*))::BIGINT AS n_duplicates, round((sum(n) - count(*)) * 100.0 / sum(n), 2) AS pct, sum(n) > count(*) AS has_duplicates FROM g")
def a03(spark: SparkSession, d: str) -> DataFrame:
    return profile.duplicates(load(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity"])


@query(
    "a04_duplicate_groups",
    """WITH g AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1 ORDER BY 1, 2 LIMIT 20),
    r AS (SELECT o.o_orderstatus, o.o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o.o_orderstatus, o.o_orderpriority ORDER BY o_orderkey) AS k FROM orders o JOIN g USING (o_orderstatus, o_orderpriority))
    SELECT g.o_orderstatus, g.o_orderpriority, n, string_agg(o_orderkey::VARCHAR, ',' ORDER BY k) AS keys FROM g JOIN r USING (o_orderstatus, o_orderpriority) WHERE k <= 10 GROUP BY ALL""",
)
def a04(spark: SparkSession, d: str) -> DataFrame:
    return profile.duplicate_groups(load(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], "o_orderkey")


@query(
    "a05_distribution",
    each(
        NUMBERS,
        "count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS q75, round(skewness({c}), 4) AS skewness, round(kurtosis({c}), 4) AS kurtosis",
        LINES_SQL,
    ),
)
def a05(spark: SparkSession, d: str) -> DataFrame:
    return _r(profile.distribution(lines(spark, d), NUMBERS), 4, "mean", "std", "q25", "median", "q75", "skewness", "kurtosis")


@query("a06_describe", each(["c_acctbal"], "count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c}) AS min, max({c}) AS max", "SELECT c_acctbal FROM customer"))
def a06(spark: SparkSession, d: str) -> DataFrame:
    return _r(profile.distribution(load(spark, d, "customer"), ["c_acctbal"]).select("column", "n", "mean", "std", "min", "max"), 4, "mean", "std")


_OUT = """WITH t AS ({src}), b AS (SELECT *, CASE WHEN q3 - q1 < 1e-10 THEN m - 3 * sd ELSE q1 - {k} * (q3 - q1) END AS low, CASE WHEN q3 - q1 < 1e-10 THEN m + 3 * sd ELSE q3 + {k} * (q3 - q1) END AS high FROM (SELECT {bounds} FROM t))"""


def _outlier_sql(src: str, column: str, k: float) -> str:
    return _OUT.format(src=src, k=k, bounds=_BOUNDS.replace("{c}", column))


@query(
    "a07_outliers",
    _outlier_sql(ORDERS_SQL, "price", 2.5) + """, o AS (SELECT price, low, high, price < low OR price > high AS out FROM t, b WHERE price IS NOT NULL)
    SELECT 'price' AS "column", round(any_value(low), 4) AS low, round(any_value(high), 4) AS high, count(*) FILTER (out) AS n_outliers, round(count(*) FILTER (out) * 100.0 / count(*), 2) AS pct,
    round(avg(price) FILTER (out), 4) AS mean, round(stddev_samp(price) FILTER (out), 4) AS std, min(price) FILTER (out) AS min, max(price) FILTER (out) AS max FROM o""",
)
def a07(spark: SparkSession, d: str) -> DataFrame:
    return _r(profile.outliers(orders(spark, d), ["price"]), 4, "low", "high", "mean", "std")


@query(
    "a07_outlier_sample",
    _outlier_sql(ORDERS_SQL, "price", 2.5) + """, o AS (SELECT order_id AS key, price AS value, price < low OR price > high AS outside FROM t, b WHERE price IS NOT NULL)
    (SELECT * FROM o WHERE outside ORDER BY key LIMIT 100) UNION ALL (SELECT * FROM o WHERE NOT outside ORDER BY key LIMIT 200)""",
)
def a07_sample(spark: SparkSession, d: str) -> DataFrame:
    return profile.outlier_sample(orders(spark, d), "price", "order_id")


@query(
    "a08_outlier_totals",
    "WITH x AS (" + " UNION ALL ".join(f"({_outlier_sql(LINES_SQL, c, 1.5)} SELECT count(*) FILTER ({c} < low OR {c} > high) AS n FROM t, b)" for c in NUMBERS) + ") SELECT sum(n)::BIGINT AS n_outliers, count(*) FILTER (n > 0) AS n_columns FROM x",
)
def a08(spark: SparkSession, d: str) -> DataFrame:
    return profile.outliers(lines(spark, d), NUMBERS, 1.5).agg(F.sum("n_outliers").alias("n_outliers"), F.count_if(F.col("n_outliers") > 0).alias("n_columns"))


_CORR = f"WITH t AS ({LINES_SQL}) " + " UNION ALL ".join(f"SELECT '{a}' AS f1, '{b}' AS f2, round(corr({a}, {b}), 6) AS r FROM t" for a, b in combinations(NUMBERS, 2))


@query("a09_correlations", _CORR)
def a09(spark: SparkSession, d: str) -> DataFrame:
    return _r(profile.correlations(lines(spark, d), NUMBERS), 6, "r")


@query("a10_correlated_pairs", "SELECT 'a' AS f1, 'b' AS f2, round(corr(p_size, p_size * 2 + p_partkey % 3), 6) AS r FROM part")
def a10(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "part").selectExpr("p_size AS a", "p_size * 2 + p_partkey % 3 AS b", "p_retailprice AS c")
    return _r(profile.correlated_pairs(df, ["a", "b", "c"], 0.7), 6, "r").where("f2 = 'b'")


_COUNTS = "WITH t AS ({src}), c AS (" + "{parts}" + "), r AS (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, value) AS k, n / sum(n) OVER (PARTITION BY \"column\") AS share FROM c)"


def _counts(src: str, names: list[str]) -> str:
    return _COUNTS.format(src=src, parts=" UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c}::VARCHAR AS value, count(*) AS n FROM t WHERE {c} IS NOT NULL GROUP BY {c}" for c in names))


@query(
    "a11_categorical",
    _counts(ORDERS_SQL, ["status", "priority"]) + """ SELECT "column", count(*) AS n_distinct, max(value) FILTER (k = 1) AS mode, max(n) FILTER (k = 1) AS mode_count,
    CASE WHEN count(*) > 50 THEN 'high' WHEN count(*) > 10 THEN 'medium' ELSE 'low' END AS cardinality, string_agg(value || ':' || n, ',' ORDER BY k) FILTER (k <= 5) AS top FROM r GROUP BY 1""",
)
def a11(spark: SparkSession, d: str) -> DataFrame:
    return profile.categorical(orders(spark, d), ["status", "priority"])


@query(
    "a12_rare_values",
    _counts(ORDERS_SQL, ["status", "priority"]) + """, w AS (SELECT *, count(*) FILTER (share > 0.1) OVER (PARTITION BY "column") AS large FROM r), l AS (SELECT "column", string_agg(value, ',' ORDER BY k) AS dominant FROM r WHERE k <= 3 GROUP BY 1)
    SELECT "column", value, n, round(share, 6) AS share, dominant FROM w JOIN l USING ("column") WHERE large >= 2 AND share < 0.02""",
)
def a12(spark: SparkSession, d: str) -> DataFrame:
    return _r(profile.rare_values(orders(spark, d), ["status", "priority"]), 6, "share")


_SIMILAR = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n FROM part WHERE {c} <> '' GROUP BY 2" for c in ("p_name", "p_type", "p_brand"))


@query(
    "a12_similar_values",
    f"""WITH v AS ({_SIMILAR}), p AS (SELECT a."column", a.value, a.n, b.value AS similar, b.n AS n_similar, 1 - levenshtein(a.value, b.value) / greatest(length(a.value), length(b.value)) AS similarity
    FROM v a JOIN v b ON a."column" = b."column" AND a.value <> b.value AND (a.n < b.n OR (a.n = b.n AND a.value > b.value))) SELECT * REPLACE (round(similarity, 6) AS similarity) FROM p WHERE similarity >= 0.8 - 1e-9""",
)
def a12b(spark: SparkSession, d: str) -> DataFrame:
    return _r(profile.similar_values(load(spark, d, "part"), ["p_name", "p_type", "p_brand"]), 6, "similarity")


_OUTSIDE = "(SELECT count(*) FILTER ({c} < low OR {c} > high) FROM t, (SELECT CASE WHEN q3 - q1 < 1e-10 THEN m - 3 * sd ELSE q1 - 2.5 * (q3 - q1) END AS low, CASE WHEN q3 - q1 < 1e-10 THEN m + 3 * sd ELSE q3 + 2.5 * (q3 - q1) END AS high FROM (SELECT " + _BOUNDS + " FROM t)))"
_ALL = ["order_id", "custkey", "price", "status", "priority", "placed", "late", "version", "optional"]


@query(
    "a13_quality_full",
    _counts(ORDERS_SQL, ["status", "priority"])
    + f""", w AS (SELECT *, count(*) FILTER (share > 0.1) OVER (PARTITION BY "column") AS large FROM r), n AS (SELECT count(*) AS n FROM t), g AS (SELECT count(*) AS k FROM t GROUP BY {", ".join(_ALL)}),
    p AS (SELECT round(({" + ".join(f"(SELECT count(*) - count({c}) FROM t)" for c in _ALL)}) / (n * 9) * 25, 4) AS p_missing, round((SELECT sum(k) - count(*) FROM g) / n * 15, 4) AS p_duplicates,
    round(least(20.0, ({" + ".join(_OUTSIDE.replace("{c}", c) for c in ("price", "late"))}) / (n * 2) * 100), 4) AS p_outliers, round((SELECT (abs(skewness(price)) > 2)::INT + (abs(skewness(late)) > 2)::INT FROM t) / 2 * 10.0, 4) AS p_skew,
    round(least(15.0, (SELECT count(*) FROM w WHERE large >= 2 AND share < 0.02) / 10 * 15.0), 4) AS p_rare, round(1 / 9 * 10.0, 4) AS p_low_variance, round((SELECT (abs(corr(price, late)) > 0.9)::INT FROM t) * 10.0, 4) AS p_correlation FROM n)
    SELECT *, round(greatest(0.0, 100 - (p_missing + p_duplicates + p_outliers + p_skew + p_rare + p_low_variance + p_correlation)), 3) AS score,
    CASE WHEN 100 - (p_missing + p_duplicates + p_outliers + p_skew + p_rare + p_low_variance + p_correlation) >= 90 THEN 'excellent' WHEN 100 - (p_missing + p_duplicates + p_outliers + p_skew + p_rare + p_low_variance + p_correlation) >= 75 THEN 'good' WHEN 100 - (p_missing + p_duplicates + p_outliers + p_skew + p_rare + p_low_variance + p_correlation) >= 60 THEN 'fair' WHEN 100 - (p_missing + p_duplicates + p_outliers + p_skew + p_rare + p_low_variance + p_correlation) >= 40 THEN 'poor' ELSE 'critical' END AS band FROM p""",
)
def a13(spark: SparkSession, d: str) -> DataFrame:
    return _r(quality.full_score(orders(spark, d), ["price", "late"], ["status", "priority"], ["version"]), 3, "score")


@query(
    "a14_quality_basic",
    f"WITH t AS ({LINES_SQL}), m AS (SELECT sum(6 * 1.0 - (quantity IS NOT NULL)::INT - (price IS NOT NULL)::INT - (discount IS NOT NULL)::INT - (tax IS NOT NULL)::INT - (flag IS NOT NULL)::INT - (status IS NOT NULL)::INT) AS x, count(*) AS n FROM t), g AS (SELECT count(*) AS k FROM t GROUP BY ALL), q AS (SELECT sum(k) - count(*) AS dup FROM (SELECT count(*) AS k FROM t GROUP BY quantity, price, discount, tax, flag, status)), s AS (SELECT round(100 - x * 50.0 / (n * 6) - dup * 30.0 / n, 4) AS score FROM m, q) SELECT score, CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 70 THEN 'good' WHEN score >= 50 THEN 'fair' ELSE 'poor' END AS band FROM s",
)
def a14(spark: SparkSession, d: str) -> DataFrame:
    return quality.basic_score(lines(spark, d))


@query(
    "a15_recommendations",
    _counts(ORDERS_SQL, ["status", "priority"])
    + f""", w AS (SELECT *, count(*) FILTER (share > 0.1) OVER (PARTITION BY "column") AS large FROM r), n AS (SELECT count(*) AS n FROM t),
    m AS ({" UNION ALL ".join(f"SELECT '{c}' AS c, (count(*) - count({c})) * 100.0 / count(*) AS pct, count(DISTINCT {c}) AS k FROM t" for c in _ALL)}), g AS (SELECT count(*) AS k FROM t GROUP BY {", ".join(_ALL)}),
    o AS ({" UNION ALL ".join(f"SELECT '{c}' AS c, {_OUTSIDE.replace('{c}', c)} * 100.0 / (SELECT count({c}) FROM t) AS pct" for c in ("price", "optional"))}),
    f AS (SELECT 'warning' AS type, 'missing_values' AS category, 'over half of the values are missing' AS message, 'drop_columns' AS action, c FROM m WHERE round(pct, 2) > 50
    UNION ALL SELECT 'info', 'missing_values', 'some values are missing', 'impute', c FROM m WHERE round(pct, 2) > 0 AND round(pct, 2) <= 50
    UNION ALL SELECT 'warning', 'duplicates', 'some rows repeat others', 'remove_duplicates', '*' FROM g HAVING sum(k) > count(*)
    UNION ALL SELECT 'warning', 'constant_features', 'one value at most', 'drop_columns', c FROM m WHERE k <= 1 AND c IN ('price', 'optional', 'status', 'priority')
    UNION ALL SELECT 'info', 'encoding', 'over 50 different values', 'encode_or_bin', c FROM m WHERE k > 50 AND c IN ('status', 'priority')
    UNION ALL SELECT DISTINCT 'warning', 'rare_values', 'values of under 2 % beside dominant ones, possibly typing errors', 'remove_rows', "column" FROM w WHERE large >= 2 AND share < 0.02
    UNION ALL SELECT 'info', 'outliers', 'over 5 % of the values are outliers', 'handle_outliers', c FROM o WHERE round(pct, 2) > 5
    UNION ALL SELECT 'info', 'correlation', 'strongly correlated with another column', 'remove_correlated', unnest(['price', 'optional']) FROM t HAVING abs(corr(price, optional)) > 0.9)
    SELECT type, category, message, action, string_agg(c, ',' ORDER BY c) AS columns FROM f GROUP BY ALL""",
)
def a15(spark: SparkSession, d: str) -> DataFrame:
    return quality.recommendations(orders(spark, d), ["price", "optional"], ["status", "priority"])


@query("a16_class_balance", f"WITH t AS ({ORDERS_SQL}), c AS (SELECT count(*) AS n FROM t GROUP BY late) SELECT count(*) AS n_classes, round(min(n) * 100.0 / sum(n), 6) AS minority_pct, round(max(n) / min(n), 6) AS ratio, min(n) * 100.0 / sum(n) < 25 OR max(n) / min(n) > 3 AS imbalanced FROM c")
def a16(spark: SparkSession, d: str) -> DataFrame:
    return _r(profile.class_balance(orders(spark, d), "late"), 6, "minority_pct", "ratio")


@query(
    "a17_skewness",
    f"WITH t AS ({ORDERS_SQL}) SELECT 'price' AS \"column\", round(skewness(price), 4) AS skewness, min(price) AS min, max(price) AS max, bool_or(price = 0) AS has_zero, bool_or(price < 0) AS has_negative, CASE WHEN min(price) > 0 THEN 'box-cox' ELSE 'yeo-johnson' END AS method FROM t",
)
def a17(spark: SparkSession, d: str) -> DataFrame:
    return _r(profile.skewed(orders(spark, d), ["price"]), 4, "skewness")


@query("a25_histogram", "WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT least(floor((value - lo) / ((hi - lo) / 20))::BIGINT + 1, 20) AS bin, count(*) AS n FROM events, b GROUP BY 1")
def a25(spark: SparkSession, d: str) -> DataFrame:
    return profile.histogram(load(spark, d, "events"), "value", 20)


@query("a26_box", each(["value"], "min({c}) AS min, round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS q75, max({c}) AS max, round(quantile_cont({c}, 0.25) - min({c}), 4) AS w1, round(quantile_cont({c}, 0.5) - quantile_cont({c}, 0.25), 4) AS w2, round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.5), 4) AS w3, round(max({c}) - quantile_cont({c}, 0.75), 4) AS w4", "SELECT value FROM events"))
def a26(spark: SparkSession, d: str) -> DataFrame:
    return _r(profile.box_summary(load(spark, d, "events"), ["value"]), 4, "q25", "median", "q75", "w1", "w2", "w3", "w4")


@query(
    "a31_change_summary",
    f"WITH t AS ({ORDERS_SQL}), n AS (SELECT count(*) AS n0, count(price) AS n1, sum({' + '.join(f'({c} IS NULL)::INT' for c in _ALL)}) AS m0 FROM t) SELECT n0 - n1 AS rows_removed, 1::BIGINT AS columns_removed, m0::BIGINT AS cells_filled, round(n1 / n0, 6) AS retention, round(100 - 30 * m0 / (n0 * 9), 6) AS quality, round(100 - 100 * m0 / (n0 * 9), 6) AS complete_before, 100.0 AS complete_after FROM n",
)
def a31(spark: SparkSession, d: str) -> DataFrame:
    before = orders(spark, d)
    return quality.change_summary(before, rows.final_fill(before.drop("version").where("price is not null")))


@query("w02_top_map", _counts(ORDERS_SQL, ["priority"]) + ' SELECT "column", string_agg(value || \':\' || n, \',\' ORDER BY value) AS top FROM r WHERE k <= 3 GROUP BY 1')
def w02(spark: SparkSession, d: str) -> DataFrame:
    top = profile.top_map(orders(spark, d), ["priority"], 3)
    return top.select("column", F.array_join(F.transform(F.array_sort(F.map_entries("top")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",").alias("top"))


@query("w09_value_shares", _counts(ORDERS_SQL, ["status", "priority"]) + ' SELECT "column", value, n, round(share, 6) AS share FROM r')
def w09(spark: SparkSession, d: str) -> DataFrame:
    return _r(profile.value_shares(orders(spark, d), ["status", "priority"]), 6, "share")


# Columns

_UNIQ = "count(DISTINCT {c}) / count({c})"


@query("f05_id_columns", each(["order_id", "custkey", "price", "late", "version", "optional", "status", "priority", "placed"], "CASE WHEN '{c}' = 'order_id' THEN count(DISTINCT {c}) / count({c}) > 0.95 ELSE FALSE END AS is_id", ORDERS_SQL))
def f05(spark: SparkSession, d: str) -> DataFrame:
    return columns.id_columns(orders(spark, d))


@query("f06_id_columns_basic", each(["order_id", "custkey", "late", "version", "status", "priority"], "('{c}' LIKE '%\\_id' ESCAPE '\\') OR count(DISTINCT {c}) = count({c}) AS is_id", ORDERS_SQL))
def f06(spark: SparkSession, d: str) -> DataFrame:
    return columns.id_columns(orders(spark, d).select("order_id", "custkey", "late", "version", "status", "priority"), "basic")


@query("f07_id_columns_unsupervised", each(["order_id", "custkey", "late"], "('{c}' LIKE '%\\_id%' ESCAPE '\\' AND count(DISTINCT {c}) / count({c}) > 0.95) OR (count(DISTINCT {c}) = count({c}) AND max({c}) - min({c}) + 1 = count({c}) AND count({c}) > 10) AS is_id", ORDERS_SQL))
def f07(spark: SparkSession, d: str) -> DataFrame:
    return columns.id_columns(orders(spark, d).select("order_id", "custkey", "late"), "unsupervised")


@query("f08_constant_columns", each(["late", "version", "status"], "count(DISTINCT {c}) AS n_distinct, count(DISTINCT {c}) <= 1 AS is_constant", ORDERS_SQL))
def f08(spark: SparkSession, d: str) -> DataFrame:
    return columns.constant_columns(orders(spark, d), ["late", "version", "status"])


_LOW = "WITH t AS (SELECT CASE WHEN o_orderkey % 50 = 0 THEN 7 ELSE 1 END AS a, CASE WHEN o_orderkey % 50 = 0 THEN 1.1 ELSE 1.0 END AS b, o_orderstatus AS c FROM orders)"


@query(
    "f09_low_variance",
    _LOW + " " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(max(k) / sum(k), 6) AS modal_share, {cv} AS cv, max(k) / sum(k) > 0.95 AND {ok} AS is_low FROM (SELECT {c}, count(*) AS k FROM t GROUP BY 1)" for c, cv, ok in (("a", "round((SELECT stddev_samp(a) / avg(a) FROM t), 6)", "(SELECT stddev_samp(a) / avg(a) FROM t) <= 0.5"), ("b", "round((SELECT stddev_samp(b) / avg(b) FROM t), 6)", "(SELECT stddev_samp(b) / avg(b) FROM t) <= 0.5"), ("c", "NULL", "TRUE"))),
)
def f09(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "orders").selectExpr("CASE WHEN o_orderkey % 50 = 0 THEN 7 ELSE 1 END AS a", "CASE WHEN o_orderkey % 50 = 0 THEN 1.1D ELSE 1.0D END AS b", "o_orderstatus AS c")
    return _r(columns.low_variance_columns(df), 6, "modal_share", "cv")


@query("f10_missing_columns", each(["optional", "status", "price"], "round(avg(({c} IS NULL)::INT), 6) AS share, avg(({c} IS NULL)::INT) > 0.6 AS is_high", ORDERS_SQL))
def f10(spark: SparkSession, d: str) -> DataFrame:
    return _r(columns.missing_columns(orders(spark, d), ["optional", "status", "price"]), 6, "share")


#: SQL of a column's verdict, and of what it is without one.
_MODAL = "(SELECT max(k) / sum(k) FROM (SELECT count(*) AS k FROM t GROUP BY {c})) > 0.95"
_VERDICT = "CASE WHEN '{c}' LIKE '%\\_id' ESCAPE '\\' AND count(DISTINCT {c}) / count({c}) > 0.95 THEN 'id' WHEN avg(({c} IS NULL)::INT) > 0.6 THEN 'high_missing' WHEN count(DISTINCT {c}) <= 1 THEN 'constant' WHEN " + _MODAL
_NUMBER = _VERDICT + " AND abs(stddev_samp({c}) / avg({c})) <= 0.5 THEN 'low_variance'"
_OTHER = _VERDICT + " THEN 'low_variance'"
_LONG = "(avg(length({c})) > 30 AND count(DISTINCT {c}) > 50 AND count(DISTINCT {c}) / count({c}) > 0.5) OR (avg(length({c})) > 50 AND avg(regexp_matches({c}, '\\s')::INT) > 0.5)"


def _judged(name: str, number: str, text: str, date: str) -> str:
    parts = ((["order_id", "custkey", "price", "version", "optional"], number, _NUMBER), (["status", "priority"], text, _OTHER), (["placed"], date, _OTHER))
    return "SELECT * FROM (" + ") UNION ALL SELECT * FROM (".join(each(names, f"{verdict} {rest} END AS {name}", ORDERS_SQL) for names, rest, verdict in parts) + ")"


@query("f11_verdicts", "SELECT * FROM (" + _judged("verdict", "", "", "") + ") WHERE verdict IS NOT NULL")
def f11(spark: SparkSession, d: str) -> DataFrame:
    return columns.verdicts(orders(spark, d), "late")


@query("t04_t05_low_cardinality", each(["late", "version", "order_id"], "bool_and({c} IN (0, 1)) AS is_binary, count(DISTINCT {c}) <= 5 AS is_low_integer", ORDERS_SQL))
def t04(spark: SparkSession, d: str) -> DataFrame:
    return columns.binary_or_low(orders(spark, d), ["late", "version", "order_id"])


@query(
    "t06_text_columns",
    "WITH t AS (SELECT text, lang, source FROM documents) " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(avg(length({c})), 4) AS avg_len, count(DISTINCT {c}) AS n_distinct, (avg(length({c})) > 30 AND count(DISTINCT {c}) > 50 AND count(DISTINCT {c}) / count({c}) > 0.5) OR (avg(length({c})) > 50 AND (avg(regexp_matches({c}, '\\s')::INT) > 0.5 OR avg(regexp_matches({c}, '[.,!?;:]')::INT) > 0.3)) AS is_text FROM t" for c in ("text", "lang", "source")),
)
def t06(spark: SparkSession, d: str) -> DataFrame:
    return _r(columns.text_columns(load(spark, d, "documents"), ["text", "lang", "source"]), 4, "avg_len")


@query("t03_roles", _judged("role", "ELSE 'numerical'", f"WHEN {_LONG} THEN 'text' ELSE 'categorical'", "ELSE 'datetime'"))
def t03(spark: SparkSession, d: str) -> DataFrame:
    r = columns.roles(orders(spark, d), "late")
    listed = [(c, k) for k, names in (("numerical", r.numerical), ("categorical", r.categorical), ("datetime", r.datetime), ("text", r.text), ("id", r.ids), ("constant", r.constant), ("high_missing", r.high_missing), ("low_variance", r.low_variance)) for c in names]
    return spark.createDataFrame(listed, "`column` string, role string")


@query("x32_task_type", "SELECT CASE WHEN count(DISTINCT o_totalprice) / count(o_totalprice) > 0.05 THEN 'regression' ELSE 'classification' END AS price, 'classification' AS status, 'regression' AS placed, 'unsupervised' AS none FROM orders")
def x32(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "orders")
    row = (columns.task_type(df, "o_totalprice"), columns.task_type(df, "o_orderstatus"), columns.task_type(df, "o_orderdate"), columns.task_type(df, None))
    return spark.createDataFrame([row], "price string, status string, placed string, none string")


# Rows


@query("f01_select_columns", f"WITH t AS ({ORDERS_SQL}) SELECT price, status, late FROM t")
def f01(spark: SparkSession, d: str) -> DataFrame:
    return rows.select_columns(orders(spark, d), ["price", "status"], "late")


_DROP = {"status": ["RARE", "P"], "priority": ["5-LOW"]}


@query("f02_drop_values", f"WITH t AS ({ORDERS_SQL}) SELECT order_id, status, priority FROM t WHERE coalesce(status NOT IN ('RARE', 'P'), TRUE) AND coalesce(priority NOT IN ('5-LOW'), TRUE)")
def f02(spark: SparkSession, d: str) -> DataFrame:
    return rows.drop_values(orders(spark, d), _DROP).select("order_id", "status", "priority")


@query("f02_f04_drop_report", f"WITH t AS ({ORDERS_SQL}), h AS (SELECT coalesce(status IN ('RARE', 'P'), FALSE) AS a, coalesce(priority = '5-LOW', FALSE) AS b FROM t) SELECT 'status' AS \"column\", count(*) AS n_rows, count(*) FILTER (a) AS n_removed, count(*) FILTER (NOT (a OR b)) AS n_left, FALSE AS hits_target FROM h UNION ALL SELECT 'priority', count(*), count(*) FILTER (b), count(*) FILTER (NOT (a OR b)), count(*) FILTER (b) > 0 FROM h")
def f04(spark: SparkSession, d: str) -> DataFrame:
    return rows.drop_values_report(orders(spark, d), _DROP, "priority")


@query("f03_guard", f"WITH t AS ({ORDERS_SQL}), g AS (SELECT count(*) AS n FROM t GROUP BY late) SELECT sum(n)::BIGINT AS n_rows, min(n) AS smallest, sum(n) >= 10 AS enough_rows, min(n) >= 2 AS enough_members, min(n) < 4 AS warn FROM g")
def f03(spark: SparkSession, d: str) -> DataFrame:
    return rows.guard(orders(spark, d), "late")


@query("f12_bounds", each(NUMBERS, "round(CASE WHEN quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) < 1e-10 THEN avg({c}) - 3 * stddev_samp({c}) ELSE quantile_cont({c}, 0.25) - 2.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) END, 4) AS low, round(CASE WHEN quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) < 1e-10 THEN avg({c}) + 3 * stddev_samp({c}) ELSE quantile_cont({c}, 0.75) + 2.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) END, 4) AS high", LINES_SQL))
def f12(spark: SparkSession, d: str) -> DataFrame:
    return _r(profile.outlier_bounds(lines(spark, d), NUMBERS), 4, "low", "high")


@query("f13_drop_outliers", _outlier_sql(ORDERS_SQL, "price", 2.5) + " SELECT order_id, price FROM t, b WHERE price IS NULL OR NOT (price < low OR price > high)")
def f13(spark: SparkSession, d: str) -> DataFrame:
    return rows.drop_outliers(orders(spark, d), ["price"]).select("order_id", "price")


@query("f13_drop_outliers_in_turn", _outlier_sql(ORDERS_SQL, "price", 1.5) + " SELECT order_id, price FROM t, b WHERE price BETWEEN low AND high")
def f13b(spark: SparkSession, d: str) -> DataFrame:
    return rows.drop_outliers_in_turn(orders(spark, d), ["price"]).select("order_id", "price")


@query("f14_f15_fill", f"WITH t AS ({ORDERS_SQL}) SELECT order_id, coalesce(price, 0) AS price, coalesce(status, '') AS status FROM t WHERE optional IS NOT NULL")
def f15(spark: SparkSession, d: str) -> DataFrame:
    return rows.final_fill(orders(spark, d).dropna(subset=["optional"])).select("order_id", "price", "status")


@query("f16_validation", each(["quantity", "tax"], "count(*) - count({c}) AS n_null, 0::BIGINT AS n_infinite, abs(avg({c})) < 0.5 AND abs(stddev_pop({c}) - 1) < 0.5 AS scaled", LINES_SQL))
def f16(spark: SparkSession, d: str) -> DataFrame:
    return rows.validation(lines(spark, d), ["quantity", "tax"])


@query("f17_search", "SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%ring%' OR lower(p_type) LIKE '%ring%'")
def f17(spark: SparkSession, d: str) -> DataFrame:
    return rows.search(load(spark, d, "part"), "RING", ["p_name", "p_type"]).select("p_partkey", "p_name")


for _keep, _sql in (("first", "row_number() OVER (PARTITION BY custkey, status ORDER BY order_id) = 1"), ("last", "row_number() OVER (PARTITION BY custkey, status ORDER BY order_id DESC) = 1"), ("none", "count(*) OVER (PARTITION BY custkey, status) = 1")):

    @query(f"w01_dedup_{_keep}", f"WITH t AS ({ORDERS_SQL}) SELECT order_id, custkey, status FROM t QUALIFY {_sql}")
    def w01(spark: SparkSession, d: str, keep: str = _keep) -> DataFrame:
        return rows.drop_duplicates(orders(spark, d).select("order_id", "custkey", "status"), ["custkey", "status"], "order_id", keep)


_RANK = "row_number() OVER (PARTITION BY {by} ORDER BY md5('42|' || order_id), order_id)"


@query(
    "w03_stratified_split",
    f"""WITH t AS ({ORDERS_SQL}), c AS (SELECT priority, count(*) AS n, floor(count(*) * 0.2) AS f, count(*) * 0.2 - floor(count(*) * 0.2) AS rest FROM t GROUP BY 1),
    q AS (SELECT priority, f + (row_number() OVER (ORDER BY rest DESC, priority) <= ceil((SELECT count(*) FROM t) * 0.2) - (SELECT sum(f) FROM c))::INT AS take FROM c),
    r AS (SELECT *, {_RANK.format(by='priority')} AS k FROM t) SELECT order_id, priority, CASE WHEN k <= take THEN 'test' ELSE 'train' END AS split FROM r JOIN q USING (priority)""",
)
def w03(spark: SparkSession, d: str) -> DataFrame:
    return rows.train_test_split(orders(spark, d), "order_id", "priority").select("order_id", "priority", "split")


@query("w03_split", f"WITH t AS ({ORDERS_SQL}) SELECT order_id, CASE WHEN row_number() OVER (ORDER BY md5('42|' || order_id)) <= ceil((SELECT count(*) FROM t) * 0.2) THEN 'test' ELSE 'train' END AS split FROM t")
def w03b(spark: SparkSession, d: str) -> DataFrame:
    return rows.train_test_split(orders(spark, d), "order_id").select("order_id", "split")


@query("w04_folds", f"WITH t AS ({ORDERS_SQL}) SELECT order_id, (ntile(5) OVER (PARTITION BY late ORDER BY md5('42|' || order_id)) - 1)::INT AS fold FROM t")
def w04(spark: SparkSession, d: str) -> DataFrame:
    return rows.folds(orders(spark, d), "order_id", "late").select("order_id", "fold")


@query("j04_exclude", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def j04(spark: SparkSession, d: str) -> DataFrame:
    ids = load(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return rows.exclude(load(spark, d, "orders").select("o_orderkey", "o_custkey"), ids, "o_orderkey")


@query("s09_preview", "SELECT o_orderkey, o_custkey, 4 AS hidden_columns FROM orders ORDER BY o_orderkey LIMIT 10")
def s09(spark: SparkSession, d: str) -> DataFrame:
    return rows.preview(load(spark, d, "orders"), "o_orderkey", 10, 2)


@query("s09_preview_splits", f"WITH t AS ({ORDERS_SQL}), s AS (SELECT order_id, CASE WHEN row_number() OVER (ORDER BY md5('42|' || order_id)) <= ceil((SELECT count(*) FROM t) * 0.2) THEN 'test' ELSE 'train' END AS split FROM t) SELECT order_id, split FROM s QUALIFY row_number() OVER (PARTITION BY split ORDER BY order_id) <= CASE WHEN split = 'train' THEN 8 ELSE 2 END")
def s09b(spark: SparkSession, d: str) -> DataFrame:
    return rows.preview_splits(rows.train_test_split(orders(spark, d), "order_id").select("order_id", "split"), "order_id")


@query("u04_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def u04(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").dropDuplicates()


_WANTED = ["order_id", "custkey", "price", "state", "placed", "nothing"]


@query(
    "u06_schema_difference",
    f"WITH t AS (SELECT *, CAST(NULL AS INT) AS nothing FROM ({ORDERS_SQL})), h AS (" + " UNION ALL ".join(f"SELECT '{c}' AS c FROM t HAVING count({c}) > 0" for c in [*_ALL, "nothing"]) + "), w AS (SELECT unnest([" + ", ".join(f"'{c}'" for c in _WANTED) + "]) AS c) SELECT 'missing' AS kind, c AS \"column\" FROM w WHERE c NOT IN (SELECT c FROM h) UNION ALL SELECT 'extra', c FROM h WHERE c NOT IN (SELECT c FROM w)",
)
def u06(spark: SparkSession, d: str) -> DataFrame:
    return rows.schema_difference(orders(spark, d).withColumn("nothing", F.lit(None).cast("int")), _WANTED)


@query("f16_output_checks", f"WITH t AS ({LINES_SQL}) SELECT 'numeric' AS \"check\", TRUE AS passed, 'error' AS severity UNION ALL SELECT 'no_nulls', count(quantity) = count(*) AND count(tax) = count(*), 'error' FROM t UNION ALL SELECT 'finite', TRUE, 'error' UNION ALL SELECT 'width', FALSE, 'error' UNION ALL SELECT 'no_ids', FALSE, 'warning' UNION ALL SELECT 'scaled', (abs(avg(quantity)) < 0.5 AND abs(stddev_pop(quantity) - 1) < 0.5) OR (abs(avg(tax)) < 0.5 AND abs(stddev_pop(tax) - 1) < 0.5), 'info' FROM t")
def f16b(spark: SparkSession, d: str) -> DataFrame:
    return rows.output_checks(lines(spark, d).select("quantity", "tax"), ["quantity", "tax", "order_id"])


@query("l02_top_missing", f"WITH t AS ({ORDERS_SQL}), m AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round((count(*) - count({c})) * 100.0 / count(*), 2) AS pct_missing FROM t" for c in _ALL) + ") SELECT * FROM m WHERE pct_missing > 0 ORDER BY pct_missing DESC, 1 LIMIT 10")
def l02_missing(spark: SparkSession, d: str) -> DataFrame:
    return catalog.top(profile.missing(orders(spark, d)).select("column", "pct_missing"), "pct_missing", 10, 0.0)


@query("l02_top_outliers", "WITH m AS (" + " UNION ALL ".join(f"({_outlier_sql(ORDERS_SQL, c, 1.5)} SELECT '{c}' AS \"column\", count(*) FILTER ({c} < low OR {c} > high) AS n_outliers FROM t, b)" for c in ("price", "optional", "custkey")) + ") SELECT * FROM m WHERE n_outliers > 0 ORDER BY n_outliers DESC, 1 LIMIT 10")
def l02_outliers(spark: SparkSession, d: str) -> DataFrame:
    return catalog.top(profile.outliers(orders(spark, d), ["price", "optional", "custkey"], 1.5).select("column", "n_outliers"), "n_outliers", 10, 0)


@query("l02_top_cardinality", f"WITH t AS ({ORDERS_SQL}) SELECT 'status' AS \"column\", count(DISTINCT status) AS n_distinct FROM t UNION ALL SELECT 'priority', count(DISTINCT priority) FROM t")
def l02_cardinality(spark: SparkSession, d: str) -> DataFrame:
    return catalog.top(profile.categorical(orders(spark, d), ["status", "priority"]).select("column", "n_distinct"), "n_distinct", 10)


@query("l02_top_skew", f"WITH t AS ({ORDERS_SQL}), m AS (SELECT 'price' AS \"column\", round(skewness(price), 4) AS skewness FROM t UNION ALL SELECT 'late', round(skewness(late), 4) FROM t UNION ALL SELECT 'custkey', round(skewness(custkey), 4) FROM t) SELECT * FROM m WHERE abs(skewness) > 0.5 ORDER BY abs(skewness) DESC LIMIT 10")
def l02_skew(spark: SparkSession, d: str) -> DataFrame:
    return catalog.top(_r(profile.moments(orders(spark, d), ["price", "late", "custkey"]).select("column", "skewness"), 4, "skewness"), "skewness", 10, 0.5)
