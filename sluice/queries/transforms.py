"""Clean-up, fitted transforms and correlated features (N, T, X and C operators)."""

from __future__ import annotations

import uuid
from functools import reduce
from itertools import combinations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize, scalar
from ..operators import correlate, transforms
from ..plans import stages
from ..session import shared_dir
from . import load, query
from .inputs import LINES_SQL, NUMBERS, ORDERS_SQL, lines, orders

RAW = (
    "o_orderkey AS order_id",
    "CASE WHEN o_orderkey % 10 = 0 THEN ' N/A ' WHEN o_orderkey % 10 = 1 THEN '?' WHEN o_orderkey % 10 = 2 THEN '-1' ELSE o_orderstatus END AS status",
    "replace(CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING), '.', ',') AS price",
    "CASE WHEN o_orderkey % 8 = 0 THEN 'none' ELSE CAST(o_custkey AS STRING) END AS customer",
    "CASE WHEN o_orderkey % 2 = 0 THEN '18.00.00' ELSE '07.30.00' END AS clock",
)
RAW_SQL = "SELECT " + ", ".join(RAW).replace("STRING", "VARCHAR") + " FROM orders"


def raw(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").selectExpr(*RAW)


def _r(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(f"`{n}`"), digits) for n in names})


@query("n01_null_tokens", f"WITH t AS ({RAW_SQL}) SELECT order_id, CASE WHEN trim(status) IN ('N/A', '?') THEN NULL ELSE status END AS status, CASE WHEN customer = 'none' THEN NULL ELSE customer END AS customer FROM t")
def n01(spark: SparkSession, d: str) -> DataFrame:
    return normalize.normalise(raw(spark, d)).select("order_id", "status", "customer")


@query("n01_sentinels", f"WITH t AS ({RAW_SQL}) SELECT order_id, CASE WHEN trim(status) IN ('N/A', '?', '-1') THEN NULL ELSE status END AS status FROM t")
def n01b(spark: SparkSession, d: str) -> DataFrame:
    return normalize.normalise(raw(spark, d), numeric_sentinels=True).select("order_id", "status")


@query("n02_finite", "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN value END AS value FROM events")
def n02(spark: SparkSession, d: str) -> DataFrame:
    odd = F.when(F.col("event_id") % 6 == 0, F.lit(float("nan"))).when(F.col("event_id") % 3 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    return normalize.normalise(load(spark, d, "events").select("event_id", odd.alias("value")))


@query(
    "n03_n05_t01_formats",
    f"WITH t AS ({RAW_SQL}) SELECT 'price' AS \"column\", round(avg(regexp_full_match(price, '-?\\d+,\\d+')::INT), 6) AS comma, round(avg((try_cast(price AS DOUBLE) IS NOT NULL)::INT), 6) AS number, 0.0 AS dotted FROM t UNION ALL SELECT 'customer', 0.0, round(avg((try_cast(customer AS DOUBLE) IS NOT NULL)::INT), 6), 0.0 FROM t UNION ALL SELECT 'clock', 0.0, 0.0, avg(1.0) FROM t",
)
def n03(spark: SparkSession, d: str) -> DataFrame:
    return _r(normalize.format_ratios(raw(spark, d), ["price", "customer", "clock"]).select("column", "comma", "number", "dotted"), 6, "comma", "number")


@query("n03_n04_t01_infer", f"WITH t AS ({RAW_SQL}) SELECT order_id, replace(price, ',', '.')::DOUBLE AS price, try_cast(customer AS DOUBLE) AS customer, replace(clock, '.', ':') AS clock FROM t")
def n03b(spark: SparkSession, d: str) -> DataFrame:
    return normalize.infer_types(raw(spark, d), ["price", "customer", "clock"])[0].select("order_id", "price", "customer", "clock")


@query("n05_n06_dates", "SELECT o_orderkey, o_orderdate AS placed, o_orderdate AS european FROM orders")
def n05(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("placed"), F.date_format("o_orderdate", "dd-MM-yyyy").alias("european"))
    out = normalize.infer_types(df, ["placed", "european"])[0]
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("placed", "european")})


# Transforms


@query("x01_mean", f"WITH t AS ({LINES_SQL}), m AS (SELECT avg(quantity) AS a, avg(discount) AS b FROM t) SELECT price, round(coalesce(quantity, a), 6) AS quantity, round(coalesce(discount, b), 6) AS discount FROM t, m")
def x01(spark: SparkSession, d: str) -> DataFrame:
    df = lines(spark, d).select("price", "quantity", "discount")
    return _r(transforms.fit_impute(df, ["quantity", "discount"], "mean").transform(df), 6, "quantity", "discount")


@query("x01_median", f"WITH t AS ({LINES_SQL}), m AS (SELECT quantile_cont(quantity, 0.5) AS a FROM t) SELECT price, coalesce(quantity, a) AS quantity FROM t, m")
def x01b(spark: SparkSession, d: str) -> DataFrame:
    df = lines(spark, d).select("price", "quantity")
    return transforms.fit_impute(df, ["quantity"], "median").transform(df)


@query("x02_mode", f"WITH t AS ({LINES_SQL}), m AS (SELECT status AS s FROM t WHERE status IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT price, coalesce(status, s) AS status FROM t, m")
def x02(spark: SparkSession, d: str) -> DataFrame:
    df = lines(spark, d).select("price", "status")
    return transforms.fit_impute(df, ["status"], "mode").transform(df)


@query("x03_constant", f"WITH t AS ({LINES_SQL}) SELECT price, coalesce(quantity, -999) AS quantity, coalesce(status, 'MISSING') AS status FROM t")
def x03(spark: SparkSession, d: str) -> DataFrame:
    df = lines(spark, d).select("price", "quantity", "status")
    return transforms.fit_impute(df, ["quantity", "status"], "constant", {"quantity": -999, "status": "MISSING"}).transform(df)


@query(
    "x04_cap",
    f"WITH t AS ({ORDERS_SQL}), b AS (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM t) SELECT order_id, round(CASE WHEN price IS NOT NULL THEN least(greatest(price, q1 - 2.5 * (q3 - q1)), q3 + 2.5 * (q3 - q1)) END, 4) AS price FROM t, b",
)
def x04(spark: SparkSession, d: str) -> DataFrame:
    df = orders(spark, d).select("order_id", "price")
    return _r(transforms.fit_cap(df, ["price"]).transform(df), 4, "price")


@query("x05_indicators", f"WITH t AS ({LINES_SQL}) SELECT price, (quantity IS NULL)::INT AS missingindicator_quantity, (discount IS NULL)::INT AS missingindicator_discount FROM t")
def x05(spark: SparkSession, d: str) -> DataFrame:
    df = lines(spark, d)
    return transforms.fit_indicators(df, NUMBERS).transform(df).select("price", "missingindicator_quantity", "missingindicator_discount")


@query("x06_power_half", "SELECT event_id, round((sqrt(value + 1) - 1) / 0.5, 6) AS value FROM events WHERE value >= 0 UNION ALL SELECT event_id, round(-(pow(1 - value, 1.5) - 1) / 1.5, 6) FROM events WHERE value < 0")
def x06(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("event_id", F.round(scalar.yeo_johnson(F.col("value"), 0.5), 6).alias("value"))


@query("x06_power_fit")
def x06b(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "events").select("event_id", "value")
    return transforms.fit_power(df, ["value"]).transform(df)


for _how, _a, _b in (("standard", "avg(price)", "stddev_pop(price)"), ("minmax", "min(price)", "max(price) - min(price)"), ("robust", "quantile_cont(price, 0.5)", "quantile_cont(price, 0.75) - quantile_cont(price, 0.25)")):

    @query(f"x07_x09_scale_{_how}", f"WITH t AS ({ORDERS_SQL}), s AS (SELECT {_a} AS a, {_b} AS b FROM t) SELECT order_id, round((price - a) / b, 6) AS price FROM t, s")
    def x07(spark: SparkSession, d: str, how: str = _how) -> DataFrame:
        df = orders(spark, d).select("order_id", "price")
        return _r(transforms.fit_scale(df, ["price"], how).transform(df), 6, "price")


@query("x10_rare", f"WITH t AS ({ORDERS_SQL}), c AS (SELECT status, count(*) / (SELECT count(status) FROM t) AS s FROM t WHERE status IS NOT NULL GROUP BY 1) SELECT order_id, CASE WHEN c.s < 0.012 THEN '__OTHER__' ELSE t.status END AS status FROM t LEFT JOIN c USING (status)")
def x10(spark: SparkSession, d: str) -> DataFrame:
    df = orders(spark, d).select("order_id", "status")
    return transforms.fit_rare(df, ["status"], 0.012).transform(df)


@query(
    "x01_x13_pipeline",
    f"""WITH t AS ({ORDERS_SQL}), m AS (SELECT quantile_cont(price, 0.5) AS med FROM t WHERE order_id % 4 <> 0),
    mo AS (SELECT status AS s FROM t WHERE order_id % 4 <> 0 AND status IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
    f AS (SELECT order_id, coalesce(price, med) AS price, coalesce(status, s) AS status, priority FROM t, m, mo),
    b AS (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM f WHERE order_id % 4 <> 0),
    c AS (SELECT order_id, least(greatest(price, q1 - 2.5 * (q3 - q1)), q3 + 2.5 * (q3 - q1)) AS price, status, priority FROM f, b),
    s AS (SELECT avg(price) AS a, stddev_pop(price) AS d FROM c WHERE order_id % 4 <> 0),
    k AS (SELECT status, count(*) / (SELECT count(*) FROM c WHERE order_id % 4 <> 0) AS share FROM c WHERE order_id % 4 <> 0 GROUP BY 1),
    r AS (SELECT order_id, price, priority, CASE WHEN share >= 0.012 THEN status ELSE '__OTHER__' END AS status FROM c LEFT JOIN k USING (status)),
    o AS (SELECT status, dense_rank() OVER (ORDER BY status) - 1 AS code FROM (SELECT DISTINCT status FROM r WHERE order_id % 4 <> 0))
    SELECT order_id, round((price - a) / d, 6) AS price, coalesce(code, -1)::DOUBLE AS status, """
    + ", ".join(f"(priority = '{v}')::INT::DOUBLE AS \"priority_{v}\"" for v in ("2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))
    + " FROM r LEFT JOIN o USING (status), s WHERE order_id % 4 = 0",
)
def x01c(spark: SparkSession, d: str) -> DataFrame:
    """Held-out orders by a ``pyspark.ml`` pipeline of the library's estimators, fitted on the others, saved and loaded."""
    df = orders(spark, d).select("order_id", "price", "status", "priority")
    fitted = Pipeline(
        stages=[
            stages.ColumnImputer(inputCols=["price"]),
            stages.ColumnImputer(inputCols=["status"], strategy="mode"),
            stages.OutlierCapper(inputCols=["price"]),
            stages.ColumnScaler(inputCols=["price"]),
            stages.RareGrouper(inputCols=["status"], share=0.012),
            stages.OrdinalCodes(inputCols=["status"]),
            stages.IndicatorColumns(inputCols=["priority"], dropFirst=True),
        ]
    ).fit(df.where("order_id % 4 <> 0"))
    path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    fitted.write().save(path)
    return _r(PipelineModel.load(path).transform(df.where("order_id % 4 = 0")), 6, "price")


_HOT = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _hot_sql(values: list[str]) -> str:
    return "SELECT o_orderkey, " + ", ".join(f"(o_orderpriority = '{v}')::INT::DOUBLE AS \"o_orderpriority_{v}\"" for v in values) + " FROM orders"


@query("x11_one_hot", _hot_sql(_HOT))
def x11(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return transforms.fit_one_hot(df, ["o_orderpriority"]).transform(df)


@query("x12_one_hot_drop_first", _hot_sql(_HOT[1:]))
def x12(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return transforms.fit_one_hot(df, ["o_orderpriority"], drop_first=True).transform(df)


@query("x13_ordinal", "WITH k AS (SELECT p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS code FROM (SELECT DISTINCT p_brand FROM part WHERE p_partkey % 2 = 0)) SELECT p_partkey, coalesce(code, -1)::DOUBLE AS p_brand FROM part LEFT JOIN k USING (p_brand)")
def x13(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "part").select("p_partkey", "p_brand")
    return transforms.fit_ordinal(df.where("p_partkey % 2 = 0"), ["p_brand"]).transform(df)


@query("x14_ordinal_minmax", "WITH k AS (SELECT p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS code FROM (SELECT DISTINCT p_brand FROM part)), m AS (SELECT max(code) AS hi FROM k) SELECT p_partkey, round(code / hi, 6) AS p_brand FROM part JOIN k USING (p_brand), m")
def x14(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "part").select("p_partkey", "p_brand")
    coded = transforms.fit_ordinal(df, ["p_brand"]).transform(df)
    return _r(transforms.fit_scale(coded, ["p_brand"], "minmax").transform(coded), 6, "p_brand")


@query("x15_j10_encode_decode", "SELECT p_partkey, (dense_rank() OVER (ORDER BY p_type) - 1)::DOUBLE AS code, p_type AS decoded FROM part")
def x15(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "part").select("p_partkey", F.col("p_type").alias("code"))
    fitted = transforms.fit_ordinal(df, ["code"])
    return transforms.decode(fitted.transform(df), "code", fitted, "code")


@query("x15_dictionary", "SELECT p_type AS value, (row_number() OVER (ORDER BY p_type) - 1)::INT AS code FROM (SELECT DISTINCT p_type FROM part)")
def x15b(spark: SparkSession, d: str) -> DataFrame:
    return transforms.dictionary(load(spark, d, "part"), "p_type")


@query("x41_encoding_report", "SELECT 'p_type' AS \"column\", p_type AS value, (row_number() OVER (ORDER BY p_type) - 1)::INT AS code FROM (SELECT DISTINCT p_type FROM part)")
def x41(spark: SparkSession, d: str) -> DataFrame:
    return transforms.encoding_report(transforms.fit_ordinal(load(spark, d, "part"), ["p_type"]), spark)


_STOP = ", ".join(f"'{w}'" for w in transforms.STOP_WORDS.split())


@query(
    "x16_tfidf",
    f"""WITH w AS (SELECT conv_id * 1000 + turn AS key, list_filter(regexp_extract_all(lower(strip_accents(text)), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: x NOT IN ({_STOP})) AS w FROM conversations),
    t AS (SELECT key, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w),
    c AS (SELECT key, term, count(*) AS tf FROM t GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM conversations),
    v AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM c GROUP BY 1 HAVING count(*) >= 2 AND count(*) <= 0.95 * (SELECT n FROM n) ORDER BY cf DESC, term LIMIT 5000),
    x AS (SELECT key, term, tf * (ln((1.0 + n) / (1.0 + df)) + 1) AS w FROM c JOIN v USING (term), n)
    SELECT key, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY key)), 6) AS weight FROM x""",
)
def x16(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), "text")
    return _r(transforms.tfidf(df, "key", "text"), 6, "weight")


def _reloaded(spark: SparkSession, *steps: transforms.Fitted) -> transforms.Chain:
    """The steps after they were saved and loaded."""
    path = f"{shared_dir(spark)}/chain-{uuid.uuid4().hex}"
    transforms.Chain(list(steps)).save(spark, path)
    return transforms.Chain.load(spark, path)


@query(
    "x16_tfidf_fitted",
    f"""WITH w AS (SELECT conv_id * 1000 + turn AS key, conv_id % 5 = 0 AS held, list_filter(regexp_extract_all(lower(strip_accents(text)), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: x NOT IN ({_STOP})) AS w FROM conversations),
    t AS (SELECT key, held, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w),
    c AS (SELECT key, held, term, count(*) AS tf FROM t GROUP BY 1, 2, 3), n AS (SELECT count(*) AS n FROM w WHERE NOT held),
    v AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM c WHERE NOT held GROUP BY 1 HAVING count(*) >= 2 AND count(*) <= 0.95 * (SELECT n FROM n) ORDER BY cf DESC, term LIMIT 5000),
    x AS (SELECT key, term, tf * (ln((1.0 + n) / (1.0 + df)) + 1) AS w FROM c JOIN v USING (term), n WHERE held)
    SELECT key, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY key)), 6) AS weight FROM x""",
)
def x16b(spark: SparkSession, d: str) -> DataFrame:
    """Held-out turns by the vocabulary and rarities of the others, from a saved chain."""
    from pyspark.ml.functions import vector_to_array

    df = load(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), "text", (F.col("conv_id") % 5 == 0).alias("held"))
    fitted = transforms.fit_text(df.where("not held"), "key", ["text"])
    held = _reloaded(spark, fitted).transform(df.where("held"))
    weights = held.select("key", F.posexplode(vector_to_array("text_tfidf")).alias("at", "weight")).where("weight <> 0")
    return _r(weights.join(F.broadcast(transforms.terms_of(fitted, spark, "text")), "at").select("key", "term", "weight"), 6, "weight")  # 5000 rows


@query("x17_dates_tree", "SELECT event_id, year(ts)::INT AS ts_year, month(ts)::INT AS ts_month, day(ts)::INT AS ts_day, (isodow(ts) - 1)::INT AS ts_dayofweek, quarter(ts)::INT AS ts_quarter, (isodow(ts) >= 6)::INT AS ts_is_weekend, hour(ts)::INT AS ts_hour, (hour(ts) BETWEEN 9 AND 17)::INT AS ts_is_business_hours FROM events")
def x17(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "events").select("event_id", "ts")
    return transforms.fit_dates(df, ["ts"], "tree").transform(df)


@query("x18_dates_linear", "SELECT o_orderkey, (year(o_orderdate) - (SELECT min(year(o_orderdate)) FROM orders))::INT AS o_orderdate_years_since_min, month(o_orderdate)::INT AS o_orderdate_month, day(o_orderdate)::INT AS o_orderdate_day, dayname(o_orderdate) AS o_orderdate_weekday FROM orders")
def x18(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return transforms.fit_dates(df, ["o_orderdate"], "linear").transform(df)


@query(
    "x19_dates_distance",
    "WITH m AS (SELECT min(o_orderdate) AS m FROM orders) SELECT o_orderkey, " + ", ".join(f"round({f}({v} * (2 * pi() / {p})), 6) AS o_orderdate_{n}_{f}" for n, v, p in (("month", "month(o_orderdate)", 12), ("day", "day(o_orderdate)", 31), ("weekday", "(isodow(o_orderdate) - 1)", 7)) for f in ("sin", "cos")) + ", floor((epoch(o_orderdate) - epoch(m)) / 86400)::BIGINT AS o_orderdate_days_since_start FROM orders, m",
)
def x19(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "orders").select("o_orderkey", "o_orderdate")
    out = transforms.fit_dates(df, ["o_orderdate"], "distance").transform(df)
    return _r(out, 6, *[c for c in out.columns if c.endswith(("_sin", "_cos"))])


@query("x20_date_kinds", "SELECT count(DISTINCT o_orderdate::DATE) > 1 AS has_days, count(DISTINCT hour(o_orderdate) * 60 + minute(o_orderdate)) > 1 AS has_times FROM orders")
def x20(spark: SparkSession, d: str) -> DataFrame:
    state = transforms.fit_dates(load(spark, d, "orders"), ["o_orderdate"]).state["columns"]["o_orderdate"]
    return spark.createDataFrame([(state["days"], state["times"])], "has_days boolean, has_times boolean")


@query("x21_date_target", "SELECT o_orderkey, epoch(o_orderdate)::DOUBLE AS o_orderdate FROM orders")
def x21(spark: SparkSession, d: str) -> DataFrame:
    return transforms.date_target(load(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate")


@query("x26_variance", "SELECT l_orderkey, l_quantity, l_extendedprice FROM lineitem")
def x26(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return transforms.fit_variance(df, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]).transform(df)


# Correlated features

_PARTS = ("p_partkey", "p_size AS size_mean", "p_size * 2 + p_partkey % 3 AS size_worst", "p_size * 3 + p_partkey % 5 AS size_se", "p_retailprice AS price")
_SIZES = ["size_mean", "size_worst", "size_se", "price"]
_PART_SQL = "SELECT " + ", ".join(_PARTS) + " FROM part"
_PAIR_SQL = f"t AS ({_PART_SQL}), p AS (" + " UNION ALL ".join(f"SELECT '{a}' AS f1, '{b}' AS f2, corr({a}, {b}) AS r FROM t" for a, b in combinations(_SIZES, 2)) + ")"
#: How two names are related.
_RELATED = """CASE WHEN f1 LIKE '%year%' AND f2 LIKE '%year%' THEN 'temporal_difference'
    WHEN (f1 LIKE '%area%' AND f2 LIKE '%cars%') OR (f2 LIKE '%area%' AND f1 LIKE '%cars%') THEN 'area_per_unit'
    WHEN (f1 LIKE '%area%' AND f2 LIKE '%frontage%') OR (f2 LIKE '%area%' AND f1 LIKE '%frontage%') THEN 'area_ratio'
    WHEN (f1 LIKE '%room%' AND f2 LIKE '%room%') OR (f1 LIKE '%bed%' AND f2 LIKE '%room%') OR (f1 LIKE '%room%' AND f2 LIKE '%bed%') THEN 'count_difference'
    WHEN CASE WHEN f1 LIKE '%\\_%' ESCAPE '\\' THEN split_part(f1, '_', 1) ELSE left(f1, 4) END = CASE WHEN f2 LIKE '%\\_%' ESCAPE '\\' THEN split_part(f2, '_', 1) ELSE left(f2, 4) END
      AND length(CASE WHEN f1 LIKE '%\\_%' ESCAPE '\\' THEN split_part(f1, '_', 1) ELSE left(f1, 4) END) > 2 THEN 'same_category' ELSE 'none' END"""


@query(
    "x22_j11_a18_groups",
    f"""WITH RECURSIVE {_PAIR_SQL}, e AS (SELECT f1 AS a, f2 AS b FROM p WHERE abs(r) >= 0.9 UNION SELECT f2, f1 FROM p WHERE abs(r) >= 0.9),
    g AS (SELECT a AS c, a AS m FROM e UNION SELECT e.b, g.m FROM g JOIN e ON e.a = g.c), h AS (SELECT c, min(m) AS head FROM g GROUP BY 1),
    v AS ({" UNION ALL ".join(f"SELECT '{c}' AS c, abs(stddev_samp({c}) / avg({c})) AS cv FROM t" for c in _SIZES)}),
    b AS (SELECT head, arg_max(c, (cv, -ascii(c), c)) AS best, count(*)::INT AS n FROM h JOIN v USING (c) GROUP BY 1)
    SELECT c AS "column", head AS "group", best AS representative, n AS group_size FROM h JOIN b USING (head)""",
)
def x22(spark: SparkSession, d: str) -> DataFrame:
    return correlate.representatives(load(spark, d, "part").selectExpr(*_PARTS), _SIZES)


@query("x22_pairs", f"WITH {_PAIR_SQL} SELECT f1, f2, round(r, 6) AS r, {_RELATED} AS relation FROM p WHERE abs(r) >= 0.9")
def x22b(spark: SparkSession, d: str) -> DataFrame:
    return _r(correlate.pair_report(load(spark, d, "part").selectExpr(*_PARTS), _SIZES), 6, "r")


_NAMES = "SELECT DISTINCT p_type AS f1, p_brand AS f2 FROM part UNION ALL SELECT DISTINCT 'lot_area_' || lower(p_brand), 'lot_frontage_' || lower(p_brand) FROM part UNION ALL SELECT DISTINCT 'year_' || p_size, 'built_year_' || p_size FROM part UNION ALL SELECT DISTINCT 'bed' || p_size, 'rooms' FROM part UNION ALL SELECT DISTINCT 'garage_area', 'garage_cars' || p_size FROM part"


@query("x23_relations", f"SELECT f1, f2, {_RELATED.replace('f1 ', 'lower(f1) ').replace('f2 ', 'lower(f2) ').replace('(f1,', '(lower(f1),').replace('(f2,', '(lower(f2),')} AS relation FROM ({_NAMES})")
def x23(spark: SparkSession, d: str) -> DataFrame:
    part, low = load(spark, d, "part"), F.lower("p_brand")
    size = F.col("p_size").cast("string")
    named = [(F.col("p_type"), F.col("p_brand")), (F.concat(F.lit("lot_area_"), low), F.concat(F.lit("lot_frontage_"), low)), (F.concat(F.lit("year_"), size), F.concat(F.lit("built_year_"), size)), (F.concat(F.lit("bed"), size), F.lit("rooms")), (F.lit("garage_area"), F.concat(F.lit("garage_cars"), size))]
    pairs = reduce(DataFrame.union, [part.select(a.alias("f1"), b.alias("f2")).distinct() for a, b in named])
    return pairs.withColumn("relation", correlate.relation(F.col("f1"), F.col("f2")))


@query("x24_reduce", "SELECT p_partkey, p_size AS size_mean, p_retailprice AS price FROM part")
def x24(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "part").selectExpr(*_PARTS)
    return correlate.reduce_features(df, correlate.pair_report(df, _SIZES), "unknown")[0]


_ROOMS = ("p_partkey", "p_size AS rooms_above", "p_size + p_partkey % 2 AS bedrooms", "p_size * 10 AS lot_area", "p_size * 5 + p_partkey % 3 AS lot_frontage", "p_size * 4 AS age_mean", "p_size * 4 AS age_worst")
_ROOM_NAMES = ["rooms_above", "bedrooms", "lot_area", "lot_frontage", "age_mean", "age_worst"]


@query(
    "x24_reduce_linear",
    "WITH t AS (SELECT " + ", ".join(_ROOMS) + " FROM part) SELECT p_partkey, rooms_above, bedrooms, lot_area, lot_frontage, age_mean, rooms_above - bedrooms AS rooms_above_minus_bedrooms, round(lot_area / CASE WHEN lot_frontage = 0 THEN 1 ELSE lot_frontage END, 6) AS lot_area_per_lot_frontage FROM t",
)
def x24b(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "part").selectExpr(*_ROOMS)
    return _r(correlate.reduce_features(df, correlate.pair_report(df, _ROOM_NAMES), "linear")[0], 6, "lot_area_per_lot_frontage")


@query(
    "x24_derived_fitted",
    "WITH t AS (SELECT " + ", ".join(_ROOMS) + " FROM part WHERE p_partkey % 4 = 0) SELECT p_partkey, rooms_above, bedrooms, lot_area, lot_frontage, age_mean, rooms_above - bedrooms AS rooms_above_minus_bedrooms, round(lot_area / CASE WHEN lot_frontage = 0 THEN 1 ELSE lot_frontage END, 6) AS lot_area_per_lot_frontage FROM t",
)
def x24e(spark: SparkSession, d: str) -> DataFrame:
    """Differences and ratios that were chosen on other rows, from a saved chain."""
    df = load(spark, d, "part").selectExpr(*_ROOMS)
    train = df.where("p_partkey % 4 <> 0")
    actions = correlate.pair_actions(train.columns, correlate.pair_report(train, _ROOM_NAMES), "linear")
    derive = transforms.fit_derive([(c, what, a, b) for what, c, a, b in actions if what != "drop"])
    chain = _reloaded(spark, derive, transforms.fit_drop([c for what, c, _, _ in actions if what == "drop"]))
    return _r(chain.transform(df.where("p_partkey % 4 = 0")), 6, "lot_area_per_lot_frontage")


@query("x24_reduce_distance", "WITH t AS (SELECT " + ", ".join(_ROOMS) + " FROM part) SELECT p_partkey, rooms_above, bedrooms, lot_area, lot_frontage, age_mean FROM t")
def x24c(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "part").selectExpr(*_ROOMS)
    return correlate.reduce_features(df, correlate.pair_report(df, _ROOM_NAMES), "distance")[0]


@query("x24_reduce_tree", "SELECT " + ", ".join(_ROOMS) + " FROM part")
def x24d(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "part").selectExpr(*_ROOMS)
    return correlate.reduce_features(df, correlate.pair_report(df, _ROOM_NAMES), "tree")[0]


# Expressions


@query(
    "c_text_functions",
    "SELECT p_partkey, regexp_replace(trim('  ' || p_name || '   x '), '\\s+', ' ', 'g') AS squeezed, lower(p_brand) AS low, starts_with(p_name, 'r') AS starts, contains(p_name, 'in') AS has, length(p_name)::INT AS n, split_part(p_brand, '#', 2) AS number, CASE WHEN length(p_name) > 8 THEN left(p_name, 5) || '...' ELSE p_name END AS short FROM part",
)
def c_text(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("p_name")
    return load(spark, d, "part").select(
        "p_partkey", scalar.squeeze(F.concat(F.lit("  "), name, F.lit("   x "))).alias("squeezed"), F.lower("p_brand").alias("low"), F.startswith(name, F.lit("r")).alias("starts"),
        F.contains(name, F.lit("in")).alias("has"), F.length(name).alias("n"), F.split_part("p_brand", F.lit("#"), F.lit(2)).alias("number"), scalar.shorten(name, 8).alias("short"),
    )


@query(
    "c_number_functions",
    "SELECT l_orderkey, l_linenumber, l_quantity, round(CASE WHEN l_linenumber % 3 = 0 THEN l_quantity ELSE l_quantity / (l_linenumber % 3) END, 6) AS ratio, least(greatest(l_quantity, 5), 40)::DOUBLE AS clipped, round(l_extendedprice, 1) AS rounded FROM lineitem",
)
def c_number(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.round(scalar.ratio(q, F.col("l_linenumber") % 3), 6).alias("ratio"), scalar.clip(q, 5.0, 40.0).alias("clipped"), F.round("l_extendedprice", 1).alias("rounded"))


@query("c_json_functions", "SELECT event_id, (props->>'$.k')::INT AS k, value FROM events")
def c_json(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), "value")


@query("c_time_functions", "SELECT event_id, epoch_us(ts) / 1e6 AS seconds, (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::INT AS of_day, dayname(ts) AS weekday FROM events")
def c_time(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("ts")
    return load(spark, d, "events").select("event_id", scalar.unix_seconds(ts).alias("seconds"), scalar.seconds_of_day(ts).alias("of_day"), F.date_format(ts, "EEEE").alias("weekday"))


@query("c_base_names", "SELECT DISTINCT p_type, regexp_replace(lower(p_type || '_mean'), '_(mean|se|worst|std|min|max|median)$', '') AS base, upper(left(p_type, 1)) || lower(substr(p_type, 2)) || ' Mean' AS title FROM part")
def c_base(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat("p_type", F.lit("_mean"))
    return load(spark, d, "part").select("p_type", scalar.base_name(name).alias("base"), scalar.title(name).alias("title")).distinct()
