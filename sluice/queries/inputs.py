"""Inputs that several queries share: driver tables, with nulls, duplicates and skew put in by key arithmetic.

Each is a list of expressions that Spark and SQL read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import load

#: lineitem with nulls, by expression.
LINES = (
    "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS quantity",
    "l_extendedprice AS price",
    "CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_discount END AS discount",
    "l_tax AS tax",
    "l_returnflag AS flag",
    "CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE l_linestatus END AS status",
)
NUMBERS = ["quantity", "price", "discount", "tax"]
#: orders with a skewed category, outliers and a price in several text formats.
ORDERS = (
    "o_orderkey AS order_id",
    "o_custkey AS custkey",
    "CASE WHEN o_orderkey % 97 = 0 THEN o_totalprice * 20 WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice END AS price",
    "CASE WHEN o_orderkey % 90 = 0 THEN 'RARE' WHEN o_orderkey % 3 = 0 THEN o_orderstatus WHEN o_orderkey % 31 = 0 THEN NULL ELSE 'F' END AS status",
    "o_orderpriority AS priority",
    "o_orderdate AS placed",
    "CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS late",
    "1 AS version",
    "CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice END AS optional",
)


def sql(table: str, exprs: tuple[str, ...]) -> str:
    return f"SELECT {', '.join(exprs)} FROM {table}"


LINES_SQL, ORDERS_SQL = sql("lineitem", LINES), sql("orders", ORDERS)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").selectExpr(*LINES)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").selectExpr(*ORDERS)


def each(columns: list[str], select: str, source: str) -> str:
    """SQL that unions one row for each column; ``{c}`` stands for it."""
    return f"WITH t AS ({source}) " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {select.replace('{c}', c)} FROM t" for c in columns)
