"""Source/target pairs derived from the given tables, in Spark and in SQL.

The target is the source with known differences, so every comparison has
inserts, updates, deletes and matches, and the work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def every(column: str, n: int, rest: int = 0):
    return F.pmod(F.col(column), F.lit(n)) == rest


EXTRA_KEY = 100_000_000


def orders_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders without every 11th key, with changed cells and extra keys."""
    src = load(spark, sf_dir, "orders")
    priority = F.concat(F.lit("  "), F.replace("o_orderpriority", F.lit(" "), F.lit("  ")), F.lit(" "))
    changed = src.withColumns(
        {
            "o_orderstatus": F.when(every("o_orderkey", 5), F.lower("o_orderstatus")).otherwise(F.col("o_orderstatus")),
            "o_totalprice": F.when(every("o_orderkey", 7), F.col("o_totalprice") + 10).otherwise(F.col("o_totalprice")),
            "o_orderpriority": F.when(every("o_orderkey", 13), priority).otherwise(F.col("o_orderpriority")),
        }
    ).filter(~every("o_orderkey", 11))
    extra = src.filter(every("o_orderkey", 17)).withColumn("o_orderkey", F.col("o_orderkey") + EXTRA_KEY)
    return src, changed.unionByName(extra)


ORDERS_SQL = """
src AS (SELECT * FROM orders),
tgt AS (
  SELECT o_orderkey, o_custkey,
         CASE WHEN o_orderkey % 5 = 0 THEN lower(o_orderstatus) ELSE o_orderstatus END AS o_orderstatus,
         CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 10 ELSE o_totalprice END AS o_totalprice,
         o_orderdate,
         CASE WHEN o_orderkey % 13 = 0 THEN '  ' || replace(o_orderpriority, ' ', '  ') || ' '
              ELSE o_orderpriority END AS o_orderpriority
  FROM orders WHERE o_orderkey % 11 <> 0
  UNION ALL
  SELECT o_orderkey + 100000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
  FROM orders WHERE o_orderkey % 17 = 0)
"""

ORDER_COLUMNS = ("o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus", "o_totalprice")


def timed_orders_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The orders pair with an ``updated_at`` on each side."""
    src, tgt = orders_pair(spark, sf_dir)
    shift = F.make_dt_interval(F.pmod("o_orderkey", F.lit(5)).cast("int") - 2)
    return src.withColumn("updated_at", F.col("o_orderdate")), tgt.withColumn("updated_at", F.col("o_orderdate") + shift)


def lineitem_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lineitem, whose (order, line) key repeats, against a changed copy."""
    src = load(spark, sf_dir, "lineitem")
    tgt = src.withColumns(
        {
            "l_returnflag": F.when(every("l_orderkey", 5), F.lower("l_returnflag")).otherwise(F.col("l_returnflag")),
            "l_extendedprice": F.when(every("l_orderkey", 7), F.col("l_extendedprice") + 10).otherwise(
                F.col("l_extendedprice")
            ),
        }
    ).filter(~every("l_orderkey", 11))
    extra = src.filter(every("l_orderkey", 17)).withColumn("l_orderkey", F.col("l_orderkey") + EXTRA_KEY)
    return src, tgt.unionByName(extra)


LINE_KEYS = ("l_orderkey", "l_linenumber")
LINE_ORDER = ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")
LINE_COLUMNS = (
    "l_discount", "l_extendedprice", "l_linestatus", "l_partkey", "l_quantity",
    "l_returnflag", "l_shipdate", "l_suppkey", "l_tax",
)

_LAST = (
    "row_number() OVER (PARTITION BY l_orderkey, l_linenumber "
    "ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC)"
)

LINEITEM_SQL = f"""
raw_tgt AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
         CASE WHEN l_orderkey % 7 = 0 THEN l_extendedprice + 10 ELSE l_extendedprice END AS l_extendedprice,
         l_discount, l_tax,
         CASE WHEN l_orderkey % 5 = 0 THEN lower(l_returnflag) ELSE l_returnflag END AS l_returnflag,
         l_linestatus, l_shipdate
  FROM lineitem WHERE l_orderkey % 11 <> 0
  UNION ALL
  SELECT l_orderkey + 100000000, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
         l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate
  FROM lineitem WHERE l_orderkey % 17 = 0),
src AS (SELECT * EXCLUDE (rn) FROM (SELECT *, {_LAST} AS rn FROM lineitem) WHERE rn = 1),
tgt AS (SELECT * EXCLUDE (rn) FROM (SELECT *, {_LAST} AS rn FROM raw_tgt) WHERE rn = 1)
"""


def customer_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers with NULL against '' segments and slightly moved balances."""
    base = load(spark, sf_dir, "customer")
    sixth = every("c_custkey", 6)
    src = base.withColumn("c_mktsegment", F.when(~sixth, F.col("c_mktsegment")))
    moved = (
        F.when(every("c_custkey", 9), F.col("c_acctbal") + 0.5)
        .when(every("c_custkey", 2), F.col("c_acctbal") + 0.005)
        .otherwise(F.col("c_acctbal"))
    )
    tgt = base.withColumn("c_mktsegment", F.when(sixth, F.lit("")).otherwise(F.col("c_mktsegment"))).withColumn("c_acctbal", moved)
    return src, tgt


CUSTOMER_SQL = """
src AS (SELECT c_custkey, c_name, c_nationkey, c_acctbal,
               CASE WHEN c_custkey % 6 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer),
tgt AS (SELECT c_custkey, c_name, c_nationkey,
               CASE WHEN c_custkey % 9 = 0 THEN c_acctbal + 0.5
                    WHEN c_custkey % 2 = 0 THEN c_acctbal + 0.005 ELSE c_acctbal END AS c_acctbal,
               CASE WHEN c_custkey % 6 = 0 THEN '' ELSE c_mktsegment END AS c_mktsegment FROM customer)
"""
