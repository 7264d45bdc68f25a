"""Registered transform rules and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from parityflow.operators.transform import (
    Cast, Compute, Default, Drop, KeepRows, MapValues, Pipeline, Rename, TableRule, transform_tables,
)
from parityflow.suite import pairs as P

QUERIES, ORACLES = {}, {}


def registered(sql):
    def wrap(fn):
        QUERIES[fn.__name__] = fn
        ORACLES[fn.__name__] = sql
        return fn

    return wrap


def _mixed(spark, sf_dir):
    """Order texts of which some read as numbers or booleans, and some are NULL."""
    key = F.col("o_orderkey")
    text = (
        F.when(P.every("o_orderkey", 7), F.lit(None))
        .when(P.every("o_orderkey", 7, 1), F.concat(key.cast("string"), F.lit("x")))
        .when(P.every("o_orderkey", 7, 2), F.lit("Yes"))
        .when(P.every("o_orderkey", 7, 3), F.lit("0"))
        .when(P.every("o_orderkey", 7, 4), F.concat(F.lit(" "), key.cast("string")))
        .when(P.every("o_orderkey", 7, 5), F.concat(key.cast("string"), F.lit(".50")))
        .otherwise(key.cast("string"))
    )
    return P.load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", text.alias("v"))


MIXED_SQL = """mixed AS (SELECT o_orderkey, o_totalprice, CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN o_orderkey || 'x' WHEN 2 THEN 'Yes'
 WHEN 3 THEN '0' WHEN 4 THEN ' ' || o_orderkey WHEN 5 THEN o_orderkey || '.50' ELSE o_orderkey::VARCHAR END AS v FROM orders)"""
_NUM = "regexp_full_match(v, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?')"


@registered("SELECT o_orderkey, o_totalprice AS o_orderstatus FROM orders")
def tf_rename(spark, sf_dir):
    """The new name replaces a column that had it; an absent column changes nothing."""
    df = P.load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return Pipeline([Rename("o_totalprice", "o_orderstatus"), Rename("absent", "o_orderkey")]).apply(df)


@registered(f"WITH {MIXED_SQL} SELECT o_orderkey::VARCHAR AS o_orderkey, o_totalprice::VARCHAR AS o_totalprice, coalesce(v, 'null') AS v FROM mixed")
def tf_cast_string(spark, sf_dir):
    return Pipeline([Cast(c, "String") for c in ("o_orderkey", "o_totalprice", "v")]).apply(_mixed(spark, sf_dir))


@registered(f"WITH {MIXED_SQL} SELECT o_orderkey, o_totalprice, CASE WHEN {_NUM} THEN v::DOUBLE END AS v FROM mixed")
def tf_cast_number(spark, sf_dir):
    return Cast("v", "number").apply(_mixed(spark, sf_dir))


@registered(f"""WITH {MIXED_SQL} SELECT o_orderkey, CASE WHEN regexp_full_match(v, '[0-9]+') THEN v::BIGINT::VARCHAR
 WHEN {_NUM} THEN v::DOUBLE::VARCHAR ELSE v END AS v FROM mixed""")
def tf_cast_number_keep(spark, sf_dir):
    return Cast("v", "number", on_error="keep").apply(_mixed(spark, sf_dir)).select("o_orderkey", "v")


@registered(f"WITH {MIXED_SQL} SELECT o_orderkey, o_totalprice, v, v AS original FROM mixed WHERE v IS NOT NULL AND NOT {_NUM}")
def tf_cast_failures(spark, sf_dir):
    return Cast("v", "number").failures(_mixed(spark, sf_dir))


@registered(f"""WITH {MIXED_SQL} SELECT o_orderkey <> 0 AS o_orderkey, o_totalprice, CASE WHEN lower(v) IN ('true', '1', 'yes') THEN true
 WHEN lower(v) IN ('false', '0', 'no') THEN false END AS v FROM mixed""")
def tf_cast_boolean(spark, sf_dir):
    return Pipeline([Cast("v", "boolean"), Cast("o_orderkey", "BOOLEAN"), Cast("o_totalprice", "unknown")]).apply(_mixed(spark, sf_dir))


@registered("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN NULL ELSE o_orderstatus END AS o_orderstatus,
 CASE WHEN o_custkey = 7 THEN 70 ELSE o_custkey END AS o_custkey FROM orders""")
def tf_value_map(spark, sf_dir):
    df = P.load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    status = MapValues("o_orderstatus", [("F", "final"), ("F", "second"), (1, "number"), ("O", None)])
    return Pipeline([status, MapValues("o_custkey", [("7", 1), (7, 70)])]).apply(df)


@registered("SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 40 THEN p_size * 100 ELSE p_size END AS p_size FROM part")
def tf_value_map_large(spark, sf_dir):
    """A long map."""
    df = P.load(spark, sf_dir, "part").select("p_partkey", "p_size")
    return MapValues("p_size", [(i, i * 100) for i in range(1, 41)]).apply(df)


@registered("SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 40 THEN p_size * 100 ELSE p_size END::DECIMAL(12,2) AS p_size FROM part")
def tf_value_map_decimal(spark, sf_dir):
    """Whole numbers mapped in a decimal column."""
    df = P.load(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("decimal(12,2)").alias("p_size"))
    return MapValues("p_size", [(i, i * 100) for i in range(1, 41)]).apply(df)


@registered("""SELECT o_orderkey, 'web shop' AS channel, o_orderstatus || o_orderpriority AS tag, o_totalprice AS price,
 o_totalprice || '' AS shown, NULL::VARCHAR AS none FROM orders""")
def tf_computed(spark, sf_dir):
    df = P.load(spark, sf_dir, "orders")
    rules = [
        Compute("channel", " 'web shop' "), Compute("tag", "o_orderstatus || o_orderpriority"),
        Compute("price", "o_totalprice"), Compute("shown", "o_totalprice || absent"), Compute("none", "absent"),
    ]
    return Pipeline(rules).apply(df).select("o_orderkey", "channel", "tag", "price", "shown", "none")


@registered("SELECT o_orderkey, o_totalprice * 2 AS discounted FROM orders WHERE year(o_orderdate) = 1998")
def tf_sql_expression(spark, sf_dir):
    df = P.load(spark, sf_dir, "orders")
    rules = [Compute("discounted", expr="o_totalprice * 2"), KeepRows(expr="year(o_orderdate) = 1998")]
    return Pipeline(rules).apply(df).select("o_orderkey", "discounted")


@registered(f"WITH {MIXED_SQL} SELECT o_orderkey, coalesce(v, 'none') AS v, 5 AS extra FROM mixed")
def tf_default_for_null(spark, sf_dir):
    return Pipeline([Default("v", "none"), Default("extra", 5)]).apply(_mixed(spark, sf_dir)).select("o_orderkey", "v", "extra")


_FILTERS = ("v IS NOT NULL", "v IS NULL", "v = 'Yes'", "v != 'Yes'", "absent IS NULL", "absent = 'a'", "o_totalprice != '1'", "v LIKE 'a'")


@registered(f"""WITH {MIXED_SQL} SELECT * FROM (SELECT 0 AS rule, o_orderkey FROM mixed WHERE v IS NOT NULL
 UNION ALL SELECT 1, o_orderkey FROM mixed WHERE v IS NULL UNION ALL SELECT 2, o_orderkey FROM mixed WHERE v = 'Yes'
 UNION ALL SELECT 3, o_orderkey FROM mixed WHERE v IS DISTINCT FROM 'Yes' UNION ALL SELECT 4, o_orderkey FROM mixed
 UNION ALL SELECT 6, o_orderkey FROM mixed UNION ALL SELECT 7, o_orderkey FROM mixed)""")
def tf_row_filter(spark, sf_dir):
    out = None
    for i, text in enumerate(_FILTERS):
        part = KeepRows(text).apply(_mixed(spark, sf_dir)).select(F.lit(i).alias("rule"), "o_orderkey")
        out = part if out is None else out.unionByName(part)
    return out


@registered("SELECT o_orderkey, o_custkey, o_orderdate FROM orders")
def tf_drop(spark, sf_dir):
    df = P.load(spark, sf_dir, "orders")
    return Pipeline([Drop(c) for c in ("o_orderstatus", "o_totalprice", "o_orderpriority", "absent")]).apply(df)


@registered("""SELECT c_custkey AS id, c_name AS name, CASE c_mktsegment WHEN 'BUILDING' THEN 'B' ELSE c_mktsegment END AS segment,
 c_acctbal::VARCHAR AS balance, c_name || c_mktsegment AS tag FROM customer WHERE c_mktsegment IS DISTINCT FROM 'MACHINERY'""")
def tf_pipeline(spark, sf_dir):
    rules = [
        KeepRows("c_mktsegment != 'MACHINERY'"), Compute("tag", "c_name || c_mktsegment"), Rename("c_custkey", "id"),
        Rename("c_name", "name"), Rename("c_mktsegment", "segment"), MapValues("segment", [("BUILDING", "B")]),
        Cast("c_acctbal", "string"), Rename("c_acctbal", "balance"), Drop("c_nationkey"),
    ]
    return Pipeline(rules).apply(P.load(spark, sf_dir, "customer"))


@registered("""SELECT 'customer' AS tab, c_custkey AS id, 'C' AS kind FROM customer
 UNION ALL SELECT 'supplier', s_suppkey, 's' FROM supplier""")
def tf_table_rules(spark, sf_dir):
    """Rules for several tables, given out of order."""
    rules = [
        TableRule("supplier", 2, Rename("s_suppkey", "id")), TableRule("customer", 3, Compute("kind", "'C'")),
        TableRule("customer", 1, Compute("kind", "'c'")), TableRule("supplier", 1, Compute("kind", "'s'")),
        TableRule("customer", 2, Rename("c_custkey", "id")),
    ]
    tables = {n: P.load(spark, sf_dir, n) for n in ("customer", "supplier")}
    done = transform_tables(tables, rules)
    parts = [df.select(F.lit(n).alias("tab"), "id", "kind") for n, df in done.items()]
    return parts[0].unionByName(parts[1])
