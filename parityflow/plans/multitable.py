"""Runs over several tables: order by foreign keys and name mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parityflow.session import cut_lineage


def dependency_levels(tables: DataFrame, edges: DataFrame) -> DataFrame:
    """``table_name, level, in_cycle``: parents come at a lower level than children.

    ``tables(table_name)``, ``edges(child, parent)``.  Repeated edges count once,
    self references and parents outside ``tables`` do not count.  Each round
    settles the tables whose parents are all settled; tables of one level are
    independent and can run side by side.  Tables that a cycle keeps back get
    the level after the last one.
    """
    nodes = tables.select("table_name").distinct()
    known = edges.select("child", "parent").distinct().filter("child <> parent")
    known = known.join(nodes.withColumnRenamed("table_name", "child"), "child", "left_semi")
    open_edges = cut_lineage(known.join(nodes.withColumnRenamed("table_name", "parent"), "parent", "left_semi"))
    left = cut_lineage(nodes)
    levels = []
    while True:
        ready = left.join(open_edges.select(F.col("child").alias("table_name")), "table_name", "left_anti")
        ready = cut_lineage(ready)
        if ready.isEmpty():
            break
        levels.append(ready.withColumn("level", F.lit(len(levels))).withColumn("in_cycle", F.lit(False)))
        left = cut_lineage(left.join(ready, "table_name", "left_anti"))
        open_edges = cut_lineage(
            open_edges.join(ready.select(F.col("table_name").alias("parent")), "parent", "left_anti")
        )
    out = left.withColumn("level", F.lit(len(levels))).withColumn("in_cycle", F.lit(True))
    for part in levels:
        out = out.unionByName(part)
    return out


def run_order(levels: DataFrame, tables: DataFrame) -> DataFrame:
    """``position, table_name``: levels in order, names within a level, cycles as given.

    ``tables(table_name, input_order)``.
    """
    joined = levels.join(tables.select("table_name", "input_order"), "table_name")
    within = F.when(F.col("in_cycle"), F.lit("")).otherwise(F.col("table_name"))
    return joined.orderBy("level", within, "input_order").select("table_name", "level", "in_cycle")


def map_tables(source_columns: DataFrame, target_columns: DataFrame) -> DataFrame:
    """Pair tables whose names agree without regard to case.

    Inputs are column catalogs (``table_name, column_name, is_primary_key,
    ordinal_position``).  Output: ``source_table, target_table, included,
    key_columns``; the keys are the source's primary key, else ``id``.
    """
    pk = F.when(F.col("is_primary_key"), F.struct("ordinal_position", "column_name"))
    src = source_columns.groupBy(F.col("table_name").alias("source_table")).agg(
        F.transform(F.array_sort(F.collect_list(pk)), lambda x: x["column_name"]).alias("pk")
    )
    tgt = target_columns.groupBy(F.lower("table_name").alias("lower_name")).agg(F.min("table_name").alias("target_table"))
    joined = src.join(tgt, F.lower("source_table") == F.col("lower_name"), "left_outer")
    return joined.select(
        "source_table",
        F.coalesce("target_table", F.lit("")).alias("target_table"),
        F.col("target_table").isNotNull().alias("included"),
        F.when(F.size("pk") > 0, F.col("pk")).otherwise(F.array(F.lit("id"))).alias("key_columns"),
    )
