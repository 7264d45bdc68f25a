"""Registered runs over several tables, and plans with rows that cannot be written."""

from __future__ import annotations

from pyspark.sql import functions as F

from parityflow.config import CompareConfig, MigrationConfig
from parityflow.plans import apply as A
from parityflow.plans import plan as PL
from parityflow.plans.run import run_tables
from parityflow.plans.script import render_dml, unscripted
from parityflow.plans.validate import ColumnRule, TableRun
from parityflow.suite import pairs as P

LARGE = 90_000  #: orders of this price or more are not in the target, whose price column ends below 100 000


def three_tables(spark, sf_dir):
    """Customers, orders and their lines against changed copies, given children first."""
    c_src, c_tgt = P.customer_pair(spark, sf_dir)
    c_tgt = c_tgt.filter(~P.every("c_custkey", 11))
    rules = [ColumnRule(c, max_length=10 if c == "c_name" else None, is_nullable=c != "c_mktsegment") for c in c_tgt.columns]
    o_src, o_tgt = P.orders_pair(spark, sf_dir)
    o_tgt = o_tgt.filter(F.col("o_totalprice") < LARGE).withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(7,2)"))
    l_src, l_tgt = P.lineitem_pair(spark, sf_dir)
    runs = [
        TableRun("lineitem", "lines", l_src, l_tgt, P.LINE_KEYS, (), P.LINE_ORDER),
        TableRun("orders", "orders", o_src, o_tgt, ["o_orderkey"]),
        TableRun("customer", "customers", c_src, c_tgt, ["c_custkey"], rules),
    ]
    return run_tables(spark, runs, [("lines", "orders"), ("orders", "customers")], MigrationConfig(mode="Mirror"))


def run_tables_summary(spark, sf_dir):
    """Measured counts of a run over three tables."""
    s = three_tables(spark, sf_dir).summary()
    return s.select("source_table", "target_table", "level", "rows_inserted", "rows_updated", "rows_deleted", "rows_skipped", "errors", "status", (F.col("duration_ms") > 0).alias("timed"))


def run_rejected_rows(spark, sf_dir):
    """Rows that the run did not write, and why."""
    r = three_tables(spark, sf_dir).rejected()
    key = F.coalesce(F.get_json_object("row", "$.c_custkey"), F.get_json_object("row", "$.o_orderkey")).cast("long")
    return r.select("target_table", "action", "outcome", key.alias("key"), F.array_join("reasons", "; ").alias("reasons"))


def run_progress(spark, sf_dir):
    """Progress rows of the finished run."""
    return three_tables(spark, sf_dir).progress().drop("migration_id")


def run_written_orders(spark, sf_dir):
    """The orders as the run left them in its target."""
    return three_tables(spark, sf_dir).result("orders").withColumn("o_totalprice", F.col("o_totalprice").cast("double"))


_ORDERS = P.ORDERS_SQL.replace("src AS", "o_src AS", 1).replace("tgt AS", "o_all AS", 1)
_LINES = P.LINEITEM_SQL.replace("src AS", "l_src AS", 1).replace("\ntgt AS", "\nl_tgt AS", 1)
_CUSTOMERS = P.CUSTOMER_SQL.replace("src AS", "c_src AS", 1).replace("\ntgt AS", "\nc_all AS", 1)
_DIFFERENT = "(" + " OR ".join(f"s.{c} IS DISTINCT FROM t.{c}" for c in P.ORDER_COLUMNS) + ")"
_LINES_DIFFERENT = "(" + " OR ".join(f"s.{c} IS DISTINCT FROM t.{c}" for c in P.LINE_COLUMNS) + ")"
_CUSTOMERS_DIFFERENT = "(s.c_acctbal IS DISTINCT FROM t.c_acctbal OR s.c_mktsegment IS DISTINCT FROM t.c_mktsegment)"
RUN_SQL = f"""WITH {_ORDERS}, {_LINES}, {_CUSTOMERS},
o_tgt AS (SELECT * FROM o_all WHERE o_totalprice < {LARGE}), c_tgt AS (SELECT * FROM c_all WHERE c_custkey % 11 <> 0),
o AS (SELECT coalesce(s.o_orderkey, t.o_orderkey) AS key,
  CASE WHEN t.o_orderkey IS NULL THEN CASE WHEN s.o_totalprice >= 99999.995 THEN 'error' ELSE 'insert' END
       WHEN s.o_orderkey IS NULL THEN 'delete' WHEN {_DIFFERENT} THEN CASE WHEN s.o_totalprice >= 99999.995 THEN 'bad' ELSE 'update' END END AS outcome
  FROM o_src s FULL JOIN o_tgt t ON s.o_orderkey = t.o_orderkey),
l AS (SELECT CASE WHEN t.l_orderkey IS NULL THEN 'insert' WHEN s.l_orderkey IS NULL THEN 'delete' WHEN {_LINES_DIFFERENT} THEN 'update' END AS outcome
  FROM l_src s FULL JOIN l_tgt t ON s.l_orderkey = t.l_orderkey AND s.l_linenumber = t.l_linenumber),
c AS (SELECT s.c_custkey AS key, s.c_name, CASE WHEN t.c_custkey IS NULL THEN CASE WHEN s.c_mktsegment IS NULL THEN 'skipped' ELSE 'insert' END
  WHEN {_CUSTOMERS_DIFFERENT} THEN 'update' END AS outcome FROM c_src s LEFT JOIN c_tgt t ON s.c_custkey = t.c_custkey),
e AS (SELECT 'lineitem' AS source_table, 'lines' AS target_table, 2 AS level, outcome FROM l UNION ALL
  SELECT 'orders', 'orders', 1, outcome FROM o UNION ALL SELECT 'customer', 'customers', 0, outcome FROM c),
n AS (SELECT source_table, target_table, level, {', '.join(f"count(*) FILTER (WHERE outcome = '{x}') AS {y}" for x, y in (
    ('insert', 'rows_inserted'), ('update', 'rows_updated'), ('delete', 'rows_deleted'), ('skipped', 'rows_skipped'), ('error', 'errors')))}
  FROM e GROUP BY ALL)
"""

WRITTEN_SQL = f"""{RUN_SQL} SELECT s.* FROM o_src s JOIN o ON o.key = s.o_orderkey AND (outcome IS NULL OR outcome <> 'error')"""


def apply_overflow_rejects(spark, sf_dir):
    """Orders whose price the target column cannot hold: not applied, but reported."""
    s, t = P.orders_pair(spark, sf_dir)
    t = t.filter(F.col("o_totalprice") < LARGE).withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(7,2)"))
    p = PL.plan(s, t, CompareConfig(keys=["o_orderkey"]), MigrationConfig(mode="Mirror"))
    return A.rejected_rows(t, p).select("o_orderkey", "action", F.array_join("errors", "; ").alias("errors"))


def _priced(spark, sf_dir):
    """Parts by price, some of them NaN or infinite, to be updated or deleted."""
    part = P.load(spark, sf_dir, "part")
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    key = F.when(P.every("p_partkey", 5), nan).when(P.every("p_partkey", 7), inf).when(~P.every("p_partkey", 9), F.col("p_partkey").cast("double"))
    return part.select(
        F.when(P.every("p_partkey", 2), "update").otherwise("delete").alias("action"), F.array(F.lit("p_size")).alias("changed_columns"),
        F.struct(key.alias("k"), F.col("p_size")).alias("row"), "p_partkey",
    )


def dml_nonfinite_keys(spark, sf_dir):
    """Statements of rows whose key is a number, NULL, NaN or infinite; only the first two can be named."""
    rows = _priced(spark, sf_dir)
    made = render_dml(rows, "PostgreSql", "t", ["k"], partial=True).select("p_partkey", "statement")
    return made.unionByName(unscripted(rows, ["k"]).select("p_partkey", F.lit("rejected").alias("statement")))


QUERIES = {f.__name__: f for f in (run_tables_summary, run_rejected_rows, run_progress, run_written_orders, apply_overflow_rejects, dml_nonfinite_keys)}
_OVER = "Column ''o_totalprice'' cannot hold the value as decimal(7,2)"
ORACLES = {
    "run_tables_summary": f"{RUN_SQL} SELECT *, 'Completed' AS status, TRUE AS timed FROM n",
    "run_rejected_rows": f"""{RUN_SQL} SELECT 'customers' AS target_table, 'insert' AS action, outcome, key,
 CASE WHEN length(c_name) > 10 THEN 'Truncated ''c_name'': ' || length(c_name) || ' -> 10 chars; ' ELSE '' END
 || 'Column ''c_mktsegment'' is NOT NULL without default but value is NULL' AS reasons FROM c WHERE outcome = 'skipped'
 UNION ALL SELECT 'orders', 'insert', outcome, key, '{_OVER}' FROM o WHERE outcome = 'error'""",
    "run_progress": f"""{RUN_SQL}, p AS (SELECT *, rows_inserted + rows_updated + rows_deleted AS done FROM n)
 SELECT target_table AS table_name, done AS processed_rows, done + rows_skipped + errors AS total_rows, rows_inserted AS inserted, rows_updated AS updated,
 rows_deleted AS deleted, rows_skipped AS skipped, errors, 'Completed' AS status,
 CASE WHEN done + rows_skipped + errors = 0 THEN 100.0 ELSE round(done * 100.0 / (done + rows_skipped + errors), 1) END::DOUBLE AS percent FROM p""",
    "run_written_orders": WRITTEN_SQL,
    "apply_overflow_rejects": f"{RUN_SQL} SELECT key AS o_orderkey, 'insert' AS action, '{_OVER}' AS errors FROM o WHERE outcome = 'error'",
    "dml_nonfinite_keys": """WITH k AS (SELECT *, CASE WHEN p_partkey % 9 = 0 THEN '"k" IS NULL' ELSE '"k" = ' || p_partkey || '.0' END AS w FROM part)
 SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 OR p_partkey % 7 = 0 THEN 'rejected'
 WHEN p_partkey % 2 = 0 THEN 'UPDATE "t" SET "p_size" = ' || p_size || ' WHERE ' || w || ';' ELSE 'DELETE FROM "t" WHERE ' || w || ';' END AS statement FROM k""",
}
