"""Registered plans, applies and validations and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from parityflow.config import MODES, CompareConfig, MigrationConfig
from parityflow.operators import compare as C
from parityflow.plans import apply as A
from parityflow.plans import plan as PL
from parityflow.plans.multitable import dependency_levels, map_tables
from parityflow.plans.script import render_dml
from parityflow.plans.validate import (
    ColumnRule, TableRun, dry_run_report, progress_rows, project_to_target, split_valid, validate,
)
from parityflow.suite import pairs as P
from parityflow.suite.diffs import LINES, ORDERS, ORDERS_DIFF, diff_sql

QUERIES, ORACLES = {}, {}


def registered(sql=None, name=None):
    def wrap(fn):
        QUERIES[name or fn.__name__] = fn
        if sql is not None:
            ORACLES[name or fn.__name__] = sql
        return fn

    return wrap


TIMED_SQL = f"""{P.ORDERS_SQL.replace('src AS', 'src0 AS', 1).replace('tgt AS', 'tgt0 AS', 1)},
src AS (SELECT *, o_orderdate AS updated_at FROM src0),
tgt AS (SELECT *, o_orderdate + INTERVAL (o_orderkey % 5 - 2) DAY AS updated_at FROM tgt0)
"""
TIMED = CompareConfig(keys=["o_orderkey"], ignore_columns=["updated_at"])
TIMED_DIFF = diff_sql(TIMED_SQL, ["o_orderkey"], P.ORDER_COLUMNS)


# -- one plan per mode ---------------------------------------------------------
_DONE = {
    "InsertUpdate": "inserted updated", "Merge": "inserted updated", "Mirror": "inserted updated deleted",
    "AppendOnly": "inserted", "SchemaOnly": "",
}
_VERB = "CASE status WHEN 'inserted' THEN 'insert' WHEN 'updated' THEN 'update' WHEN 'deleted' THEN 'delete' END"

for _mode in MODES:

    def _plan(spark, sf_dir, mode=_mode):
        s, t = P.orders_pair(spark, sf_dir)
        p = PL.plan(s, t, ORDERS, MigrationConfig(mode=mode))
        return p.select("o_orderkey", "action", F.col("row.o_totalprice").alias("price"), F.col("row.o_orderstatus").alias("state"))

    _wanted = ", ".join(f"'{x}'" for x in _DONE[_mode].split()) or "''"
    registered(
        f"""{ORDERS_DIFF}
SELECT d.o_orderkey, {_VERB} AS action,
       CASE WHEN status = 'deleted' THEN t.o_totalprice ELSE s.o_totalprice END AS price,
       CASE WHEN status = 'deleted' THEN t.o_orderstatus ELSE s.o_orderstatus END AS state
FROM d LEFT JOIN src s ON s.o_orderkey = d.o_orderkey LEFT JOIN tgt t ON t.o_orderkey = d.o_orderkey
WHERE status IN ({_wanted})""",
        f"plan_{_mode}",
    )(_plan)

# -- one resolution per policy ---------------------------------------------------
_RULES = ("o_totalprice:target", "o_orderstatus:source", "nonsense")
_POLICY_SQL = {
    "SourceWins": ("'update'", "s.o_totalprice"),
    "TargetWins": ("'keep'", "s.o_totalprice"),
    "NewestWins": ("CASE WHEN coalesce(s.updated_at >= t.updated_at, true) THEN 'update' ELSE 'keep' END", "s.o_totalprice"),
    "ManualReview": ("'review'", "s.o_totalprice"),
    "CustomRules": ("'update'", "t.o_totalprice"),
}
for _policy, (_action, _price) in _POLICY_SQL.items():

    def _resolve(spark, sf_dir, policy=_policy):
        s, t = P.timed_orders_pair(spark, sf_dir)
        d = PL.decide(C.diff(s, t, TIMED), MigrationConfig(policy=policy, rules=_RULES))
        return C.filter_status(d, "updated").select(
            "o_orderkey", "action", F.col("row.o_totalprice").alias("price"), F.col("row.o_orderstatus").alias("state")
        )

    registered(
        f"""{TIMED_DIFF}
SELECT d.o_orderkey, {_action} AS action, {_price} AS price, s.o_orderstatus AS state
FROM d JOIN src s ON s.o_orderkey = d.o_orderkey JOIN tgt t ON t.o_orderkey = d.o_orderkey WHERE status = 'updated'""",
        f"resolve_{_policy}",
    )(_resolve)


# -- apply -------------------------------------------------------------------------
def _applied(spark, sf_dir, **options):
    s, t = P.orders_pair(spark, sf_dir)
    return A.migrate(s, t, ORDERS, MigrationConfig(**options))[0]


@registered("SELECT * FROM orders")
def apply_mirror(spark, sf_dir):
    return _applied(spark, sf_dir, mode="Mirror")


@registered(f"WITH {P.ORDERS_SQL} SELECT * FROM src UNION ALL SELECT * FROM tgt WHERE o_orderkey NOT IN (SELECT o_orderkey FROM src)")
def apply_insert_update(spark, sf_dir):
    return _applied(spark, sf_dir)


@registered(f"WITH {P.ORDERS_SQL} SELECT * FROM tgt UNION ALL SELECT * FROM src WHERE o_orderkey NOT IN (SELECT o_orderkey FROM tgt)")
def apply_append(spark, sf_dir):
    return _applied(spark, sf_dir, mode="AppendOnly")


@registered(f"""WITH {P.ORDERS_SQL}
SELECT s.o_orderkey, s.o_custkey, s.o_orderstatus, coalesce(t.o_totalprice, s.o_totalprice) AS o_totalprice, s.o_orderdate, s.o_orderpriority
FROM src s LEFT JOIN tgt t ON t.o_orderkey = s.o_orderkey
UNION ALL SELECT * FROM tgt WHERE o_orderkey NOT IN (SELECT o_orderkey FROM src)""")
def apply_custom_rules(spark, sf_dir):
    return _applied(spark, sf_dir, policy="CustomRules", rules=_RULES)


@registered(f"WITH {P.ORDERS_SQL} SELECT * FROM src UNION ALL SELECT * FROM tgt WHERE o_orderkey NOT IN (SELECT o_orderkey FROM src)")
def sync_insert_update(spark, sf_dir):
    """Diff and apply in one pass over both tables."""
    s, t = P.orders_pair(spark, sf_dir)
    return A.sync(s, t, ORDERS)


@registered(f"WITH {P.LINEITEM_SQL} SELECT * FROM src")
def sync_mirror_lineitem(spark, sf_dir):
    s, t = P.lineitem_pair(spark, sf_dir)
    return A.sync(s, t, LINES, MigrationConfig(mode="Mirror"))


@registered(f"""WITH {P.ORDERS_SQL},
same AS (SELECT t.o_orderkey FROM tgt t JOIN src s ON s.o_orderkey = t.o_orderkey
         WHERE abs(s.o_totalprice - t.o_totalprice) > 10.5 OR s.o_custkey <> t.o_custkey
            OR lower(s.o_orderstatus) <> lower(t.o_orderstatus) OR s.o_orderpriority <> t.o_orderpriority)
SELECT t.o_orderkey, t.o_custkey, t.o_orderstatus, t.o_totalprice, t.o_orderdate,
       coalesce(s.o_orderpriority, t.o_orderpriority) AS o_orderpriority
FROM tgt t LEFT JOIN (SELECT * FROM src WHERE o_orderkey IN (SELECT o_orderkey FROM same)) s ON s.o_orderkey = t.o_orderkey
UNION ALL SELECT * FROM src WHERE o_orderkey NOT IN (SELECT o_orderkey FROM tgt)""")
def apply_partial(spark, sf_dir):
    """Only changed columns are written: cells that count as equal keep the target's form."""
    s, t = P.orders_pair(spark, sf_dir)
    cfg = CompareConfig(keys=["o_orderkey"], case_insensitive=True, numeric_tolerance=10.5)
    return A.migrate(s, t, cfg, MigrationConfig(), partial=True)[0]


_COUNT_DIFF = ORDERS_DIFF + """, c AS (SELECT count(*) FILTER (WHERE status = 'inserted') AS inserts,
 count(*) FILTER (WHERE status = 'updated') AS updates, count(*) FILTER (WHERE status = 'deleted') AS deletes FROM d)"""


@registered(_COUNT_DIFF + """ SELECT (SELECT count(*) FROM src) AS source_rows, (SELECT count(*)::BIGINT FROM tgt) AS target_rows,
 inserts, updates, deletes, 0 AS reviews, ceil((inserts + updates + deletes) / 64.0)::BIGINT AS batch_count FROM c""")
def plan_counts(spark, sf_dir):
    s, t = P.orders_pair(spark, sf_dir)
    cfg = MigrationConfig(mode="Mirror", batch_size=64)
    return PL.plan_counts(s, t, PL.plan(s, t, ORDERS, cfg), cfg)


@registered(_COUNT_DIFF + " SELECT inserts, 0 AS updates, 0 AS deletes, updates AS reviews FROM c")
def dry_run_counts(spark, sf_dir):
    s, t = P.orders_pair(spark, sf_dir)
    return PL.action_counts(PL.plan(s, t, ORDERS, MigrationConfig(policy="ManualReview")))


@registered(ORDERS_DIFF + f""", ops AS (
  SELECT (row_number() OVER (ORDER BY CASE status WHEN 'inserted' THEN 0 WHEN 'updated' THEN 1 ELSE 2 END) - 1) // 64 AS batch_id,
         {_VERB} AS action FROM d WHERE status <> 'matched')
SELECT batch_id, action, count(*) AS n_ops FROM ops GROUP BY 1, 2""")
def batch_counts(spark, sf_dir):
    """Operations per batch; inserts fill the first batches, deletes the last."""
    s, t = P.orders_pair(spark, sf_dir)
    p = PL.plan(s, t, ORDERS, MigrationConfig(mode="Mirror"))
    return PL.assign_batches(p, 64).groupBy("batch_id", "action").agg(F.count(F.lit(1)).alias("n_ops"))


@registered(_COUNT_DIFF + """ SELECT inserts AS rows_inserted, updates AS rows_updated, deletes AS rows_deleted, 0 AS rows_skipped,
 0 AS errors, 0 AS duration_ms, 'Completed' AS status FROM c""")
def result_summary(spark, sf_dir):
    s, t = P.orders_pair(spark, sf_dir)
    return A.result_summary(PL.plan(s, t, ORDERS, MigrationConfig(mode="Mirror")))


@registered(_COUNT_DIFF + """ SELECT 'run-1' AS migration_id, 'orders' AS table_name, inserts AS processed_rows, inserts + updates AS total_rows,
 inserts AS inserted, 0 AS updated, 0 AS deleted, updates AS skipped, 0 AS errors, 'Completed' AS status,
 round(inserts * 100.0 / (inserts + updates), 1)::DOUBLE AS percent FROM c""")
def progress_report(spark, sf_dir):
    s, t = P.orders_pair(spark, sf_dir)
    p = PL.plan(s, t, ORDERS, MigrationConfig(policy="ManualReview"))
    return progress_rows("run-1", {"orders": A.result_summary(p)})


# -- validation -------------------------------------------------------------------
_RULE_ROWS = "SELECT * FROM src WHERE o_orderkey NOT IN (SELECT o_orderkey FROM tgt)"


@registered(f"""WITH {P.ORDERS_SQL} SELECT o_orderkey, left(o_orderpriority, 6) AS o_orderpriority, true AS is_valid,
 CASE WHEN length(o_orderpriority) > 6 THEN 'Truncated ''o_orderpriority'': ' || length(o_orderpriority) || ' -> 6 chars' ELSE '' END AS notes
FROM ({_RULE_ROWS})""")
def validate_truncate(spark, sf_dir):
    s, t = P.orders_pair(spark, sf_dir)
    rules = [ColumnRule("o_orderkey", False), ColumnRule("o_orderpriority", True, 6), ColumnRule("region", False, None, True)]
    out = validate(C.append_rows(s, t, ORDERS), rules)
    return out.select("o_orderkey", "o_orderpriority", "is_valid", F.concat_ws("; ", "warnings").alias("notes"))


@registered(f"""WITH {P.CUSTOMER_SQL} SELECT c_custkey, c_mktsegment IS NOT NULL AS is_valid,
 CASE WHEN c_mktsegment IS NULL THEN 'Column ''c_mktsegment'' is NOT NULL without default but value is NULL' ELSE '' END AS notes FROM src""")
def validate_not_null(spark, sf_dir):
    s, _ = P.customer_pair(spark, sf_dir)
    out = validate(s, [ColumnRule("c_custkey", False), ColumnRule("c_mktsegment", False)])
    return out.select("c_custkey", "is_valid", F.concat_ws("; ", "warnings").alias("notes"))


@registered(f"""WITH {P.CUSTOMER_SQL} SELECT c_custkey, c_mktsegment IS NOT NULL AS accepted FROM src""")
def validate_split(spark, sf_dir):
    s, _ = P.customer_pair(spark, sf_dir)
    good, bad = split_valid(validate(s, [ColumnRule("c_mktsegment", False)]))
    return good.select("c_custkey", F.lit(True).alias("accepted")).unionByName(
        bad.select("c_custkey", F.lit(False).alias("accepted"))
    )


@registered(_COUNT_DIFF + f""", x AS (SELECT count(*) AS n FROM customer),
lines AS ({diff_sql(P.LINEITEM_SQL, P.LINE_KEYS, P.LINE_COLUMNS)} SELECT status FROM d)
SELECT 'orders' AS source_table, 'orders_copy' AS target_table, (SELECT count(*) FROM src) AS source_rows,
 (SELECT count(*) FROM tgt) AS target_rows, 0 AS inserts, updates, deletes, inserts AS skips,
 'Target column ''region'' is NOT NULL without default and missing from source - inserts will be skipped' AS warnings FROM c
UNION ALL SELECT 'lineitem', 'lineitem_copy', (SELECT count(*) FROM lineitem),
 (SELECT count(*) FROM lineitem WHERE l_orderkey % 11 <> 0) + (SELECT count(*) FROM lineitem WHERE l_orderkey % 17 = 0),
 count(*) FILTER (WHERE status = 'inserted'), count(*) FILTER (WHERE status = 'updated'),
 count(*) FILTER (WHERE status = 'deleted'), 0, '' FROM lines""", "dry_run_tables")
def dry_run_tables(spark, sf_dir):
    s, t = P.orders_pair(spark, sf_dir)
    rules = [ColumnRule(c) for c in t.columns] + [ColumnRule("region", False)]
    a, b = P.lineitem_pair(spark, sf_dir)
    runs = [
        TableRun("orders", "orders_copy", s, t, ["o_orderkey"], rules),
        TableRun("lineitem", "lineitem_copy", a, b, P.LINE_KEYS, (), P.LINE_ORDER),
    ]
    return dry_run_report(runs, MigrationConfig(mode="Mirror")).withColumn("warnings", F.concat_ws("; ", "warnings"))


@registered("SELECT o_orderkey, o_totalprice FROM orders")
def target_projection(spark, sf_dir):
    s, _ = P.orders_pair(spark, sf_dir)
    return project_to_target(s, ["o_orderkey", "o_totalprice", "not_there"])


# -- script -------------------------------------------------------------------------
_PRICE = "printf('%s', {0}.o_totalprice)"


@registered(f"""{ORDERS_DIFF} SELECT d.o_orderkey, CASE status
 WHEN 'inserted' THEN 'INSERT INTO [orders] ([o_custkey], [o_orderdate], [o_orderkey], [o_orderpriority], [o_orderstatus], [o_totalprice]) VALUES ('
   || s.o_custkey || ', ''' || strftime(s.o_orderdate, '%Y-%m-%d %H:%M:%S') || ''', ' || s.o_orderkey || ', ''' || s.o_orderpriority || ''', '''
   || s.o_orderstatus || ''', ' || s.o_totalprice || ');'
 WHEN 'updated' THEN 'UPDATE [orders] SET ' || concat_ws(', ',
   CASE WHEN s.o_orderpriority <> t.o_orderpriority THEN '[o_orderpriority] = ''' || s.o_orderpriority || '''' END,
   CASE WHEN s.o_orderstatus <> t.o_orderstatus THEN '[o_orderstatus] = ''' || s.o_orderstatus || '''' END,
   CASE WHEN s.o_totalprice <> t.o_totalprice THEN '[o_totalprice] = ' || s.o_totalprice END) || ' WHERE [o_orderkey] = ' || d.o_orderkey || ';'
 ELSE 'DELETE FROM [orders] WHERE [o_orderkey] = ' || d.o_orderkey || ';' END AS statement
FROM d LEFT JOIN src s ON s.o_orderkey = d.o_orderkey LEFT JOIN tgt t ON t.o_orderkey = d.o_orderkey WHERE status <> 'matched'""")
def dml_script(spark, sf_dir):
    s, t = P.orders_pair(spark, sf_dir)
    p = PL.plan(s, t, ORDERS, MigrationConfig(mode="Mirror"))
    return render_dml(p, "SqlServer", "orders", partial=True).select("o_orderkey", "statement")


@registered("""SELECT c_custkey, 'UPDATE "customer" SET "active" = ' || CASE WHEN c_acctbal > 0 THEN 'TRUE' ELSE 'FALSE' END
 || ', "c_acctbal" = ' || c_acctbal || ', "c_mktsegment" = ' || CASE WHEN c_custkey % 6 = 0 THEN 'NULL' ELSE '''it''''s ' || c_mktsegment || '''' END
 || ' WHERE "c_custkey" = ' || c_custkey || ';' AS statement FROM customer""")
def dml_full_updates(spark, sf_dir):
    """Full updates for a table where every row changed, with quotes, NULLs and booleans."""
    base = P.load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    segment = F.when(~P.every("c_custkey", 6), F.concat(F.lit("it's "), "c_mktsegment"))
    src = base.withColumn("c_mktsegment", segment).withColumn("active", F.col("c_acctbal") > 0)
    tgt = base.withColumn("active", F.lit(None).cast("boolean"))
    p = PL.plan(src, tgt, CompareConfig(keys=["c_custkey"]))
    return render_dml(p, "PostgreSql", "customer").select("c_custkey", "statement")


# -- several tables ----------------------------------------------------------------
_EDGES_SQL = """edges AS (
  SELECT DISTINCT 't' || o_custkey AS child, 't' || (o_custkey // 5) AS parent FROM orders
  UNION SELECT 't' || o_custkey, 't' || (o_custkey // 7) FROM orders
  UNION SELECT 't' || o_custkey, 't' || (o_custkey // 5) || 'x' FROM orders
  UNION SELECT 'loop', 'loop2' UNION SELECT 'loop2', 'loop' UNION SELECT 'behind', 'loop'),
nodes AS (SELECT DISTINCT 't' || o_custkey AS table_name FROM orders
  UNION SELECT 'loop' UNION SELECT 'loop2' UNION SELECT 'behind'),
known AS (SELECT * FROM edges WHERE child <> parent AND child IN (SELECT table_name FROM nodes) AND parent IN (SELECT table_name FROM nodes))"""


@registered(f"""WITH RECURSIVE {_EDGES_SQL},
walk AS (SELECT table_name, 0 AS level FROM nodes WHERE table_name NOT IN (SELECT child FROM known)
  UNION SELECT k.child, w.level + 1 FROM walk w JOIN known k ON k.parent = w.table_name
  WHERE k.child NOT IN ('loop', 'loop2', 'behind')),
deep AS (SELECT table_name, max(level) AS level FROM walk GROUP BY 1)
SELECT n.table_name, coalesce(d.level, (SELECT max(level) + 1 FROM deep))::INTEGER AS level, d.level IS NULL AS in_cycle
FROM nodes n LEFT JOIN deep d ON d.table_name = n.table_name""")
def fk_levels(spark, sf_dir):
    """A reference graph between customers stands in for foreign keys."""
    key = P.load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    name = lambda c: F.concat(F.lit("t"), c.cast("string"))
    fifth, seventh = F.floor(F.col("k") / 5), F.floor(F.col("k") / 7)
    edges = (
        key.select(name(F.col("k")).alias("child"), name(fifth).alias("parent"))
        .unionByName(key.select(name(F.col("k")).alias("child"), name(seventh).alias("parent")))
        .unionByName(key.select(name(F.col("k")).alias("child"), F.concat(name(fifth), F.lit("x")).alias("parent")))
    )
    loops = spark.createDataFrame([("loop", "loop2"), ("loop2", "loop"), ("behind", "loop")], "child string, parent string")
    nodes = key.select(name(F.col("k")).alias("table_name")).unionByName(loops.select(F.col("child").alias("table_name")))
    return dependency_levels(nodes, edges.unionByName(loops))


@registered("""WITH src AS (SELECT 'T' || (p_partkey % 97) AS table_name, 'c' || p_partkey AS column_name, p_size = 1 AS is_primary_key, p_partkey AS pos FROM part),
s AS (SELECT table_name, string_agg(column_name, ',' ORDER BY pos) FILTER (WHERE is_primary_key) AS pk FROM src GROUP BY 1),
t AS (SELECT DISTINCT 't' || (s_suppkey % 71) AS table_name FROM supplier)
SELECT s.table_name AS source_table, coalesce(t.table_name, '') AS target_table, t.table_name IS NOT NULL AS included, coalesce(pk, 'id') AS key_columns
FROM s LEFT JOIN t ON lower(s.table_name) = lower(t.table_name)""", "map_tables")
def map_tables_by_name(spark, sf_dir):
    part = P.load(spark, sf_dir, "part")
    src = part.select(
        F.concat(F.lit("T"), F.pmod("p_partkey", F.lit(97))).alias("table_name"),
        F.concat(F.lit("c"), "p_partkey").alias("column_name"),
        (F.col("p_size") == 1).alias("is_primary_key"),
        F.col("p_partkey").alias("ordinal_position"),
    )
    tgt = P.load(spark, sf_dir, "supplier").select(F.concat(F.lit("t"), F.pmod("s_suppkey", F.lit(71))).alias("table_name"))
    return map_tables(src, tgt).withColumn("key_columns", F.concat_ws(",", "key_columns"))
