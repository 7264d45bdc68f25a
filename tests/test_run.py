"""Runs over several tables, and rows that a target cannot hold."""

import re
import threading
import time

import pytest
from pyspark.sql import functions as F

from parityflow.config import CompareConfig, MigrationConfig
from parityflow.plans import apply as A
from parityflow.plans import plan as PL
from parityflow.plans.run import BLOCKED, CANCELLED, COMPLETED, FAILED, TablesRun, run_tables
from parityflow.plans.script import render_dml, unscripted
from parityflow.plans.validate import ColumnRule, TableRun, validate


def pair(spark, n, schema="id long, v int"):
    s = spark.createDataFrame([(i, i) for i in range(n)], schema)
    t = spark.createDataFrame([(i, -i) for i in range(1, n + 1)], schema)
    return s, t


def test_levels_and_blocked_tables(spark):
    s, t = pair(spark, 4)
    broken = s.withColumn("v", F.raise_error(F.lit("no such file")).cast("int"))
    runs = [
        TableRun("a", "child", s, t, ["id"]), TableRun("b", "parent", broken, t, ["id"]), TableRun("c", "other", s, t, ["id"]),
        TableRun("d", "x", s, t, ["id"]), TableRun("e", "y", s, t, ["id"]), TableRun("f", "grandchild", s, t, ["id"]),
    ]
    keys = [("child", "parent"), ("child", "child"), ("grandchild", "child"), ("x", "y"), ("y", "x"), ("x", "elsewhere")]
    run = run_tables(spark, runs, keys, MigrationConfig(mode="Mirror"))
    got = {r.target_table: r for r in run.summary().collect()}
    assert {k: r.status for k, r in got.items()} == {"child": BLOCKED, "grandchild": BLOCKED, "parent": FAILED, "other": COMPLETED, "x": COMPLETED, "y": COMPLETED}
    assert {k: r.level for k, r in got.items()} == {"parent": 0, "other": 0, "child": 1, "grandchild": 2, "x": 3, "y": 3}
    assert "no such file" in got["parent"].message and got["other"].duration_ms > 0
    assert (got["other"].rows_inserted, got["other"].rows_updated, got["other"].rows_deleted) == (1, 3, 1)
    assert sorted(map(tuple, run.result("other").collect())) == sorted(map(tuple, s.collect()))
    with pytest.raises(ValueError, match="not written"):
        run.result("child")
    assert {r.table_name: r.percent for r in run.progress().collect()}["other"] == 100.0


def test_cancel_interrupts_the_tables_under_way(spark):
    s, t = pair(spark, 4)
    slow = F.udf(lambda v: time.sleep(60) or v, "int")
    runs = [TableRun("slow", "slow", s.withColumn("v", slow("v")), t, ["id"]), TableRun("after", "after", s, t, ["id"])]
    run = TablesRun(spark, runs, [("after", "slow")])
    began = time.monotonic()
    threading.Timer(6, run.cancel).start()
    run.start()
    assert time.monotonic() - began < 40
    assert {t: o.status for t, o in run.outcomes.items()} == {"slow": CANCELLED, "after": CANCELLED}


def test_rows_that_do_not_fit_are_reported_and_left_out(spark):
    s = spark.createDataFrame([(1, 3_000_000_000, "2024-01-01"), (2, 5, "never"), (3, 6, "2024-02-03"), (4, 7, None)], "id long, n long, d string")
    t = spark.sql("SELECT 1 AS id, 1 AS n, DATE'2020-01-01' AS d UNION ALL SELECT 9, 9, NULL")
    p = PL.plan(s, t, CompareConfig(keys=["id"]), MigrationConfig(mode="Mirror"))
    out = {r.id: (r.n, str(r.d)) for r in A.apply_plan(t, p).collect()}
    assert out == {1: (1, "2020-01-01"), 3: (6, "2024-02-03"), 4: (7, "None")}
    bad = {r.id: r.errors for r in A.rejected_rows(t, p).collect()}
    assert bad == {1: ["Column 'n' cannot hold the value as int"], 2: ["Column 'd' cannot hold the value as date"]}
    assert A.apply_plan(t, p).schema.simpleString() == t.schema.simpleString()


def test_a_cast_that_spark_lacks_rejects_the_row(spark):
    s = spark.createDataFrame([(1, 5.0), (2, None)], "id long, v double")
    t = spark.sql("SELECT 3L AS id, DATE'2020-01-01' AS v")
    p = spark.createDataFrame([("insert", 1, (1, 5.0)), ("insert", 2, (2, None))], "action string, id long, row struct<id:long,v:double>")
    assert [r.id for r in A.rejected_rows(t, p).collect()] == [1]
    assert {r.id for r in A.apply_plan(t, p, ["id"]).collect()} == {2, 3}
    assert s.count() == 2


def test_keys_without_a_literal_make_no_statement(spark):
    rows = [(float("nan"), 1), (float("inf"), 2), (None, 3), (1.5, 4)]
    p = spark.createDataFrame([("delete", (k, v), v) for k, v in rows], "action string, row struct<k:double,v:int>, v int").withColumn("changed_columns", F.array().cast("array<string>"))
    made = {r.v: r.statement for r in render_dml(p, "PostgreSql", "t", ["k"]).collect()}
    assert made == {3: 'DELETE FROM "t" WHERE "k" IS NULL;', 4: 'DELETE FROM "t" WHERE "k" = 1.5;'}
    assert {r.v for r in unscripted(p, ["k"]).collect()} == {1, 2}


def test_column_names_may_hold_percent_signs(spark):
    df = spark.createDataFrame([("abcdef",)], "`disc%` string")
    row = validate(df, [ColumnRule("disc%", max_length=3)]).first()
    assert (row["disc%"], row.warnings) == ("abc", ["Truncated 'disc%': 6 -> 3 chars"])


def test_every_pair_of_types_gives_a_value_or_a_reject(spark):
    from parityflow.operators import type_mapping as M

    row = spark.sql(
        "SELECT 300 AS i, -1L AS l, 2.75D AS d, 12.50BD AS n, 'x' AS s, '7' AS t, TRUE AS b, X'41' AS x, DATE'2024-01-02' AS dt, "
        "TIMESTAMP'2024-01-02 03:04:05' AS ts, array(1, 2) AS a, map('k', 1) AS m, CAST(NULL AS INT) AS none"
    )
    kinds = [("Boolean", None, None), ("TinyInt", None, None), ("SmallInt", None, None), ("Int", None, None), ("BigInt", None, None), ("Float", None, None), ("Double", None, None),
             ("Decimal", 5, 2), ("Char", 3, None), ("Varchar", 2, None), ("Text", None, None), ("Binary", 2, None), ("Blob", None, None), ("Date", None, None), ("DateTime", None, None), ("Timestamp", None, None), ("Json", None, None)]
    for kind, p, s in kinds:
        got = M.cast_rows(row, [(c, kind, p, s) for c in row.columns], "MySql").first()
        rejected = {r.split(":")[0] for r in got.reasons}
        for c in row.columns:
            assert (got.row[c] is None) == (c == "none" or c in rejected), (kind, c)
    audit = {e: M.cast_loss_audit(row, [("i", "TinyInt", None, None), ("l", "TinyInt", None, None)], engine=e).collect() for e in ("SqlServer", "MySql")}
    assert {e: [r.overflow for r in rows] for e, rows in audit.items()} == {"SqlServer": [1, 1], "MySql": [1, 0]}
    wide = spark.sql("SELECT CAST('12345678901234567.25' AS DECIMAL(25,2)) AS n")
    assert M.cast_loss_audit(wide, [("n", "BigInt", None, None)]).first().decimals_lost == 1
    assert M.cast_plan(spark, {}, "MySql", "Oracle") == []
    plan = dict((c, k) for c, *k in M.cast_plan(spark, {"a": "tinyint(1)", "b": "decimal(12,3)", "c": "text", "d": "varchar(7)"}, "MySql", "SqlServer"))
    assert plan["a"][0] == "Boolean" and plan["b"] == ["Decimal", 12, 3] and plan["d"][1] == 7


def test_tables_are_compared_ahead_of_their_parents_results(spark, tmp_path):
    s, t = pair(spark, 4)
    broken = s.withColumn("v", F.raise_error(F.lit("no such file")).cast("int"))
    runs = [TableRun("a", "child", s, t, ["id"]), TableRun("b", "parent", broken, t, ["id"])]
    run = run_tables(spark, runs, [("child", "parent")], MigrationConfig(mode="Mirror"), folder=str(tmp_path / "run"))
    assert {t: o.status for t, o in run.outcomes.items()} == {"child": BLOCKED, "parent": FAILED}
    assert spark.read.parquet(f"{run.path('child')}/rows").count() == 5
    assert not (tmp_path / "run" / "table-0" / "result").exists()


def test_a_planned_delete_ships_no_cells(spark):
    s, t = pair(spark, 4)
    p = PL.plan(s, t, CompareConfig(keys=["id"]), MigrationConfig(mode="Mirror"))
    assert sorted(map(tuple, A.apply_plan(t, p).collect())) == sorted(map(tuple, s.collect()))
    plan = A.apply_plan(t, p)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"CASE WHEN \(action#\d+ = update\) THEN row#\d+ END AS __row", plan)
