"""Deep pages, even ranges of database tables, counts of lost rows."""

import datetime
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from parityflow.config import CompareConfig
from parityflow.operators import compare as C
from parityflow.sources.paging import deep_page, range_bounds
from parityflow.sources.ranges import bounds_query, quoted_table, range_predicates
from parityflow.sources.tables import page


@pytest.mark.parametrize("descending", [False, True])
def test_deep_page_is_the_page(spark, descending):
    r = random.Random(4)
    pick = lambda: r.choice([None, float("nan"), -0.5, 7.0, 7.0, 7.0, r.random()])
    df = spark.createDataFrame([(pick(), r.choice([None, "a", "b'"]), i) for i in range(3_000)], "v double, `t.x` string, id long").repartition(6).cache()
    order = ["v", "t.x", "id"]
    for offset in (0, 1_499, 2_990, 3_000, 9_000):
        want = page(df, order, 20, offset, descending)
        got = deep_page(df, order, 20, offset, descending, ranges=8, most=100)
        assert [r.id for r in got.collect()] == [r.id for r in want.collect()]
    assert deep_page(df.limit(0), order, 5, 0).count() == 0
    assert deep_page(df, order, 0, 10, most=100).count() == 0


def test_deep_page_sorts_few_rows(spark):
    """One value holds a third of the rows; what is sorted still stays under the bound."""
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 1000).alias("v"), "id")
    got = deep_page(df, ["v", "id"], 10, 9_000, ranges=16, most=1_000)
    sorted_rows = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in sorted_rows
    inside = spark.createDataFrame(got.collect(), got.schema)
    assert [tuple(r) for r in inside.collect()] == [tuple(r) for r in page(df, ["v", "id"], 10, 9_000).collect()]
    bounds = range_bounds(df, ["v", "id"], 30_000, 16)
    assert 8 <= len(bounds) <= 15 and bounds == sorted(bounds)


def test_deep_page_of_rows_that_share_one_key(spark):
    df = spark.range(2_000).select(F.lit(datetime.date(2024, 1, 1)).alias("d"), "id")
    assert deep_page(df, ["d"], 10, 500, most=100).count() == 10


@pytest.mark.parametrize("engine, columns", [("PostgreSql", ["k"]), ("PostgreSql", ["hot", "k"]), ("Sqlite", ["te\"xt", "k"]), ("PostgreSql", ["d", "k"])])
def test_ranges_of_a_table_in_this_process(engine, columns):
    con = duckdb.connect()
    con.execute("""CREATE TABLE "odd ""t" AS SELECT CASE WHEN i % 50 <> 0 THEN i * i * i END AS k, CASE WHEN i % 3 = 0 THEN 7 ELSE i END AS hot,
     chr((97 + i % 26)::INT) || '''' || i % 7 AS "te""xt", DATE '2024-01-01' + (i % 30)::INT AS d FROM range(6000) r(i)""")
    bounds = con.execute(bounds_query('odd "t', columns, engine, 16)).fetchall()
    assert len(bounds) == 16
    parts = range_predicates(columns, bounds, engine)
    named = quoted_table('odd "t', engine)
    sizes = [con.execute(f"SELECT count(*) FROM {named} WHERE {p}").fetchone()[0] for p in parts]
    assert sum(sizes) == 6_000
    assert sizes[0] == 120 and max(sizes[1:]) <= 2 * 5_880 / 16


def test_range_statements():
    assert quoted_table("s.t]", "SqlServer") == "[s].[t]]]"
    query = bounds_query("s.t", ["a"], "MySql", 4)
    assert query.startswith("SELECT `a` FROM (SELECT `a`, part, ROW_NUMBER() OVER") and "NTILE(4) OVER (ORDER BY `a`) AS part FROM `s`.`t` WHERE `a` IS NOT NULL" in query
    day = datetime.datetime(2024, 5, 1, 2, 3)
    assert range_predicates(["a"], [(1,), (5,), (5,)], "SqlServer") == ["([a] IS NULL)", "[a] IS NOT NULL AND NOT (([a] >= 5)) AND [a] <= 5", "[a] IS NOT NULL AND (([a] >= 5)) AND [a] >= 5"]
    assert "TIMESTAMP '2024-05-01 02:03:00'" in range_predicates(["a"], [(day,), (day.replace(day=2),)], "Oracle")[1].replace("-02 ", "-01 ")
    assert range_predicates(["a"], [], "Sqlite") == ['("a" IS NULL)', '"a" IS NOT NULL']
    with pytest.raises(ValueError):
        range_predicates(["a"], [(True,), (False,)], "Sqlite")


def test_counts_of_lost_rows(spark):
    row = "id long, at long, name string"
    s = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (None, 1, "n"), (None, None, "m"), (2, 1, "c")], row)
    t = spark.createDataFrame([(1, 2, "b"), (3, 1, "x"), (3, 1, "x"), (3, 1, "y")], row)
    cfg = CompareConfig(keys=["id"], order_by=["at"])
    plain = {(r.id, r.status) for r in C.diff(s, t, cfg).collect()}
    d = C.diff_counted(s, t, cfg)
    assert {(r.id, r.status) for r in d.collect()} == plain
    assert {(r.id, r.source_lost, r.target_lost) for r in d.collect()} == {(1, 1, 0), (None, 1, 0), (2, 0, 0), (3, 0, 2)}
    assert C.diff_summary_errors(s, t, cfg).first().asDict() == {"matched": 1, "inserted": 2, "updated": 0, "deleted": 1, "errors": 4}
    empty = C.diff_summary_errors(s.limit(0), t.limit(0), cfg).first()
    assert tuple(empty) == (0, 0, 0, 0, 0)


def test_lost_rows_keep_one_exchange_per_side(spark):
    s = spark.range(100).select((F.col("id") % 7).alias("id"), F.col("id").alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = C.diff_counted(s, s.withColumn("v", F.col("v") + 1), CompareConfig(keys=["id"], order_by=["v"]))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange hashpartitioning") == 2
