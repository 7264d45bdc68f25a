"""Row diff: single cases, invariants and plan shapes."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from parityflow.config import CompareConfig, MigrationConfig
from parityflow.functions.keys import resolve_keys
from parityflow.operators import compare as C
from parityflow.operators.dedupe import dedupe_last
from parityflow.plans.apply import apply_plan, migrate, sync
from parityflow.plans.plan import parse_rules, plan

ID = CompareConfig(keys=["id"])
ROW = "id long, name string, amount double"


def status(d):
    return {(r["id"], r["status"], tuple(r["changed_columns"])) for r in d.collect()}


def frames(spark, source, target, schema=ROW):
    return spark.createDataFrame(source, schema), spark.createDataFrame(target, schema)


def test_mixed_changes(spark):
    s, t = frames(spark, [(1, "a", 1.0), (2, "b", 2.0), (3, "c", 3.0)], [(2, "b", 2.5), (3, "c", 3.0), (4, "d", 4.0)])
    assert status(C.diff(s, t, ID)) == {(1, "inserted", ()), (2, "updated", ("amount",)), (3, "matched", ()), (4, "deleted", ())}


@pytest.mark.parametrize("side", ["source", "target", "both"])
def test_empty_sides(spark, side):
    rows = [(1, "a", 1.0), (2, None, None)]
    s, t = frames(spark, [] if side != "target" else rows, [] if side != "source" else rows)
    expected = {"source": "deleted", "target": "inserted"}.get(side)
    assert {r["status"] for r in C.diff(s, t, ID).collect()} == ({expected} if expected else set())


def test_null_keys_match_and_do_not_equal_the_text_null(spark):
    schema = "k string, j string, v long"
    s, t = frames(spark, [(None, "x", 1), ("NULL", "x", 2), ("a|b", "c", 3)], [(None, "x", 1), ("a", "b|c", 3)], schema)
    d = C.diff(s, t, CompareConfig(keys=["k", "j"]))
    assert {(r["k"], r["j"], r["status"]) for r in d.collect()} == {
        (None, "x", "matched"), ("NULL", "x", "inserted"), ("a|b", "c", "inserted"), ("a", "b|c", "deleted"),
    }


def test_tolerance_also_for_number_texts(spark):
    schema = "id long, v string"
    s, t = frames(spark, [(1, "1.00"), (2, "1"), (3, "x"), (4, " 1")], [(1, "1.005"), (2, "1.5"), (3, "x"), (4, "1")], schema)
    got = {r["id"]: r["status"] for r in C.diff(s, t, replace(ID, numeric_tolerance=0.01)).collect()}
    assert got == {1: "matched", 2: "updated", 3: "matched", 4: "updated"}


def test_null_and_empty(spark):
    s, t = frames(spark, [(1, None, None), (2, "", 1.0)], [(1, "", None), (2, None, 1.0)])
    assert {r["status"] for r in C.diff(s, t, ID).collect()} == {"updated"}
    assert {r["status"] for r in C.diff(s, t, replace(ID, null_equals_empty=True)).collect()} == {"matched"}


def test_hash_input_is_not_ambiguous(spark):
    schema = "id long, a string, b string"
    s, t = frames(spark, [(1, "1;b=2", "3"), (2, None, "x"), (3, "NULL", "y")], [(1, "1", "2;b=3"), (2, "x", None), (3, None, "y")], schema)
    for hashed in (False, True):
        assert {r["status"] for r in C.diff(s, t, replace(ID, use_hash_mode=hashed)).collect()} == {"updated"}


def test_missing_columns_and_number_types(spark):
    s = spark.createDataFrame([(1, 5, "x")], "id int, n int, only_s string")
    t = spark.createDataFrame([(1, 5.0)], "id long, n double")
    assert status(C.diff(s, t, ID)) == {(1, "updated", ("only_s",))}


def test_nested_cells(spark):
    schema = "id long, tags array<string>, props map<string,long>"
    s, t = frames(spark, [(1, ["a"], {"k": 1}), (2, ["a"], {"k": 1})], [(1, ["a"], {"k": 1}), (2, ["b"], {"k": 2})], schema)
    for hashed in (False, True):
        assert status(C.diff(s, t, replace(ID, use_hash_mode=hashed))) == {(1, "matched", ()), (2, "updated", ("props", "tags"))}


def test_maps_compare_by_content_and_variants_by_text(spark):
    make = lambda order: spark.range(1).select(
        "id", F.map_from_arrays(F.array(*[F.lit(k) for k in order]), F.array(*[F.lit(ord(k)) for k in order])).alias("m"),
        F.array(F.create_map(F.lit("k"), F.lit(1))).alias("inner"), F.parse_json(F.lit('{"a":1}')).alias("doc"),
    )
    for hashed in (False, True):
        assert status(C.diff(make("ab"), make("ba"), replace(ID, use_hash_mode=hashed))) == {(0, "matched", ())}


def test_column_names_with_dots(spark):
    schema = "`a.id` long, `v.x` string"
    s, t = frames(spark, [(1, "p")], [(1, "q")], schema)
    row = C.diff(s, t, CompareConfig(keys=["a.id"])).first()
    assert (row["status"], row["changed_columns"]) == ("updated", ["v.x"])


def test_key_choice():
    assert resolve_keys(["name", "id"]) == ["id"]
    assert resolve_keys(["b", "a"]) == ["a", "b"]
    assert resolve_keys(["b", "a"], ["b"]) == ["b"]
    with pytest.raises(ValueError):
        resolve_keys(["a"], ["z"])


def test_last_row_wins_and_the_choice_repeats(spark):
    rows = [(1, "a", 1.0), (1, "b", 3.0), (1, "c", 2.0)]
    s = spark.createDataFrame(rows, ROW)
    assert dedupe_last(s, ["id"], ["amount"]).first()["name"] == "b"
    picks = {dedupe_last(s.repartition(n), ["id"]).first()["name"] for n in (1, 2, 3)}
    assert len(picks) == 1


def test_expression_match(spark):
    s, t = frames(spark, [(1, "Ann", 1.0), (2, "Bob", 2.0)], [(9, "ANN", 1.0)])
    d = C.expression_diff(s, t, [("lower(name)", "lower(name)")], CompareConfig(ignore_columns=["id", "name"]))
    assert {(r["match_0"], r["status"]) for r in d.collect()} == {("ann", "matched"), ("bob", "inserted")}


# -- invariants on random pairs, with repeated and NULL keys ---------------------------------
def random_frame(spark, seed, n):
    rng = random.Random(seed)
    rows = [(rng.choice([None, *range(n)]), rng.choice(["a", "b", None, ""]), float(rng.randrange(3))) for _ in range(n)]
    return spark.createDataFrame(rows, ROW)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_invariants(spark, seed):
    s, t = random_frame(spark, seed, 60), random_frame(spark, seed + 100, 60)
    one_s, one_t = dedupe_last(s, ["id"]), dedupe_last(t, ["id"])
    d = C.diff(s, t, ID)
    counts = C.diff_summary(d).first()
    assert counts["matched"] + counts["inserted"] + counts["updated"] == one_s.count()
    assert counts["matched"] + counts["deleted"] + counts["updated"] == one_t.count()
    assert status(d) == status(C.diff(s, t, replace(ID, use_hash_mode=True)))
    mirror = MigrationConfig(mode="Mirror")
    wanted = sorted(map(str, one_s.select("amount", "id", "name").collect()))
    assert sorted(map(str, apply_plan(one_t, plan(s, one_t, ID, mirror)).select("amount", "id", "name").collect())) == wanted
    assert sorted(map(str, sync(s, t, ID, mirror).select("amount", "id", "name").collect())) == wanted
    synced = sync(s, t, ID)
    again = C.diff_summary(C.diff(s, synced, ID)).first()
    assert (again["inserted"], again["updated"]) == (0, 0)
    assert synced.count() == migrate(s, t, ID)[0].count()


def test_matched_rows_of_a_hash_diff_have_one_form(spark):
    s, t = (spark.createDataFrame([(1, "a", x), (2, "b", 1.0), (3, "c", 5.0 * x)], ROW) for x in (1.0, 1.25))
    d = C.diff(s, t, replace(ID, use_hash_mode=True, numeric_tolerance=0.5)).collect()
    assert sorted((r["id"], r["status"], r["source"] is None) for r in d) == [(1, "matched", True), (2, "matched", True), (3, "updated", False)]


def test_decimals_without_a_common_decimal_are_compared_by_their_digits(spark):
    s = spark.sql("SELECT 1 AS id, CAST('12345678901234567890123456789012345678' AS DECIMAL(38,0)) AS x UNION ALL SELECT 2, 5 UNION ALL SELECT 3, 100 UNION ALL SELECT 4, 0")
    t = spark.sql("SELECT 1 AS id, CAST(7 AS DECIMAL(38,10)) AS x UNION ALL SELECT 2, CAST(5 AS DECIMAL(38,10)) UNION ALL SELECT 3, CAST(100.5 AS DECIMAL(38,10)) UNION ALL SELECT 4, 0")
    got = {r["id"]: r["status"] for r in C.diff(s, t, ID).collect()}
    assert got == {1: "updated", 2: "matched", 3: "updated", 4: "matched"}


def test_unknown_order_columns_are_refused(spark):
    s = spark.createDataFrame([(1, "a", 1.0)], ROW)
    with pytest.raises(ValueError, match="order_by"):
        C.diff(s, s, replace(ID, order_by=["amuont"]))


def test_rows_of_a_hash_diff_are_not_lost_silently(spark):
    from parityflow.plans.apply import result_table
    from parityflow.plans.plan import decide

    s = random_frame(spark, 5, 40)
    with pytest.raises(Exception, match="hash diff"):
        result_table(decide(C.diff(s, s, replace(ID, use_hash_mode=True))), s.columns).collect()
    assert sync(s, s, replace(ID, use_hash_mode=True)).count() == s.count()


def test_delete_and_update_reach_all_copies(spark):
    t = spark.createDataFrame([(1, "a", 1.0), (1, "a", 1.0), (2, "b", 1.0)], ROW)
    s = spark.createDataFrame([(2, "c", 1.0)], ROW)
    out = apply_plan(t, plan(s, t, ID, MigrationConfig(mode="Mirror"))).collect()
    assert [(r["id"], r["name"]) for r in out] == [(2, "c")]


def test_rules():
    assert parse_rules(["a:target", "b", "c:source", "a:b:c"]) == {"a": "b:c", "c": "source"}
    with pytest.raises(ValueError):
        MigrationConfig(mode="Nonsense")


# -- plan shapes ---------------------------------------------------------------------------------
def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_exchange_per_side_and_no_nested_loop(spark):
    base = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = physical(C.diff(base, base.filter("o_orderkey > 5"), CompareConfig(keys=["o_orderkey"])))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange hashpartitioning") == 2
    assert text.count("WindowGroupLimit") == 4
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in text


def test_unread_columns_are_pruned(spark):
    base = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").withColumnRenamed("l_partkey", "id")
    cfg = CompareConfig(keys=["id"], ignore_columns=[c for c in base.columns if c not in ("id", "l_tax")], keys_unique=True)
    text = physical(C.diff_summary(C.diff(base, base, cfg)))
    assert "l_tax" in text and "l_shipdate" not in text.split("ReadSchema")[1]
    assert "l_comment" not in text


def test_promised_keys_skip_the_duplicate_check(spark):
    base = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    cfg = CompareConfig(keys=["o_orderkey"], keys_unique=True, keys_not_null=True)
    assert "Window" not in physical(C.diff(base, base, cfg))


def test_hash_mode_fetches_rows_of_marked_cells_without_another_join_of_the_tables(spark):
    s = spark.createDataFrame([(i if i else None, float(i % 7), str(i)) for i in range(300)], "id long, v double, w string")
    t = s.filter("id IS NULL OR id % 11 <> 0").withColumn("v", F.when(F.col("id") % 5 == 0, -1.0).otherwise(F.col("v")))
    t = t.unionByName(s.filter("id % 17 = 0").withColumn("id", F.col("id") + 1000))
    cfg = CompareConfig(keys=["id"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = C.diff(s, t, replace(cfg, use_hash_mode=True))
        assert "LeftSemi" not in made._jdf.queryExecution().optimizedPlan().toString()
        got = {(r.status, r.id, str(r.source), str(r.target), tuple(r.changed_columns)) for r in made.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = {(r.status, r.id, *((str(None),) * 2 if r.status == "matched" else (str(r.source), str(r.target))), tuple(r.changed_columns)) for r in C.diff(s, t, cfg).collect()}
    assert got == want and made.count() == len(want)


def test_hash_mode_keeps_matched_rows_quiet_that_share_a_cell_with_an_open_key(spark):
    s = spark.createDataFrame([("A", 1), ("b", 2), ("c", 3)], "k string, v int").selectExpr("k COLLATE UTF8_LCASE AS k", "v")
    t = spark.createDataFrame([("a", 1), ("B", 5), ("d", 4)], "k string, v int").selectExpr("k COLLATE UTF8_LCASE AS k", "v")
    got = {r.k.lower(): (r.status, r.source is None, r.target is None) for r in C.diff(s, t, CompareConfig(keys=["k"], use_hash_mode=True)).collect()}
    assert got == {"a": ("matched", True, True), "b": ("updated", False, False), "c": ("inserted", False, True), "d": ("deleted", True, False)}
