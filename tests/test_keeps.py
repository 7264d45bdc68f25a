"""Rows that must not be lost or altered without notice."""

from parityflow import CompareConfig, MigrationConfig
from parityflow.functions.sqltext import quote_name
from parityflow.operators.transform import Default
from parityflow.plans.apply import migrate, sync
from parityflow.plans.plan import plan
from parityflow.plans.script import render_dml
from parityflow.sources.store import VersionedTable
from parityflow.streaming.changes import apply_batch, apply_stream

ID = CompareConfig(keys=["id"])


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_sync_keeps_target_rows_that_share_a_key(spark):
    source = spark.createDataFrame([(1, "a")], "id long, v string")
    target = spark.createDataFrame([(9, "x"), (9, "y"), (1, "b")], "id long, v string")
    assert rows(sync(source, target, ID)) == [(1, "a"), (9, "x"), (9, "y")] == rows(migrate(source, target, ID)[0])


def test_first_batch_follows_flag_and_mode(spark, tmp_path):
    batch = spark.createDataFrame([(1, 1, None), (2, 1, False), (3, 1, True)], "id long, v long, gone boolean")
    store = VersionedTable(spark, f"{tmp_path}/a", ["id"])
    assert apply_batch(store, batch, "s-0", ["v"], delete_flag="gone")
    assert rows(store.read().select("id")) == [(1,), (2,)]
    store = VersionedTable(spark, f"{tmp_path}/b", ["id"])
    apply_batch(store, batch.drop("gone"), "s-0", ["v"], MigrationConfig(mode="SchemaOnly"))
    assert rows(store.read()) == []


def test_batches_count_per_stream(spark, tmp_path):
    store = VersionedTable(spark, f"{tmp_path}/t", ["id"])
    one = lambda i: spark.createDataFrame([(i, i)], "id long, v long")
    assert apply_batch(store, one(1), "a-0", ["v"]) and apply_batch(store, one(2), "b-0", ["v"]) and apply_batch(store, one(3), "a-1", ["v"])
    assert not apply_batch(store, one(4), "a-0", ["v"]) and not apply_batch(store, one(4), "b-0", ["v"])
    assert rows(store.read().select("id")) == [(1,), (2,), (3,)]


def test_two_streams_feed_one_store(spark, tmp_path):
    store = VersionedTable(spark, f"{tmp_path}/t", ["id"])
    for n in (2, 3):
        spark.createDataFrame([(n, n)], "id long, v long").write.parquet(f"{tmp_path}/in{n}")
        changes = spark.readStream.schema("id long, v long").parquet(f"{tmp_path}/in{n}")
        apply_stream(changes, store, f"{tmp_path}/check{n}", ["v"]).awaitTermination()
    assert rows(store.read().select("id")) == [(2,), (3,)]


def test_script_of_null_keys_and_odd_names(spark):
    target = spark.createDataFrame([(None, "x")], "id long, v string")
    source = spark.createDataFrame([(None, "y")], "id long, v string")
    text = render_dml(plan(source, target, ID), "PostgreSql", 't"t', ["id"]).select("statement").first()[0]
    assert 'WHERE "id" IS NULL;' in text and text.startswith('UPDATE "t""t" SET')
    assert quote_name("a]b", "SqlServer") == "[a]]b]"


def test_default_keeps_a_boolean(spark):
    df = Default("b", True).apply(spark.createDataFrame([(None,), (False,)], "b boolean"))
    assert df.dtypes == [("b", "boolean")] and rows(df) == [(False,), (True,)]
