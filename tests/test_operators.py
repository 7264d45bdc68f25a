"""Rules, schedules, text, types, stores and streams on small frames."""

import datetime
import uuid

import pytest
from pyspark.sql import functions as F

from parityflow.config import CompareConfig, MigrationConfig
from parityflow.functions.cron import is_valid_cron, matches_cron, parse_cron
from parityflow.functions.vectors import cosine_similarity
from parityflow.operators.ranking import grouped_rank
from parityflow.operators.similarity import batch_top_k, similar_to
from parityflow.operators import similarity
from parityflow.operators.type_mapping import cast_to
from parityflow.operators.transform import Cast, Default, Drop, MapValues, Pipeline, Rename
from parityflow.plans.multitable import dependency_levels, run_order
from parityflow.plans.plan import assign_batches, plan
from parityflow.plans.validate import ColumnRule, required_but_absent, rules_from_schema, validate
from parityflow.sources.audit import read_audit
from parityflow.sources.exports import display_rows, export_csv, export_json, export_lines
from parityflow.sources.store import VersionedTable
from parityflow.sources.catalog import list_tables, schema_columns
from parityflow.sources.tables import jdbc_options, read_table
from parityflow.operators.compare import diff
from parityflow.streaming.changes import apply_batch, apply_stream


def test_rename_then_drop_and_drop_then_rename(spark):
    df = spark.createDataFrame([(1, 2)], "a long, b long")
    assert Pipeline([Rename("a", "b"), Drop("b")]).apply(df).columns == []
    assert Pipeline([Drop("b"), Rename("a", "b")]).apply(df).columns == ["b"]


def test_cast_leaves_other_texts_alone(spark):
    df = spark.createDataFrame([("007",), ("1e3",), ("12d",), (" 4",), (None,)], "v string")
    assert [r[0] for r in Cast("v", "number", "keep").apply(df).collect()] == ["7", "1000.0", "12d", " 4", None]
    assert [r[0] for r in Cast("v", "number").apply(df).collect()] == [7.0, 1000.0, None, None, None]


def test_number_texts(spark):
    values = [1.0, 1e7, 123456789.25, 0.001, 1e-4, 1.5e20, -2.5e8]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in Cast("v", "string").apply(df).collect()] == ["1.0", "10000000.0", "123456789.25", "0.001", "0.0001", "1.5e20", "-250000000.0"]


def test_value_map_null_and_default(spark):
    df = spark.createDataFrame([(None,), ("a",), ("b",)], "v string")
    assert [r[0] for r in MapValues("v", [(None, "n"), ("a", 1)]).apply(df).collect()] == ["n", "1", "b"]
    assert [r[0] for r in Default("v", "d").apply(df).collect()] == ["d", "a", "b"]


def test_validation(spark):
    df = spark.createDataFrame([("abcdef", None), ("ab", "x")], "s string, n string")
    rules = [ColumnRule("s", True, 3), ColumnRule("n", False), ColumnRule("gone", False, None, True)]
    rows = validate(df, rules).collect()
    assert (rows[0]["s"], rows[0]["is_valid"], rows[0]["warnings"]) == (
        "abc", False, ["Truncated 's': 6 -> 3 chars", "Column 'n' is NOT NULL without default but value is NULL"],
    )
    assert (rows[1]["s"], rows[1]["is_valid"], rows[1]["warnings"]) == ("ab", True, [])
    assert required_but_absent(["s"], [ColumnRule("n", False), ColumnRule("m", True)]) == ["n"]
    assert [r.name for r in rules_from_schema(df)] == ["s", "n"]


def test_cron():
    assert parse_cron("*/20 0 1,15 1-3 0")["minute"] == [0, 20, 40]
    for bad in ("* * * *", "61 * * * *", "*/0 * * * *", "5-1 * * * *", "a * * * *", "* * 0 * *", "* * * * 7"):
        assert not is_valid_cron(bad)


def test_cron_on_rows(spark):
    df = spark.createDataFrame([(datetime.datetime(2025, 6, 15, 14, 30),), (datetime.datetime(2025, 6, 16, 14, 30),), (None,)], "ts timestamp_ntz")
    assert [r[0] for r in df.select(matches_cron(F.col("ts"), "30 14 * * 0")).collect()] == [True, False, False]


def test_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), ([], []), (None, [1.0])]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>")
    assert [r[0] for r in df.select(cosine_similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, -1.0, 0.0, 0.0, 0.0, None]


def test_batch_top_k_is_the_same_for_any_block_size(spark, monkeypatch):
    vs = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    small = batch_top_k(vs, vs, 4).select("query_id", "match_id", "rank").collect()
    for name, rows in (("BLOCK_ROWS", 100), ("QUERY_BLOCK_ROWS", 150), ("STEP_QUERIES", 7)):
        monkeypatch.setattr(similarity, name, rows)
    blocks = batch_top_k(vs, vs, 4).select("query_id", "match_id", "rank").collect()
    assert sorted(small) == sorted(blocks)
    one = similar_to(vs, vs.filter("vec_id = 7").first()["embedding"], 4).collect()
    assert [r["vec_id"] for r in one] == [r["match_id"] for r in sorted(small, key=lambda r: r["rank"]) if r["query_id"] == 7]


def test_value_map_of_any_length_on_decimals_and_whole_numbers(spark):
    df = spark.sql("SELECT CAST(id AS DECIMAL(10,2)) AS d, CAST(id AS INT) AS i FROM range(60)")
    for n in (3, 50):
        got = MapValues("d", [(i, i + 100) for i in range(n)]).apply(df)
        assert got.schema["d"].dataType == df.schema["d"].dataType
        assert sorted(int(r["d"]) for r in got.collect()) == sorted(i + 100 if i < n else i for i in range(60))
    odd = MapValues("i", [(1.5, 7), (10**12, 7), (2.0, 77)]).apply(df).collect()
    assert sorted(r["i"] for r in odd) == sorted(77 if i == 2 else i for i in range(60))
    assert sorted(int(r["d"]) for r in MapValues("d", [(1.005, 7), (10**9, 7)]).apply(df).collect()) == list(range(60))


def test_whole_numbers_keep_their_digits(spark):
    df = spark.createDataFrame([("9007199254740993",), ("12345678901234567890",), ("1.5",), (None,)], "x string")
    assert [str(r["x"]) for r in Cast("x", "integer").apply(df).collect()] == ["9007199254740993", "12345678901234567890", "None", "None"]
    assert [r["x"] for r in Cast("x", "number", on_error="keep").apply(df).collect()][:2] == ["9007199254740993", "12345678901234567890"]


def test_whole_numbers_as_bytes(spark):
    good, bad = cast_to(spark.createDataFrame([(12,), (None,)], "n int"), [("n", "Blob", None, None)])
    assert [r["n"] and bytes(r["n"]) for r in good.collect()] == [b"12", None] and bad.count() == 0


def test_grouped_rank(spark):
    df = spark.range(200).select((F.col("id") * 7 % 200).alias("o"), F.when(F.col("id") < 150, 0).otherwise(1).alias("g"))
    got = grouped_rank(df, ["g"], "o", [50.0, 100.0, 150.0]).collect()
    for g in (0, 1):
        ordered = sorted((r for r in got if r["g"] == g), key=lambda r: r["o"])
        assert [r["rank"] for r in ordered] == list(range(1, len(ordered) + 1))


def test_batches(spark):
    s = spark.range(15).withColumn("v", F.lit("x"))
    p = plan(s, s.limit(0), CompareConfig(keys=["id"]))
    assert sorted(r["count"] for r in assign_batches(p, 4).groupBy("batch_id").count().collect()) == [3, 4, 4, 4]


def test_foreign_key_order(spark):
    names = ["items", "orders", "customers", "products", "a", "b", "self"]
    tables = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "table_name string, input_order int")
    edges = spark.createDataFrame(
        [("orders", "customers"), ("items", "orders"), ("items", "products"), ("orders", "customers"), ("a", "b"), ("b", "a"), ("self", "self"), ("items", "elsewhere")],
        "child string, parent string",
    )
    levels = dependency_levels(tables, edges)
    assert [r["table_name"] for r in run_order(levels, tables).collect()] == ["customers", "products", "self", "orders", "items", "a", "b"]


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / uuid.uuid4().hex)


def test_exports(spark, folder):
    s = spark.createDataFrame([(1, 'say "hi", ok', 1.0), (2, None, 2.0)], "id long, v string, n double")
    t = spark.createDataFrame([(1, "x", 1.0)], "id long, v string, n double")
    rows = display_rows(diff(s, t, CompareConfig(keys=["id"])), ["id"], ["id", "v"])
    export_csv(rows.coalesce(1), folder + "/csv")
    assert sorted(r[0] for r in spark.read.text(folder + "/csv").collect()) == [
        '1,updated,v,1,"say ""hi"", ok"', "2,inserted,,2,", "_rowId,_status,_changedColumns,id,v",
    ]
    export_json(rows, folder + "/json")
    assert spark.read.json(folder + "/json").count() == 2
    export_lines(rows, "_rowId", folder + "/text")
    assert sorted(r[0] for r in spark.read.text(folder + "/text").collect()) == ["1", "2"]


def test_audit_file(spark, folder):
    good = '{"id":"1","timestamp":"2025-01-01T00:00:00","user":"u","action":"JobExecuted","source_connection":null}'
    spark.createDataFrame([(good,), ("{broken",), ("",), ('{"id":"2"}',), (good.replace("JobExecuted", "Other"),)], "value string").write.text(folder)
    assert [r["id"] for r in read_audit(spark, folder).collect()] == ["1"]


def test_read_files(spark, folder):
    spark.range(5).write.csv(folder, header=True)
    assert read_table(spark, "any", path=folder, fmt="csv", options={"header": True}).count() == 5


def test_jdbc_ranges():
    options = jdbc_options({"url": "jdbc:x"}, "t", 500, "id", (1, 90), 8)
    assert options == {
        "url": "jdbc:x", "dbtable": "t", "fetchsize": "500", "partitionColumn": "id", "lowerBound": "1", "upperBound": "90", "numPartitions": "8",
    }
    assert "partitionColumn" not in jdbc_options({}, "t", 500, "id", (None, None), 8)


def test_catalog_of_the_session(spark, folder):
    spark.sql(f"CREATE TABLE parity_a (id BIGINT NOT NULL, price DECIMAL(9,2)) USING parquet LOCATION '{folder}'")
    spark.range(1).createOrReplaceTempView("parity_view")
    try:
        names = [r[0] for r in list_tables(spark).collect()]
        assert "parity_a" in names and "parity_view" not in names
        rows = schema_columns(spark, {"parity_a": spark.table("parity_a")}, {"parity_a": ["id"]}).collect()
        assert [(r["name"], r["data_type"], r["is_primary_key"], r["precision"], r["scale"], r["ordinal_position"]) for r in rows] == [
            ("id", "bigint", True, None, None, 1), ("price", "decimal(9,2)", False, 9, 2, 2),
        ]
    finally:
        spark.sql("DROP TABLE parity_a")
        spark.catalog.dropTempView("parity_view")


def test_store_versions(spark, folder):
    store = VersionedTable(spark, folder, ["id"], buckets=4)
    assert store.read() is None and store.rollback() is None
    store.publish(spark.range(10).withColumn("v", F.lit(1)))
    store.publish(spark.range(3).withColumn("v", F.lit(2)))
    assert store.read().count() == 3
    assert store.rollback() == 1 and store.read().count() == 10
    assert store.publish(spark.range(4).withColumn("v", F.lit(3))) == 3


def test_failed_publish_leaves_the_old_version(spark, folder):
    store = VersionedTable(spark, folder, ["id"], buckets=2)
    store.publish(spark.range(4).withColumn("v", F.lit(1)))
    broken = spark.range(4).withColumn("v", F.raise_error(F.lit("boom")).cast("int"))
    with pytest.raises(Exception):
        store.publish(broken)
    assert store.read().count() == 4


def test_batches_are_applied_once_and_touch_only_their_buckets(spark, folder):
    store = VersionedTable(spark, folder, ["id"], buckets=8)
    store.publish(spark.range(100).withColumn("v", F.lit("old")))
    before = store.manifest()["buckets"]
    batch = spark.createDataFrame([(3, "new", 1, False), (3, "newer", 2, False), (500, "add", 1, False), (4, "x", 1, True), (901, "x", 1, True)], "id long, v string, at int, gone boolean")
    batch = batch.drop("at").withColumn("v", F.col("v"))
    assert apply_batch(store, batch, "t1", ["v"], delete_flag="gone")
    assert not apply_batch(store, batch, "t1", ["v"], delete_flag="gone")
    rows = {r["id"]: r["v"] for r in store.read().collect()}
    assert rows[3] == "newer" and rows[500] == "add" and 4 not in rows and 901 not in rows and len(rows) == 100
    assert any(store.manifest()["buckets"].get(b) == v for b, v in before.items())


def test_stream_of_several_batches(spark, folder):
    store = VersionedTable(spark, folder + "/t", ["id"], buckets=4)
    for i in range(3):
        spark.createDataFrame([(k, i) for k in range(i, i + 5)], "id long, v int").coalesce(1).write.mode("append").parquet(folder + "/in")
    progress = []
    stream = spark.readStream.schema("id long, v int").option("maxFilesPerTrigger", 1).parquet(folder + "/in")
    apply_stream(stream, store, folder + "/c", ["v"], MigrationConfig(), on_progress=lambda c, tag: progress.append(c.first().asDict())).awaitTermination()
    assert {r["id"] for r in store.read().collect()} == set(range(7))
    # the first batch goes the same way as the later ones and reports its rows too
    assert [p["inserts"] for p in progress] == [5, 1, 1]


def test_a_block_of_vectors_is_held_once():
    """Neither the unit rows of a block nor the results of its queries are held several times over."""
    import tracemalloc

    import numpy as np
    import pandas as pd

    from parityflow.operators import similarity

    cells = pd.Series(list(np.random.default_rng(3).standard_normal((4000, 64))))
    ids = np.array([f"v{i}" for i in range(4000)], dtype=object)
    tracemalloc.start()
    rows = similarity._matrix(cells)
    used = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert used < 1.5 * rows[64][1].nbytes
    top = similarity._block_top(ids, rows, ids[:50], {64: (np.arange(50), rows[64][1][:50])}, 3)
    assert len(top) == 12000 and list(top.columns) == ["query_id", "match_id", "score"]
    assert (top.iloc[: 150 : 3]["query_id"] == top.iloc[: 150 : 3]["match_id"]).all()
