"""Reports as facts and lines, reason codes, and catalog texts in chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from parityflow.config import MigrationConfig
from parityflow.functions.text import identifier_problem, suspicious_reason
from parityflow.operators.similarity import schema_chunks, summary_chunks
from parityflow.plans.report import markdown, migration_summary_report


def test_a_summary_with_errors_reads_in_order(spark):
    counts = "total_rows long, processed_rows long, inserted long, updated long, deleted long, skipped long, errors long"
    progress = spark.createDataFrame([("a", "Completed", 5, 5, 2, 1, 1, 0, 1), ("b", "Failed", 4, 0, 0, 0, 0, 4, 0)], "table_name string, status string, " + counts)
    errors = spark.createDataFrame([("a", 3, "bad\nvalue"), ("b", None, "no table")], "table_name string, row_index long, message string")
    facts = migration_summary_report(progress, MigrationConfig(mode="Mirror"), "Failed", errors)
    got = {(r.section, r.item, r.metric): r.value for r in facts.collect()}
    assert got["totals", "all", "total_rows"] == "9" and got["totals", "all", "errors"] == "1" and got["run", "run", "status"] == "Failed"
    assert got["tables", "b", "skipped"] == "4" and got["failures", "a", "row 3"] == "bad\nvalue" and got["failures", "b", "table"] == "no table"
    lines = [r.line for r in markdown(facts, "Nightly").orderBy("section", "item", "metric").collect()]
    assert lines[:2] == ["# Nightly", "## failures"] and "* a, row 3: bad value" in lines and len(lines) == len(got) + 5


def test_reports_of_nothing_have_their_fixed_facts_only(spark):
    counts = ", ".join(f"{c} long" for c in ("total_rows", "processed_rows", "inserted", "updated", "deleted", "skipped", "errors"))
    none = spark.createDataFrame([], "table_name string, status string, " + counts)
    facts = migration_summary_report(none, MigrationConfig(), "Completed").collect()
    assert {r.section for r in facts} == {"run", "totals"} and all(r.value is None for r in facts if r.section == "totals")


def test_reason_codes(spark):
    texts = [("fine",), ("",), (None,), ("x" * 30,), ("a\0b",), ("a\x07",), ("..\\up",), ("x; drop table y",), ("é" * 11,)]
    df = spark.createDataFrame(texts, "t string")
    assert [r[0] for r in df.select(suspicious_reason(F.col("t"), 20)).collect()] == [None, None, None, "bytes:30", "nul", "control", "path", "sql:DROP TABLE", "bytes:22"]
    names = spark.createDataFrame([("ok_1",), ("",), (None,), ("a" * 129,), ("a\0",), ("1a",), ("a b",), ("Select",), ("a\n",)], "n string")
    assert [r[0] for r in names.select(identifier_problem(F.col("n"))).collect()] == [None, "empty", "empty", "bytes:129", "nul", "start", "character", "reserved", "character"]


def test_a_long_definition_goes_on_in_further_chunks(spark):
    columns = spark.range(7).select(
        F.lit("t").alias("table_name"), F.concat(F.lit("c"), "id").alias("name"), F.lit("int").alias("data_type"), F.lit(None).cast("int").alias("max_length"),
        (F.col("id") == 1).alias("is_nullable"), (F.col("id") == 0).alias("is_primary_key"), F.col("id").alias("ordinal_position"),
    )
    indexes = spark.createDataFrame([("t", "ix", True, ["c0", "c1"], 0)], "table_name string, name string, is_unique boolean, columns array<string>, ordinal_position int")
    constraints = spark.createDataFrame([("t", "fk", "ForeignKey", ["c2"], 0)], "table_name string, name string, constraint_type string, columns array<string>, ordinal_position int")
    rows = spark.createDataFrame([], "table_name string, row_count long")
    got = sorted((r.id, r.content.split("\n")) for r in schema_chunks(columns, indexes, constraints, rows, "k", "shop", lines_per_chunk=4).collect())
    assert [i for i, _ in got] == ["k/public/t#0", "k/public/t#1", "k/public/t#2"]
    assert all(lines[0] == "public.t, rows: ?" and len(lines) <= 5 for _, lines in got)
    body = [line for _, lines in got for line in lines[1:]]
    assert body[:2] == ["column c0 int, key", "column c1 int, optional"] and body[-2:] == ["unique index ix on c0, c1", "ForeignKey fk on c2"] and len(body) == 9


def test_table_names_are_all_listed_once(spark):
    tables = spark.range(400).select(F.concat(F.lit("t"), F.col("id") % 200).alias("table_name")).unionByName(spark.createDataFrame([(None,)], "table_name string"))
    chunks = summary_chunks(tables, "k", "shop", "MySql", names_per_chunk=40).collect()
    names = [n for r in chunks for n in r.content.split("\n")[1:]]
    assert len(chunks) == 5 and sorted(names) == sorted(f"t{i}" for i in range(200)) and all("tables: 200" in r.content for r in chunks)
    assert summary_chunks(tables.limit(0), "k", "shop", "MySql").count() == 0
