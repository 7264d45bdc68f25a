"""Changes into databases (against stand-in connections; no database is started), checksums and bands."""

import datetime
import json
import random
import re

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from parityflow.config import CompareConfig
from parityflow.operators import buckets as B
from parityflow.operators import compare as C
from parityflow.operators.bands import Band, band_diff, band_pairs
from parityflow.sources.changes_writer import ChangesWriter, Counts, Statements, write_changes

ROW = {"id": 1, "na%me": "x", "ok": True}


class StandIn:
    """A connection that keeps its calls; rows whose name is 'bad' fail."""

    def __init__(self):
        self.calls, self.open, self.log = [], True, []

    def cursor(self):
        return self

    def executemany(self, text, rows):
        if any("bad" in map(str, r) for r in rows):
            raise RuntimeError("constraint")
        self.calls.append((text, list(rows)))

    def write(self, name, operations):
        self.calls.append((name, operations))

    def commit(self):
        self.log.append("commit")

    def rollback(self):
        self.log.append("rollback")

    def close(self):
        self.open = False


@pytest.mark.parametrize("engine,update,insert", [
    ("SqlServer", "UPDATE [t] SET [na%me] = ?, [ok] = ? WHERE [id] = ?",
     "INSERT INTO [t] ([id], [na%me], [ok]) SELECT ?, ?, ? WHERE NOT EXISTS (SELECT 1 FROM [t] WHERE [id] = ?)"),
    ("PostgreSql", 'UPDATE "t" SET "na%%me" = %s, "ok" = %s WHERE "id" = %s',
     'INSERT INTO "t" ("id", "na%%me", "ok") SELECT %s, %s, %s WHERE NOT EXISTS (SELECT 1 FROM "t" WHERE "id" = %s)'),
    ("MySql", "UPDATE `t` SET `na%%me` = %s, `ok` = %s WHERE `id` = %s",
     "INSERT INTO `t` (`id`, `na%%me`, `ok`) SELECT %s, %s, %s FROM dual WHERE NOT EXISTS (SELECT 1 FROM `t` WHERE `id` = %s)"),
    ("Sqlite", 'UPDATE "t" SET "na%me" = ?, "ok" = ? WHERE "id" = ?',
     'INSERT INTO "t" ("id", "na%me", "ok") SELECT ?, ?, ? WHERE NOT EXISTS (SELECT 1 FROM "t" WHERE "id" = ?)'),
    ("Oracle", 'UPDATE "t" SET "na%me" = :1, "ok" = :2 WHERE "id" = :3',
     'INSERT INTO "t" ("id", "na%me", "ok") SELECT :1, :2, :3 FROM dual WHERE NOT EXISTS (SELECT 1 FROM "t" WHERE "id" = :4)'),
])
def test_statements_of_sql_engines(engine, update, insert):
    made = Statements(engine, "t", ["id"])
    yes = 1 if engine in ("SqlServer", "Oracle") else True
    assert made.statement("update", ROW, None) == (update, ("x", yes, 1))
    assert made.statement("insert", ROW, None) == (insert, (1, "x", yes, 1))
    text, values = made.statement("delete", ROW | {"id": None}, None)
    assert text.endswith("IS NULL") and values == ()
    assert made.statement("update", ROW, ["id"]) is None
    assert made.statement("update", ROW, ["ok"])[1] == (yes, 1)


@pytest.mark.parametrize("engine", ["MongoDb", "CosmosDb"])
def test_operations_of_document_stores(engine):
    made = Statements(engine, "t", ["id"])
    assert made.operation("update", ROW, ["ok"]) == ("update", {"filter": {"id": 1}, "set": {"ok": True}})
    assert made.operation("insert", ROW, None) == ("insert", {"filter": {"id": 1}, "set_on_insert": ROW})
    assert made.operation("delete", ROW, None) == ("delete", {"filter": {"id": 1}})
    assert made.operation("update", ROW, []) is None


def test_values_are_bound_not_pasted():
    made = Statements("Sqlite", 'a"b', ["id"])
    row = {"id": 1, "v": "'; DROP TABLE x; --", "n": Row(a=1, b=[1, None]), "d": datetime.date(2024, 1, 2), "f": float("nan")}
    text, values = made.statement("update", row, None)
    assert "DROP" not in text and '"a""b"' in text
    assert values == ("2024-01-02", None, '{"a": 1, "b": [1, null]}', "'; DROP TABLE x; --", 1)
    with pytest.raises(ValueError):
        Statements("Nope", "t", ["id"])
    with pytest.raises(ValueError):
        Statements("Sqlite", "t", [])


def rows_of(names):
    return [Row(action="insert", row=Row(id=float(i), name=n), changed=None) for i, n in enumerate(names)]


def test_a_bad_row_costs_itself_only():
    held = StandIn()
    rows = [*rows_of(["a", "bad", "c"]), Row(action="update", row=Row(id=float("nan"), name="x"), changed=["name"]), Row(action="update", row=Row(id=1.0, name="x"), changed=[])]
    seen = []
    writer = ChangesWriter(lambda: held, Statements("Sqlite", "t", ["id"]), 10, seen.append)
    counts = writer.write(iter(rows))
    assert (counts.inserted, counts.updated, counts.skipped, counts.errors) == (2, 0, 1, 2)
    assert any("constraint" in s for s in counts.samples) and any("nan" in s for s in counts.samples)
    assert held.log == ["rollback", "commit", "rollback", "commit"] and not held.open
    writer.commit([counts, None])
    writer.abort([None])
    assert seen == [[counts], []]


def test_batches_are_bounded_and_grouped_by_text():
    held = StandIn()
    counts = ChangesWriter(lambda: held, Statements("PostgreSql", "t", ["id"]), 4).write(iter(rows_of("abcdefghij")))
    assert counts.inserted == 10 and [len(r) for _, r in held.calls] == [4, 4, 2] and len({t for t, _ in held.calls}) == 1


def test_a_plan_is_carried_out_by_the_tasks(spark, tmp_path):
    folder = str(tmp_path)

    def connect():
        import os
        import uuid

        class ToFile:
            """Writes its calls to a file, as tasks live in other processes."""

            def __init__(self):
                self.calls = []

            def cursor(self):
                return self

            def executemany(self, text, rows):
                self.calls += [(text, list(r)) for r in rows]

            def commit(self):
                pass

            rollback = commit

            def close(self):
                if self.calls:
                    with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                        json.dump(self.calls, f)
                    self.calls = []

        return ToFile()

    def report(counts):
        with open(folder + "/report.json", "w") as f:
            json.dump([sum(c.inserted for c in counts), sum(c.updated for c in counts), sum(c.deleted for c in counts)], f)

    from parityflow.config import MigrationConfig
    from parityflow.plans.plan import plan

    s = spark.createDataFrame([(i, f"n{i}") for i in range(20)], "id long, name string")
    t = spark.createDataFrame([(i, f"n{i}" if i % 2 else "old") for i in range(5, 25)], "id long, name string")
    p = plan(s, t, CompareConfig(keys=["id"]), MigrationConfig(mode="Mirror"))
    write_changes(p, "PostgreSql", "t", connect, ["id"], tasks=3, report=report)
    calls = [c for f in tmp_path.iterdir() if f.name != "report.json" for c in json.loads(f.read_text())]
    kinds = [re.match(r"\w+", t).group() for t, _ in calls]
    assert {k: kinds.count(k) for k in set(kinds)} == {"INSERT": 5, "UPDATE": 7, "DELETE": 5}
    assert json.loads((tmp_path / "report.json").read_text()) == [5, 7, 5]
    assert isinstance(Counts().samples, list)


# -- checksums of buckets ---------------------------------------------------------------------------
def random_pair(spark, seed, n=120):
    r = random.Random(seed)
    rows = [(r.choice([None, *range(n // 2)]), r.choice(["a", "B ", None]), r.random() * r.choice([1, float("nan")]), i) for i in range(n)]
    other = [(k, v if r.random() > 0.1 else "z", x + (0.001 if r.random() < 0.3 else 0), i) for k, v, x, i in rows if r.random() > 0.05]
    schema = "id int, name string, x double, o int"
    return spark.createDataFrame(rows, schema), spark.createDataFrame(other, schema)


@pytest.mark.parametrize("options", [{}, {"numeric_tolerance": 0.01}, {"case_insensitive": True, "normalize_whitespace": True}, {"ignore_columns": ["name"]}])
def test_changed_rows_are_those_of_the_diff(spark, options):
    s, t = random_pair(spark, 3)
    cfg = CompareConfig(keys=["id"], order_by=["o"], **options)
    shown = lambda d: sorted((repr(r.id), r.status, repr(r.source), repr(r.target), r.changed_columns) for r in d.collect())
    want = shown(C.diff(s, t, cfg).filter("status <> 'matched'"))
    for n in (1, 7, 1_000):
        assert shown(B.changed_rows(s, t, cfg, n)) == want


def test_equal_buckets_move_no_rows(spark):
    base = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    keys = ["l_orderkey", "l_linenumber"]
    few = base.withColumn("l_tax", F.when(F.col("l_orderkey") == 77, 9.0).otherwise(F.col("l_tax")))
    cfg = CompareConfig(keys=keys, order_by=["l_shipdate", "l_partkey"])
    differing = [r.bucket for r in B.differing_buckets(base, few, cfg, 4_096).collect()]
    held = base.filter("l_orderkey = 77").select(*keys).distinct().count()
    assert 0 < len(differing) <= held
    assert B.with_bucket(base, keys, 4_096).filter(F.col(B.BUCKET).isin(differing)).count() < base.count() / 20
    text = B.changed_rows(base, few, cfg)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "CartesianProduct" not in text
    with pytest.raises(ValueError):
        B.changed_rows(base, few, cfg, 0)


# -- bands ------------------------------------------------------------------------------------------
def test_bands_are_those_of_all_pairs(spark):
    r = random.Random(5)
    value = lambda: r.choice([0.0, -0.0, None, float("nan"), r.uniform(-5, 5), r.uniform(90, 110), -100.5, 1e300])
    day = lambda: r.choice([None, datetime.date(2024, 1, r.randint(1, 28))])
    rows = lambda n: [(i, r.choice(["a", "b", None]), value(), day()) for i in range(n)]
    a, b = rows(60), rows(70)
    schema = "id int, k string, v double, d date"
    s, t = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)

    def near(x, y, width, relative):
        return x is not None and y is not None and x == x and y == y and abs(x - y) <= (abs(x) * width if relative else width)

    def days(x):
        return None if x is None else float((x - datetime.date(1970, 1, 1)).days)

    for width, relative in ((0.01, True), (0.5, True), (1.5, False)):
        got = band_pairs(s, t, [("upper(k)", "upper(k)")], [Band("v", "v", width, relative), Band("d", "d", 3.0)], "source.id <> target.id + 1000")
        want = {(x[0], y[0]) for x in a for y in b if x[1] == y[1] and near(x[2], y[2], width, relative) and near(days(x[3]), days(y[3]), 3.0, False)}
        assert sorted((p.source.id, p.target.id) for p in got.collect()) == sorted(want)
        d = band_diff(s, t, ["id"], ["id"], [("upper(k)", "upper(k)")], [Band("v", "v", width, relative), Band("d", "d", 3.0)])
        by = {st: {(q.source and q.source.id, q.target and q.target.id) for q in d.filter(F.col("status") == st).collect()} for st in ("matched", "inserted", "deleted")}
        assert by["matched"] == want
        assert by["inserted"] == {(x[0], None) for x in a} - {(i, None) for i, _ in want}
        assert by["deleted"] == {(None, y[0]) for y in b} - {(None, j) for _, j in want}


def test_a_band_is_an_equi_join(spark):
    s = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    text = band_pairs(s, s, [], [Band("o_totalprice", "o_totalprice", 0.01, True)])._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    for bad in (0, -1):
        with pytest.raises(ValueError):
            Band("a", "b", bad)
    with pytest.raises(ValueError):
        Band("a", "b", 1.0, True)
    with pytest.raises(ValueError):
        band_pairs(s, s, condition="source.o_orderkey < target.o_orderkey")


def test_pairs_of_bands_are_made_once_from_few_copies(spark):
    """Matched rows and rows without a partner read the written pairs; a target stands in one or two buckets of a band."""
    s = spark.createDataFrame([(i, float(i)) for i in range(1, 101)], "id int, v double")
    bands = [Band("v", "v", 0.01, True), Band("v", "v", 3.0)]
    plan = band_diff(s, s, ["id"], ["id"], [], bands)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" not in plan and plan.count("Join LeftAnti") == 2
    pairs = band_pairs(s, s, [], bands)
    assert "explode(array_distinct(" in pairs._jdf.queryExecution().optimizedPlan().toString()
