"""Registered history, audit, schedule, report, source and stream queries and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from parityflow.config import MigrationConfig
from parityflow.operators import compare as C
from parityflow.operators import history as H
from parityflow.plans import report as R
from parityflow.plans.apply import result_summary
from parityflow.plans.plan import plan
from parityflow.plans.validate import ColumnRule, TableRun, dry_run_report, progress_rows
from parityflow.functions.cron import matches_cron
from parityflow.session import shared_dir
from parityflow.sources import audit as AU
from parityflow.sources import catalog as CAT
from parityflow.sources.exports import csv_rows, display_rows, export_json
from parityflow.sources.paging import deep_page
from parityflow.sources.store import VersionedTable
from parityflow.sources.tables import page, profile_json_fields, read_query, read_table, row_counts
from parityflow.streaming.changes import apply_stream, dedupe_stream
from parityflow.suite import pairs as P
from parityflow.suite.diffs import ORDERS, ORDERS_DIFF
from parityflow.suite.schemas import CATALOG_SQL, _changes

QUERIES, ORACLES = {}, {}


def registered(sql=None):
    def wrap(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return wrap


# -- runs of jobs, read from the events -------------------------------------------------
def job_runs(spark, sf_dir):
    kind = F.col("event_type")
    status = F.when(kind == "error", "Failed").when(kind == "signup", "Cancelled").when(kind == "view", "Running").otherwise("Completed")
    return P.load(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.pmod("user_id", F.lit(20)).alias("job_id"), F.col("ts").alias("started_at"), status.alias("status")
    )


def jobs(spark, sf_dir):
    return job_runs(spark, sf_dir).groupBy("job_id").agg(
        F.concat(F.lit("job "), F.first("job_id")).alias("name"), F.lit(True).alias("any")
    ).select("job_id", "name", (F.col("job_id") % 3 != 0).alias("enabled"))


RUNS_SQL = """runs AS (SELECT event_id AS id, user_id % 20 AS job_id, ts AS started_at, CASE event_type WHEN 'error' THEN 'Failed'
 WHEN 'signup' THEN 'Cancelled' WHEN 'view' THEN 'Running' ELSE 'Completed' END AS status FROM events)"""


def _now(spark, sf_dir):
    """The last event counts as now (one value)."""
    last = P.load(spark, sf_dir, "events").agg(F.max("ts").cast("string")).first()[0]
    return F.lit(last).cast("timestamp_ntz")


@registered(f"WITH {RUNS_SQL} SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY started_at DESC, id DESC) AS rn FROM runs) WHERE rn = 1")
def latest_execution(spark, sf_dir):
    return H.latest_execution(job_runs(spark, sf_dir))


@registered(f"WITH {RUNS_SQL} SELECT * FROM runs WHERE job_id = 7")
def executions_of_job(spark, sf_dir):
    return H.executions_of(job_runs(spark, sf_dir), 7)


@registered(f"WITH {RUNS_SQL} SELECT * FROM runs WHERE started_at >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY")
def purge_history(spark, sf_dir):
    return H.purge(job_runs(spark, sf_dir), "started_at", 10, _now(spark, sf_dir))


@registered("SELECT count(*) AS purged FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 10 DAY")
def purge_history_count(spark, sf_dir):
    return H.purged_count(job_runs(spark, sf_dir), "started_at", 10, _now(spark, sf_dir))


@registered(f"""WITH {RUNS_SQL}, r AS (SELECT * FROM runs WHERE started_at >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY)
SELECT (SELECT count(DISTINCT job_id) FROM runs) AS total_jobs, (SELECT count(DISTINCT job_id) FROM runs WHERE job_id % 3 <> 0) AS enabled_jobs,
 (SELECT count(*) FROM r) AS runs_24h, (SELECT count(*) FROM r WHERE status = 'Failed') AS failed_24h""")
def dashboard_counts(spark, sf_dir):
    return H.dashboard_counts(jobs(spark, sf_dir), job_runs(spark, sf_dir), _now(spark, sf_dir))


@registered(f"WITH {RUNS_SQL} SELECT *, 'job ' || job_id AS job_name FROM runs ORDER BY started_at DESC, id DESC LIMIT 10")
def recent_feed(spark, sf_dir):
    return H.recent_feed(jobs(spark, sf_dir), job_runs(spark, sf_dir))


@registered(f"WITH {RUNS_SQL} SELECT * FROM runs ORDER BY started_at DESC, id DESC")
def history_listing(spark, sf_dir):
    return H.newest_first(job_runs(spark, sf_dir), "started_at", ["id"])


@registered(f"""WITH {RUNS_SQL} SELECT r.id, job_id, started_at, CASE WHEN id % 4 = 0 THEN 'Archived' ELSE status END AS status FROM runs r
 UNION ALL SELECT id + 1000000000, job_id, started_at, 'Archived' FROM runs WHERE id % 40 = 0""")
def history_replace(spark, sf_dir):
    """Whole rows replaced by id, unknown ids added; repeats within the new rows count once."""
    runs = job_runs(spark, sf_dir)
    fresh = runs.filter(P.every("id", 4)).withColumn("status", F.lit("Archived"))
    new = fresh.filter(P.every("id", 40)).withColumn("id", F.col("id") + 1_000_000_000)
    return H.replace_by_key(runs, fresh.unionByName(fresh).unionByName(new), ["id"])


_CRON_SQL = """minute({0}) % 15 = 0 AND hour({0}) BETWEEN 9 AND 17 AND dayofweek({0}) BETWEEN 1 AND 5"""


@registered(f"SELECT event_id, ts FROM events WHERE {_CRON_SQL.format('ts')}")
def cron_match_events(spark, sf_dir):
    return P.load(spark, sf_dir, "events").filter(matches_cron(F.col("ts"), "*/15 9-17 * * 1-5")).select("event_id", "ts")


@registered(f"""WITH m AS (SELECT unnest(generate_series((SELECT date_trunc('minute', min(ts))::TIMESTAMP FROM events), (SELECT max(ts) FROM events), INTERVAL 1 MINUTE)) AS due_at)
SELECT due_at FROM m WHERE {_CRON_SQL.format('due_at')} AND due_at NOT IN (SELECT date_trunc('minute', ts)::TIMESTAMP FROM events)""")
def missed_runs(spark, sf_dir):
    return H.missed_runs(job_runs(spark, sf_dir), "*/15 9-17 * * 1-5")


# -- audit lines ---------------------------------------------------------------------------
def audit_lines(spark, sf_dir):
    """Events as audit entries; every 50th line is cut in half."""
    ev = P.load(spark, sf_dir, "events")
    action = F.get(F.array(*[F.lit(a) for a in AU.ACTIONS]), F.pmod("event_id", F.lit(len(AU.ACTIONS))).cast("int"))
    entry = F.to_json(
        F.struct(
            F.col("event_id").cast("string").alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
            F.lit("ops").alias("user"), action.alias("action"),
            F.concat(F.lit("c"), F.pmod("user_id", F.lit(5))).alias("source_connection"),
            F.when(P.every("event_id", 2), F.concat(F.lit("c"), F.pmod("user_id", F.lit(7)))).alias("target_connection"),
            F.col("event_id").alias("affected_rows"),
        )
    )
    cut = F.when(P.every("event_id", 50), F.left(entry, F.floor(F.length(entry) / 2).cast("int"))).otherwise(entry)
    return ev.select(cut.alias("value"))


_ACTION_LIST = "[" + ", ".join(f"'{a}'" for a in AU.ACTIONS) + "]"
AUDIT_SQL = f"""entries AS (SELECT event_id::VARCHAR AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, 'ops' AS user,
 {_ACTION_LIST}[1 + event_id % {len(AU.ACTIONS)}] AS action, 'c' || (user_id % 5) AS source_connection,
 CASE WHEN event_id % 2 = 0 THEN 'c' || (user_id % 7) END AS target_connection, event_id AS affected_rows, NULL::VARCHAR AS details, ts
 FROM events WHERE event_id % 50 <> 0)"""


@registered(f"WITH {AUDIT_SQL} SELECT * EXCLUDE (ts) FROM entries")
def audit_read(spark, sf_dir):
    """Malformed lines are skipped."""
    return AU.parse_audit_lines(audit_lines(spark, sf_dir)).filter("NOT is_malformed").drop("is_malformed", "line")


@registered(f"""WITH {AUDIT_SQL} SELECT * EXCLUDE (ts) FROM entries WHERE timestamp >= '2024-01-10' AND timestamp <= '2024-01-20T12:00:00'
 AND action = 'MigrationFailed' AND (source_connection = 'c3' OR target_connection = 'c3')""")
def audit_filter(spark, sf_dir):
    entries = AU.parse_audit_lines(audit_lines(spark, sf_dir)).filter("NOT is_malformed").drop("is_malformed", "line")
    return H.audit_filter(entries, "2024-01-10", "2024-01-20T12:00:00", "MigrationFailed", "c3")


@registered("""SELECT event_id % 50 = 0 AS is_malformed, count(*) AS n FROM events
 WHERE event_id % 50 = 0 OR date_trunc('second', ts) >= (SELECT max(ts) FROM events) - INTERVAL 5 DAY GROUP BY 1""")
def audit_purge(spark, sf_dir):
    """The purge keeps young entries and every malformed line."""
    left = AU.purge_audit_lines(audit_lines(spark, sf_dir), 5, _now(spark, sf_dir))
    return AU.parse_audit_lines(left).groupBy("is_malformed").agg(F.count(F.lit(1)).alias("n"))


# -- reports and exports ----------------------------------------------------------------------
@registered(f"""WITH {CATALOG_SQL}, x AS (SELECT object_type, object_name, unnest(found) AS d FROM changes)
SELECT object_type AS section, object_name AS item, 'change' AS metric, lower(change_type) AS value FROM changes
UNION ALL SELECT object_type, object_name, d.p, coalesce(d.s, '?') || ' => ' || coalesce(d.t, '?') FROM x
UNION ALL SELECT 'compared', unnest(['source', 'target']), 'name', unnest(['a', 'b'])
UNION ALL SELECT 'objects', 'all', m, (SELECT count(*) FROM changes WHERE change_type = k)::VARCHAR FROM
 (VALUES ('additions', 'Added'), ('removals', 'Removed'), ('modifications', 'Modified'), ('unchanged', 'Unchanged')) AS v(m, k)""")
def schema_diff_report(spark, sf_dir):
    return R.schema_diff_report(_changes(spark, sf_dir), "a", "b")


@registered(ORDERS_DIFF + """, c AS (SELECT count(*) FILTER (WHERE status = 'inserted') AS i, count(*) FILTER (WHERE status = 'updated') AS u,
 count(*) FILTER (WHERE status = 'deleted') AS x FROM d),
m AS (SELECT unnest(['total_rows', 'processed_rows', 'inserted', 'updated', 'deleted', 'skipped', 'errors']) AS metric, unnest([i + u + x, i + u + x, i, u, x, 0, 0])::VARCHAR AS value FROM c)
SELECT 'totals' AS section, 'all' AS item, metric, value FROM m UNION ALL SELECT 'tables', 'orders', metric, value FROM m""")
def migration_report(spark, sf_dir):
    s, t = P.orders_pair(spark, sf_dir)
    cfg = MigrationConfig(mode="Mirror")
    progress = progress_rows("run-1", {"orders": result_summary(plan(s, t, ORDERS, cfg))})
    return R.migration_summary_report(progress, cfg, "Completed").filter("section IN ('totals', 'tables') AND metric <> 'status'")


@registered(ORDERS_DIFF + """, c AS (SELECT count(*) FILTER (WHERE status = 'inserted') AS i, count(*) FILTER (WHERE status = 'updated') AS u,
 count(*) FILTER (WHERE status = 'deleted') AS x FROM d),
m AS (SELECT unnest(['target_table', 'source_rows', 'inserts', 'updates', 'deletes', 'skips']) AS metric,
 unnest(['orders_copy', (SELECT count(*) FROM orders)::VARCHAR, '0', u::VARCHAR, x::VARCHAR, i::VARCHAR]) AS value FROM c)
SELECT 'tables' AS section, '* orders, ' || metric || ': ' || value AS line FROM m UNION ALL SELECT '', '# Dry run'
 UNION ALL SELECT s, '## ' || s FROM (VALUES ('settings'), ('tables'), ('warnings')) AS v(s)
 UNION ALL SELECT 'settings', '* run, ' || unnest(['mode: Mirror', 'policy: """ + MigrationConfig().policy + """', 'batch_size: """ + str(MigrationConfig().batch_size) + """'])
 UNION ALL SELECT 'warnings', '* orders, 1: Target column ''region'' is NOT NULL without default and missing from source - inserts will be skipped'""")
def plan_report(spark, sf_dir):
    """Settings, expected work and warnings of a dry run as lines of Markdown."""
    s, t = P.orders_pair(spark, sf_dir)
    cfg = MigrationConfig(mode="Mirror")
    rules = [ColumnRule(c) for c in t.columns] + [ColumnRule("region", False)]
    dry = dry_run_report([TableRun("orders", "orders_copy", s, t, ["o_orderkey"], rules)], cfg)
    return R.markdown(R.migration_plan_report(dry, cfg), "Dry run").select("section", "line")


@registered(ORDERS_DIFF + """ SELECT d.o_orderkey::VARCHAR AS "_rowId", d.status AS "_status", replace(d.changed, ',', ';') AS "_changedColumns",
 d.o_orderkey::VARCHAR AS o_orderkey, CASE WHEN d.status = 'deleted' THEN t.o_totalprice ELSE s.o_totalprice END::VARCHAR AS o_totalprice
 FROM d LEFT JOIN src s ON s.o_orderkey = d.o_orderkey LEFT JOIN tgt t ON t.o_orderkey = d.o_orderkey WHERE status <> 'matched'""")
def export_rows(spark, sf_dir):
    """What the CSV export writes for the differences."""
    s, t = P.orders_pair(spark, sf_dir)
    d = C.filter_status(C.diff(s, t, ORDERS), "inserted", "updated", "deleted")
    return csv_rows(display_rows(d, ["o_orderkey"], ["o_orderkey", "o_totalprice"]))


# -- sources -------------------------------------------------------------------------------------
@registered("SELECT * FROM supplier")
def scan_table(spark, sf_dir):
    return read_table(spark, "supplier", path=f"{sf_dir}/supplier.parquet")


@registered("SELECT n_name, count(*) AS customers FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def scan_query(spark, sf_dir):
    for name in ("customer", "nation"):
        P.load(spark, sf_dir, name).createOrReplaceTempView(name)
    return read_query(spark, "SELECT n_name, count(*) AS customers FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")


@registered("SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 100 OFFSET 300")
def scan_page(spark, sf_dir):
    return page(P.load(spark, sf_dir, "orders"), ["o_totalprice", "o_orderkey"], offset=300, descending=True)


_LINE_ORDER = ("l_shipdate", "l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax")


def _deep_sql(order, descending=False):
    listed = ", ".join(f"{c} DESC" if descending else c for c in order)
    return f"""SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (ORDER BY {listed}) AS place FROM lineitem)
 WHERE place > (SELECT count(*) // 2 FROM lineitem) AND place <= (SELECT count(*) // 2 FROM lineitem) + 100"""


@registered(_deep_sql(_LINE_ORDER))
def scan_page_deep(spark, sf_dir):
    """100 rows from the middle of lineitem by date."""
    lines = P.load(spark, sf_dir, "lineitem")
    return deep_page(lines, _LINE_ORDER, offset=lines.count() // 2, most=1_000)


@registered(_deep_sql(_LINE_ORDER, True))
def scan_page_deep_descending(spark, sf_dir):
    lines = P.load(spark, sf_dir, "lineitem")
    return deep_page(lines, _LINE_ORDER, offset=lines.count() // 2, descending=True, most=1_000)


@registered("""SELECT s_nationkey AS nation, count(*) AS n_rows, count(DISTINCT s_suppkey) AS n_keys FROM supplier GROUP BY 1""")
def export_json_rows(spark, sf_dir):
    """Suppliers written as JSON lines and read back."""
    path = f"{shared_dir(spark)}/json-{uuid.uuid4().hex}"
    export_json(P.load(spark, sf_dir, "supplier"), path)
    back = spark.read.schema("s_suppkey long, s_nationkey long").json(path)
    return back.groupBy(F.col("s_nationkey").cast("int").alias("nation")).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("s_suppkey").alias("n_keys"))


_COUNTED = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "conversations", "embeddings", "pages", "labels", "benchmark",
)


@registered(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in _COUNTED))
def table_row_counts(spark, sf_dir):
    return row_counts({t: P.load(spark, sf_dir, t) for t in _COUNTED})


@registered("""SELECT 'a' AS name, 'string' AS data_type, count(*) FILTER (WHERE event_id % 3 = 0) AS n_rows, false AS is_primary_key FROM events
 UNION ALL SELECT '_id', 'long', count(*), true FROM events UNION ALL SELECT 'b', 'bool', count(*) FILTER (WHERE event_id % 5 = 0), false FROM events
 UNION ALL SELECT 'k', 'long', count(*), false FROM events UNION ALL SELECT 'list', 'array', count(*), false FROM events
 UNION ALL SELECT 'sub', 'object', count(*), false FROM events UNION ALL SELECT 'value', 'double', count(*) FILTER (WHERE event_id % 2 = 0), false FROM events""")
def json_fields(spark, sf_dir):
    """Fields of a document column whose documents differ in shape."""
    inner = F.expr("substring(props, 2, length(props) - 2)")
    doc = F.concat(
        F.lit('{"_id":'), F.col("event_id").cast("string"), F.lit(","), inner, F.lit(',"list":[1],"sub":{"x":null}'),
        F.when(P.every("event_id", 3), F.lit(',"a":"t"')).otherwise(F.lit("")),
        F.when(P.every("event_id", 5), F.lit(',"b":true')).otherwise(F.lit("")),
        F.when(P.every("event_id", 2), F.concat(F.lit(',"value":1.5e1'), F.pmod("event_id", F.lit(10)).cast("string"))).otherwise(F.lit("")), F.lit("}"),
    )
    return profile_json_fields(P.load(spark, sf_dir, "events").select("event_id", doc.alias("doc")), "doc", ["event_id"])


def _information_schema(spark, sf_dir):
    """Catalog views as a database shows them, a column per part."""
    part = P.load(spark, sf_dir, "part")
    table, key = F.concat(F.lit("t"), F.pmod("p_partkey", F.lit(50))), F.col("p_partkey")
    col = F.concat(F.lit("c"), key)
    columns = part.select(
        table.alias("table_name"), col.alias("column_name"), F.lit("integer").alias("data_type"),
        F.when(P.every("p_partkey", 2), "YES").otherwise("NO").alias("is_nullable"), F.lit(None).cast("int").alias("character_maximum_length"),
        F.col("p_size").alias("numeric_precision"), F.lit(0).alias("numeric_scale"), F.lit(None).cast("string").alias("column_default"),
        F.floor(key / 50).alias("ordinal_position"),
    )
    kind = F.when(P.every("p_partkey", 3), F.lit("PRIMARY KEY")).otherwise(F.lit("UNIQUE"))
    name = F.concat(F.lit("k"), F.pmod("p_partkey", F.lit(150)))
    usage = part.select(table.alias("table_name"), name.alias("constraint_name"), col.alias("column_name"), key.alias("ordinal_position"))
    constraints = part.select(table.alias("table_name"), name.alias("constraint_name"), kind.alias("constraint_type")).distinct()
    return columns, constraints, usage


@registered("""SELECT 't' || (p_partkey % 50) AS table_name, 'c' || p_partkey AS name, 'integer' AS data_type, p_partkey % 2 = 0 AS is_nullable,
 p_partkey % 3 = 0 AS is_primary_key, NULL::INTEGER AS max_length, p_size AS precision, 0 AS scale, NULL::VARCHAR AS default_value,
 (p_partkey // 50)::INTEGER AS ordinal_position FROM part""")
def catalog_columns(spark, sf_dir):
    return CAT.assemble_columns(*_information_schema(spark, sf_dir))


@registered("""SELECT 't' || (p_partkey % 50) AS table_name, 'k' || (p_partkey % 150) AS name, CASE WHEN p_partkey % 3 = 0 THEN 'PrimaryKey' ELSE 'Unique' END AS constraint_type,
 string_agg('c' || p_partkey, ',' ORDER BY p_partkey) AS columns, NULL::VARCHAR AS referenced_table FROM part GROUP BY p_partkey % 50, p_partkey % 150, p_partkey % 3""")
def catalog_constraints(spark, sf_dir):
    _, constraints, usage = _information_schema(spark, sf_dir)
    return CAT.assemble_constraints(constraints, usage).withColumn("columns", F.concat_ws(",", "columns")).drop("referenced_columns")


@registered("""SELECT 't' || (p_partkey % 50) AS table_name, 'i' || (p_partkey % 150) AS name, string_agg('c' || p_partkey, ',' ORDER BY p_partkey) AS columns,
 p_partkey % 3 = 0 AS is_unique, false AS is_clustered, 'BTREE' AS index_type FROM part GROUP BY p_partkey % 50, p_partkey % 150, p_partkey % 3""")
def catalog_indexes(spark, sf_dir):
    part = P.load(spark, sf_dir, "part")
    flat = part.select(
        F.concat(F.lit("t"), F.pmod("p_partkey", F.lit(50))).alias("table_name"), F.concat(F.lit("i"), F.pmod("p_partkey", F.lit(150))).alias("index_name"),
        F.col("p_partkey").alias("position"), F.concat(F.lit("c"), "p_partkey").alias("column_name"),
        P.every("p_partkey", 3).alias("is_unique"), F.lit(False).alias("is_clustered"), F.lit("BTREE").alias("index_type"),
    )
    return CAT.assemble_indexes(flat).withColumn("columns", F.concat_ws(",", "columns"))


# -- store and streams ----------------------------------------------------------------------------
def _new_store(spark, keys):
    return VersionedTable(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", keys, buckets=16)


@registered("SELECT * FROM orders")
def store_publish_rollback(spark, sf_dir):
    """Publish, overwrite with a mirror of something else, go back."""
    s, t = P.orders_pair(spark, sf_dir)
    store = _new_store(spark, ["o_orderkey"])
    store.publish(s)
    store.publish(t)
    store.rollback()
    return store.read()


@registered(f"WITH {P.ORDERS_SQL} SELECT * FROM src UNION ALL SELECT * FROM tgt WHERE o_orderkey NOT IN (SELECT o_orderkey FROM src)")
def stream_apply_orders(spark, sf_dir):
    """A stream of orders applied to a versioned table."""
    source, target = P.orders_pair(spark, sf_dir)
    store = _new_store(spark, ["o_orderkey"])
    store.publish(target)
    changes = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/orders*.parquet")
    apply_stream(changes, store, f"{store.path}/_progress", ["o_orderdate"]).awaitTermination()
    return store.read()


@registered("SELECT event_id, event_type, value FROM events")
def stream_dedupe_events(spark, sf_dir):
    """Every event arrives twice and leaves once."""
    batch = P.load(spark, sf_dir, "events")
    stream = spark.readStream.schema(batch.schema).parquet(f"{sf_dir}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    twice = stream.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = (
        dedupe_stream(twice, ["event_id"], "ts").writeStream.format("parquet").option("path", f"{out}/rows")
        .option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("event_id", "event_type", "value")
