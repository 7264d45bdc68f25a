"""Registered comparisons and their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from parityflow.config import CompareConfig
from parityflow.functions.hashing import row_hash
from parityflow.functions.keys import resolve_keys
from parityflow.operators import compare as C
from parityflow.operators.align import align
from parityflow.operators.bands import Band, band_diff
from parityflow.operators.buckets import changed_rows
from parityflow.operators.dedupe import dedupe_last, duplicate_keys, duplicate_rows
from parityflow.sources.tables import page
from parityflow.suite import pairs as P

ORDERS = CompareConfig(keys=["o_orderkey"])
LINES = CompareConfig(keys=P.LINE_KEYS, order_by=P.LINE_ORDER)
CUSTOMERS = CompareConfig(keys=["c_custkey"])


def narrow(d, keys):
    """Key, status and changed columns as text."""
    return d.select(*keys, "status", F.concat_ws(",", "changed_columns").alias("changed"))


def diff_sql(pair_sql, keys, columns, same=None, order=None):
    """The comparison as one full outer join; ``same`` overrides equality per column."""
    same = same or {}
    test = {c: same.get(c, "s.{c} IS NOT DISTINCT FROM t.{c}").format(c=c) for c in columns}
    on = " AND ".join(f"s.{k} IS NOT DISTINCT FROM t.{k}" for k in keys)
    all_same = " AND ".join(f"({x})" for x in test.values())
    changed = ", ".join(f"CASE WHEN NOT ({x}) THEN '{c}' END" for c, x in sorted(test.items()))
    picked = ", ".join(f"CASE WHEN s.here THEN s.{k} ELSE t.{k} END AS {k}" for k in keys)
    return f"""
WITH {pair_sql},
d AS (
  SELECT {picked},
         CASE WHEN t.here IS NULL THEN 'inserted' WHEN s.here IS NULL THEN 'deleted'
              WHEN {all_same} THEN 'matched' ELSE 'updated' END AS status,
         CASE WHEN s.here AND t.here THEN concat_ws(',', {changed}) ELSE '' END AS changed
  FROM (SELECT *, true AS here FROM src) s FULL OUTER JOIN (SELECT *, true AS here FROM tgt) t ON {on})
"""


NEARLY_SQL = P.LINEITEM_SQL[: P.LINEITEM_SQL.index("raw_tgt AS (")] + """raw_tgt AS (
  SELECT * REPLACE (CASE WHEN l_orderkey % 200 = 3 THEN l_tax + 0.5::DOUBLE ELSE l_tax END AS l_tax) FROM lineitem WHERE l_orderkey % 400 <> 7
  UNION ALL SELECT * REPLACE (l_orderkey + 100000000 AS l_orderkey) FROM lineitem WHERE l_orderkey % 400 = 11),
""" + P.LINEITEM_SQL[P.LINEITEM_SQL.index("src AS (") :]
BAND_SQL = f"""WITH {P.ORDERS_SQL},
p AS (SELECT s.o_orderkey AS source_key, t.o_orderkey AS target_key FROM src s JOIN tgt t ON s.o_custkey = t.o_custkey
  AND abs(s.o_totalprice - t.o_totalprice) <= abs(s.o_totalprice) * 0.01::DOUBLE
  AND abs(epoch_us(s.o_orderdate)::DOUBLE / 86400000000.0::DOUBLE - epoch_us(t.o_orderdate)::DOUBLE / 86400000000.0::DOUBLE) <= 3.0::DOUBLE)
SELECT 'matched' AS status, source_key, target_key FROM p
UNION ALL SELECT 'inserted', o_orderkey, NULL FROM src WHERE o_orderkey NOT IN (SELECT source_key FROM p)
UNION ALL SELECT 'deleted', NULL, o_orderkey FROM tgt WHERE o_orderkey NOT IN (SELECT target_key FROM p)"""
ORDERS_DIFF = diff_sql(P.ORDERS_SQL, ["o_orderkey"], P.ORDER_COLUMNS)
LINES_DIFF = diff_sql(P.LINEITEM_SQL, P.LINE_KEYS, P.LINE_COLUMNS)
TEXT_SAME = "lower(trim(regexp_replace(s.{c}, '\\s+', ' ', 'g'))) IS NOT DISTINCT FROM lower(trim(regexp_replace(t.{c}, '\\s+', ' ', 'g')))"
LOOSE = {"o_orderstatus": TEXT_SAME, "o_orderpriority": TEXT_SAME}
NEAR = "coalesce(abs(s.{c} - t.{c}) <= %s, s.{c} IS NOT DISTINCT FROM t.{c})"
COUNTS = (
    "SELECT count(*) FILTER (WHERE status = 'matched') AS matched, count(*) FILTER (WHERE status = 'inserted') AS inserted, "
    "count(*) FILTER (WHERE status = 'updated') AS updated, count(*) FILTER (WHERE status = 'deleted') AS deleted FROM d"
)


def _orders(spark, sf_dir, **options):
    s, t = P.orders_pair(spark, sf_dir)
    return C.diff(s, t, replace(ORDERS, **options))


def diff_orders_pk(spark, sf_dir):
    return narrow(_orders(spark, sf_dir), ["o_orderkey"])


def diff_summary_errors(spark, sf_dir):
    """Lineitem, whose keys repeat: counts of keys, and of the rows that lost theirs."""
    return C.diff_summary_errors(*P.lineitem_pair(spark, sf_dir), LINES)


def diff_lost_rows(spark, sf_dir):
    """Keys of lineitem that several rows of either side claim, with the status of the last one."""
    d = C.diff_counted(*P.lineitem_pair(spark, sf_dir), LINES)
    return d.filter("source_lost + target_lost > 0").select(*P.LINE_KEYS, "status", F.concat_ws(",", "changed_columns").alias("changed"), "source_lost", "target_lost")


def diff_default_keys(spark, sf_dir):
    """No keys given and no ``id``: every column together is the key."""
    s, t = P.customer_pair(spark, sf_dir)
    return narrow(C.diff(s, t), resolve_keys(s.columns))


def diff_id_key(spark, sf_dir):
    """No keys given, but there is an ``id``."""
    s, t = (x.withColumnRenamed("c_custkey", "id") for x in P.customer_pair(spark, sf_dir))
    return narrow(C.diff(s, t), ["id"])


def diff_lineitem_composite(spark, sf_dir):
    s, t = P.lineitem_pair(spark, sf_dir)
    return narrow(C.diff(s, t, LINES), P.LINE_KEYS)


def diff_hash_lineitem(spark, sf_dir):
    s, t = P.lineitem_pair(spark, sf_dir)
    return narrow(C.diff(s, t, replace(LINES, use_hash_mode=True)), P.LINE_KEYS)


def diff_hash_tolerance(spark, sf_dir):
    """Rows that only a tolerance makes equal look like all other matched rows."""
    s, t = P.customer_pair(spark, sf_dir)
    d = C.diff(s, t, CompareConfig(keys=["c_custkey"], numeric_tolerance=0.01, use_hash_mode=True))
    return d.select("c_custkey", "status", F.col("source").isNotNull().alias("has_source"), F.col("target").isNotNull().alias("has_target"))


def diff_ignore_columns(spark, sf_dir):
    return narrow(_orders(spark, sf_dir, ignore_columns=["o_totalprice", "o_orderstatus"]), ["o_orderkey"])


def diff_case_whitespace(spark, sf_dir):
    return narrow(_orders(spark, sf_dir, case_insensitive=True, normalize_whitespace=True), ["o_orderkey"])


def diff_tolerance(spark, sf_dir):
    s, t = P.customer_pair(spark, sf_dir)
    return narrow(C.diff(s, t, replace(CUSTOMERS, numeric_tolerance=0.01)), ["c_custkey"])


def diff_text_numbers(spark, sf_dir):
    """Balances held as text on both sides still compare within a tolerance."""
    s, t = (x.withColumn("c_acctbal", F.col("c_acctbal").cast("string")) for x in P.customer_pair(spark, sf_dir))
    return narrow(C.diff(s, t, replace(CUSTOMERS, numeric_tolerance=0.01, null_equals_empty=True)), ["c_custkey"])


def diff_null_empty(spark, sf_dir):
    s, t = P.customer_pair(spark, sf_dir)
    return narrow(C.diff(s, t, replace(CUSTOMERS, null_equals_empty=True)), ["c_custkey"])


def diff_null_keys(spark, sf_dir):
    """A key that is NULL for every sixth row on the source side: NULL matches NULL."""
    s, t = P.customer_pair(spark, sf_dir)
    nulled = t.withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("")))
    cfg = CompareConfig(keys=["c_mktsegment", "c_nationkey"], order_by=["c_custkey"])
    return narrow(C.diff(s, nulled, cfg), ["c_mktsegment", "c_nationkey"])


def diff_schema_aligned(spark, sf_dir):
    """Sides with different columns and number types."""
    s, t = P.orders_pair(spark, sf_dir)
    t = t.drop("o_orderpriority").withColumn("o_custkey", F.col("o_custkey").cast("int"))
    return narrow(C.diff(s, t, ORDERS), ["o_orderkey"])


def aligned_tables(spark, sf_dir):
    s, t = P.orders_pair(spark, sf_dir)
    a, b = align(s.select("o_orderkey", "o_custkey"), t.select("o_orderkey", F.col("o_totalprice").alias("price")))
    return a.withColumn("side", F.lit("s")).unionByName(b.withColumn("side", F.lit("t")))


def diff_rows_wide(spark, sf_dir):
    """Both full rows of every difference."""
    d = C.filter_status(_orders(spark, sf_dir), "updated", "inserted", "deleted")
    cells = [F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("source", "target") for c in P.ORDER_COLUMNS]
    return d.select("o_orderkey", "status", *cells)


def diff_summary(spark, sf_dir):
    return C.diff_summary(_orders(spark, sf_dir))


def diff_summary_loose(spark, sf_dir):
    return C.diff_summary(
        _orders(spark, sf_dir, case_insensitive=True, normalize_whitespace=True, numeric_tolerance=10.5)
    )


def diff_summary_lineitem(spark, sf_dir):
    s, t = P.lineitem_pair(spark, sf_dir)
    return C.diff_summary(C.diff(s, t, LINES))


def hash_mode_summary(spark, sf_dir):
    return C.diff_summary(_orders(spark, sf_dir, use_hash_mode=True))


def row_hashes(spark, sf_dir):
    """SHA-256 of the normalised cells that are neither key nor ignored."""
    s, _ = P.customer_pair(spark, sf_dir)
    cfg = CompareConfig(case_insensitive=True)
    return s.select("c_custkey", row_hash(s, ["c_name", "c_nationkey", "c_mktsegment"], cfg).alias("row_hash"))


def insert_rows(spark, sf_dir):
    s, t = P.orders_pair(spark, sf_dir)
    return C.append_rows(s, t, ORDERS)


def delete_rows(spark, sf_dir):
    s, t = P.orders_pair(spark, sf_dir)
    return C.append_rows(t, s, ORDERS)


def changed_column_frequency(spark, sf_dir):
    return C.changed_column_frequency(_orders(spark, sf_dir))


def diff_search(spark, sf_dir):
    return C.search_rows(C.flat_rows(_orders(spark, sf_dir)), "urgent").select("o_orderkey", "status", "o_orderpriority")


def diff_search_page(spark, sf_dir):
    """Third page of the rows that mention "urgent"."""
    rows = C.search_rows(C.flat_rows(C.filter_status(_orders(spark, sf_dir), "updated")), "urgent")
    return page(rows.select("o_orderkey", "status", "o_totalprice"), ["o_orderkey"], limit=100, offset=200)


def _nearly_same_lines(spark, sf_dir):
    """Lineitem and a copy in which the orders of one remainder in two hundred differ."""
    src = P.load(spark, sf_dir, "lineitem")
    few = P.every("l_orderkey", 200, 3)
    tgt = src.withColumn("l_tax", F.when(few, F.col("l_tax") + 0.5).otherwise(F.col("l_tax"))).filter(~P.every("l_orderkey", 400, 7))
    return src, tgt.unionByName(src.filter(P.every("l_orderkey", 400, 11)).withColumn("l_orderkey", F.col("l_orderkey") + P.EXTRA_KEY))


def diff_hash_buckets(spark, sf_dir):
    """Changed lines of two nearly equal tables, found by checksums of key buckets."""
    s, t = _nearly_same_lines(spark, sf_dir)
    return narrow(changed_rows(s, t, LINES), list(P.LINE_KEYS))


def expr_match_band(spark, sf_dir):
    """Orders of one customer whose prices differ by at most 1 % and dates by at most 3 days."""
    s, t = P.orders_pair(spark, sf_dir)
    bands = [Band("o_totalprice", "o_totalprice", 0.01, relative=True), Band("o_orderdate", "o_orderdate", 3.0)]
    d = band_diff(s, t, ["o_orderkey"], ["o_orderkey"], [("o_custkey", "o_custkey")], bands, "source.o_orderpriority IS NOT NULL")
    return d.select("status", F.col("source.o_orderkey").alias("source_key"), F.col("target.o_orderkey").alias("target_key"))


def expr_match(spark, sf_dir):
    """Rows matched by an expression: customer and month of the order."""
    s, t = P.orders_pair(spark, sf_dir)
    month = "o_custkey * 10000 + year(o_orderdate) * 12 + month(o_orderdate)"
    cfg = CompareConfig(order_by=["o_orderkey"])
    d = C.expression_diff(s, t, [(month, month), ("upper(o_orderstatus)", "upper(o_orderstatus)")], cfg)
    return narrow(d, ["match_0", "match_1"])


def dedupe_last_lineitem(spark, sf_dir):
    return dedupe_last(P.load(spark, sf_dir, "lineitem"), P.LINE_KEYS, P.LINE_ORDER)


def duplicate_key_report(spark, sf_dir):
    return duplicate_keys(P.load(spark, sf_dir, "lineitem"), P.LINE_KEYS)


def duplicate_error_rows(spark, sf_dir):
    return duplicate_rows(P.load(spark, sf_dir, "lineitem"), P.LINE_KEYS, P.LINE_ORDER)


QUERIES = {
    f.__name__: f
    for f in (
        diff_orders_pk, diff_default_keys, diff_id_key, diff_lineitem_composite, diff_hash_lineitem, diff_hash_buckets, expr_match_band,
        diff_hash_tolerance, diff_ignore_columns, diff_case_whitespace, diff_tolerance, diff_text_numbers, diff_null_empty,
        diff_null_keys, diff_schema_aligned, aligned_tables, diff_rows_wide, diff_summary, diff_summary_loose,
        diff_summary_lineitem, diff_summary_errors, diff_lost_rows, hash_mode_summary, row_hashes, insert_rows, delete_rows, changed_column_frequency,
        diff_search, diff_search_page, expr_match, dedupe_last_lineitem, duplicate_key_report, duplicate_error_rows,
    )
}

_ALL = "SELECT * FROM d"
_CUSTOMER_COLUMNS = ("c_acctbal", "c_mktsegment", "c_name", "c_nationkey")
_EMPTY_SAME = "coalesce(s.{c}, '') = coalesce(t.{c}, '')"
_SHOWN = "CASE WHEN status = 'deleted' THEN t.{c} ELSE s.{c} END"
_JOINED = f"""{ORDERS_DIFF}, shown AS (
  SELECT d.o_orderkey, d.status, CASE WHEN d.status = 'deleted' THEN t.o_totalprice ELSE s.o_totalprice END AS o_totalprice,
         CASE WHEN d.status = 'deleted' THEN t.o_orderpriority ELSE s.o_orderpriority END AS o_orderpriority
  FROM d LEFT JOIN src s ON s.o_orderkey = d.o_orderkey LEFT JOIN tgt t ON t.o_orderkey = d.o_orderkey)
"""
_WIDE_CELLS = ", ".join(
    f"{side}.{c} AS {name}_{c}" for side, name in (("s", "source"), ("t", "target")) for c in P.ORDER_COLUMNS
)
_MATCH_PAIR = f"""{P.ORDERS_SQL.replace('src AS', 'src0 AS', 1).replace('tgt AS', 'tgt0 AS', 1)},
keyed AS (
  SELECT side, o_custkey * 10000 + year(o_orderdate) * 12 + month(o_orderdate) AS match_0, upper(o_orderstatus) AS match_1,
         o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
  FROM (SELECT 's' AS side, * FROM src0 UNION ALL SELECT 't' AS side, * FROM tgt0)),
last AS (SELECT *, row_number() OVER (PARTITION BY side, match_0, match_1 ORDER BY o_orderkey DESC) AS rn FROM keyed),
src AS (SELECT * FROM last WHERE rn = 1 AND side = 's'),
tgt AS (SELECT * FROM last WHERE rn = 1 AND side = 't')
"""
_NULL_KEY_PAIR = f"""{P.CUSTOMER_SQL.replace('src AS', 'src0 AS', 1).replace('tgt AS', 'tgt0 AS', 1)},
src AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey DESC) AS rn
                       FROM src0) WHERE rn = 1),
tgt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey DESC) AS rn
                       FROM (SELECT * REPLACE (nullif(c_mktsegment, '') AS c_mktsegment) FROM tgt0)) WHERE rn = 1)
"""

ORACLES = {
    "diff_orders_pk": ORDERS_DIFF + _ALL,
    "diff_default_keys": diff_sql(
        P.CUSTOMER_SQL, ["c_acctbal", "c_custkey", "c_mktsegment", "c_name", "c_nationkey"], ["c_custkey"]
    )
    + "SELECT * REPLACE ('' AS changed) FROM d",
    "diff_id_key": diff_sql(P.CUSTOMER_SQL, ["c_custkey"], _CUSTOMER_COLUMNS)
    + "SELECT c_custkey AS id, status, changed FROM d",
    "diff_lineitem_composite": LINES_DIFF + _ALL,
    "diff_hash_buckets": diff_sql(NEARLY_SQL, P.LINE_KEYS, P.LINE_COLUMNS) + _ALL + " WHERE status <> 'matched'",
    "expr_match_band": BAND_SQL,
    "diff_hash_lineitem": LINES_DIFF + _ALL,
    "diff_hash_tolerance": diff_sql(P.CUSTOMER_SQL, ["c_custkey"], _CUSTOMER_COLUMNS, {"c_acctbal": NEAR % 0.01})
    + "SELECT c_custkey, status, status IN ('inserted', 'updated') AS has_source, status IN ('deleted', 'updated') AS has_target FROM d",
    "diff_ignore_columns": diff_sql(P.ORDERS_SQL, ["o_orderkey"], ["o_custkey", "o_orderdate", "o_orderpriority"]) + _ALL,
    "diff_case_whitespace": diff_sql(P.ORDERS_SQL, ["o_orderkey"], P.ORDER_COLUMNS, LOOSE) + _ALL,
    "diff_tolerance": diff_sql(P.CUSTOMER_SQL, ["c_custkey"], _CUSTOMER_COLUMNS, {"c_acctbal": NEAR % 0.01}) + _ALL,
    "diff_text_numbers": diff_sql(
        P.CUSTOMER_SQL, ["c_custkey"], _CUSTOMER_COLUMNS, {"c_acctbal": NEAR % 0.01, "c_mktsegment": _EMPTY_SAME}
    )
    + _ALL,
    "diff_null_empty": diff_sql(P.CUSTOMER_SQL, ["c_custkey"], _CUSTOMER_COLUMNS, {"c_mktsegment": _EMPTY_SAME}) + _ALL,
    "diff_null_keys": diff_sql(_NULL_KEY_PAIR, ["c_mktsegment", "c_nationkey"], ["c_acctbal", "c_custkey", "c_name"]) + _ALL,
    "diff_schema_aligned": diff_sql(
        P.ORDERS_SQL, ["o_orderkey"], P.ORDER_COLUMNS, {"o_orderpriority": "s.{c} IS NULL"}
    )
    + _ALL,
    "aligned_tables": f"""WITH {P.ORDERS_SQL}
SELECT o_custkey, o_orderkey, NULL::DOUBLE AS price, 's' AS side FROM src
UNION ALL SELECT NULL, o_orderkey, o_totalprice, 't' FROM tgt""",
    "diff_rows_wide": f"""{ORDERS_DIFF} SELECT d.o_orderkey, d.status, {_WIDE_CELLS}
FROM d LEFT JOIN src s ON s.o_orderkey = d.o_orderkey LEFT JOIN tgt t ON t.o_orderkey = d.o_orderkey
WHERE d.status <> 'matched'""",
    "diff_summary": ORDERS_DIFF + COUNTS,
    "diff_summary_loose": diff_sql(
        P.ORDERS_SQL, ["o_orderkey"], P.ORDER_COLUMNS, {**LOOSE, "o_totalprice": NEAR % 10.5}
    )
    + COUNTS,
    "diff_summary_lineitem": LINES_DIFF + COUNTS,
    "hash_mode_summary": ORDERS_DIFF + COUNTS,
    "row_hashes": f"""WITH {P.CUSTOMER_SQL} SELECT c_custkey, sha256(concat_ws(',', coalesce(length(c_mktsegment) || ':' || lower(c_mktsegment), '-'),
 length(c_name) || ':' || lower(c_name), length(c_nationkey::VARCHAR) || ':' || c_nationkey)) AS row_hash FROM src""",
    "insert_rows": f"WITH {P.ORDERS_SQL} SELECT * FROM src WHERE o_orderkey NOT IN (SELECT o_orderkey FROM tgt)",
    "delete_rows": f"WITH {P.ORDERS_SQL} SELECT * FROM tgt WHERE o_orderkey NOT IN (SELECT o_orderkey FROM src)",
    "changed_column_frequency": ORDERS_DIFF
    + "SELECT unnest(string_split(changed, ',')) AS column_name, count(*) AS n_rows FROM d WHERE status = 'updated' GROUP BY 1",
    "diff_search": _JOINED + "SELECT o_orderkey, status, o_orderpriority FROM shown WHERE lower(o_orderpriority) LIKE '%urgent%'",
    "diff_search_page": _JOINED
    + """SELECT o_orderkey, status, o_totalprice FROM shown
WHERE status = 'updated' AND lower(o_orderpriority) LIKE '%urgent%' ORDER BY o_orderkey LIMIT 100 OFFSET 200""",
    "expr_match": diff_sql(_MATCH_PAIR, ["match_0", "match_1"], ["o_orderkey", *P.ORDER_COLUMNS]) + _ALL,
    "dedupe_last_lineitem": f"WITH {P.LINEITEM_SQL} SELECT * FROM src",
    "diff_summary_errors": LINES_DIFF + COUNTS.replace(" FROM d", """, (SELECT count(*) FROM lineitem) + (SELECT count(*) FROM raw_tgt)
 - (SELECT count(*) FROM src) - (SELECT count(*) FROM tgt) AS errors FROM d"""),
    "diff_lost_rows": LINES_DIFF + """, sl AS (SELECT l_orderkey, l_linenumber, count(*) - 1 AS n FROM lineitem GROUP BY 1, 2),
 tl AS (SELECT l_orderkey, l_linenumber, count(*) - 1 AS n FROM raw_tgt GROUP BY 1, 2)
 SELECT d.*, coalesce(sl.n, 0) AS source_lost, coalesce(tl.n, 0) AS target_lost FROM d
 LEFT JOIN sl ON sl.l_orderkey = d.l_orderkey AND sl.l_linenumber = d.l_linenumber
 LEFT JOIN tl ON tl.l_orderkey = d.l_orderkey AND tl.l_linenumber = d.l_linenumber WHERE coalesce(sl.n, 0) + coalesce(tl.n, 0) > 0""",
    "duplicate_key_report": """SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem
GROUP BY 1, 2 HAVING count(*) > 1""",
    "duplicate_error_rows": f"""WITH ranked AS (SELECT *, {P._LAST} AS rn FROM lineitem)
SELECT * EXCLUDE (rn), 'error' AS status, 'duplicate key' AS error FROM ranked WHERE rn > 1""",
}
