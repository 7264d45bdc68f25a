"""Registered schema diffs and type mappings and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from parityflow.operators import schema_diff as S
from parityflow.operators.type_mapping import (
    canonical_text, canonicalise, cast_by_type_map as by_type_map, cast_loss_audit, cast_to, map_types, parse_native_type,
)
from parityflow.suite import pairs as P

QUERIES, ORACLES = {}, {}


def registered(sql):
    def wrap(fn):
        QUERIES[fn.__name__] = fn
        ORACLES[fn.__name__] = sql
        return fn

    return wrap


# -- two catalogs derived from the data: a column per part, an index per supplier,
#    a constraint per customer ---------------------------------------------------------
TABLES = 60


def _name(key):
    return F.concat(F.lit("tab"), F.pmod(key, F.lit(TABLES)))


def catalogs(spark, sf_dir):
    part, supp, cust = (P.load(spark, sf_dir, n) for n in ("part", "supplier", "customer"))
    k = F.col("p_partkey")
    columns = part.select(
        _name(k).alias("table_name"), F.concat(F.lit("c"), k).alias("name"),
        F.when(P.every("p_partkey", 3), F.lit("INT")).when(P.every("p_partkey", 3, 1), F.lit("varchar(20)")).otherwise(F.lit("Decimal(10,2)")).alias("data_type"),
        P.every("p_partkey", 4).alias("is_nullable"), F.when(P.every("p_partkey", 3, 1), 20).alias("max_length"),
        F.when(P.every("p_partkey", 3, 2), 10).alias("precision"), F.when(P.every("p_partkey", 3, 2), 2).alias("scale"),
        F.when(P.every("p_partkey", 10), F.lit("0")).alias("default_value"), k.alias("k"),
    )
    changed = columns.withColumns(
        {
            "data_type": F.when(P.every("k", 5), F.concat(F.lit(" "), F.upper("data_type")))
            .when(P.every("k", 17), F.lit("text")).otherwise(F.col("data_type")),
            "is_nullable": F.when(P.every("k", 7), ~F.col("is_nullable")).otherwise(F.col("is_nullable")),
            "max_length": F.when(P.every("k", 13), F.col("max_length") + 1).otherwise(F.col("max_length")),
            "precision": F.when(P.every("k", 19), F.lit(None)).otherwise(F.col("precision")),
            "scale": F.when(P.every("k", 19), F.lit(4)).otherwise(F.col("scale")),
            "default_value": F.when(P.every("k", 20), F.lit("1")).otherwise(F.col("default_value")),
        }
    ).filter(~P.every("k", 11))
    more = columns.filter(P.every("k", 23)).withColumn("name", F.concat(F.lit("new"), "k"))
    j = F.col("s_suppkey")
    indexes = supp.select(
        _name(j).alias("table_name"), F.concat(F.lit("ix"), j).alias("name"),
        F.array(F.concat(F.lit("c"), j), F.concat(F.lit("c"), j + TABLES)).alias("columns"),
        P.every("s_suppkey", 2).alias("is_unique"), F.lit(False).alias("is_clustered"), j.alias("k"),
    )
    other_indexes = indexes.withColumns(
        {
            "columns": F.when(P.every("k", 5), F.reverse("columns")).otherwise(F.col("columns")),
            "is_unique": F.when(P.every("k", 7), F.lit(True)).otherwise(F.col("is_unique")),
        }
    ).filter(~P.every("k", 9))
    c = F.col("c_custkey")
    constraints = cust.select(
        _name(c).alias("table_name"), F.concat(F.lit("fk"), c).alias("name"), F.lit("ForeignKey").alias("constraint_type"),
        F.array(F.concat(F.lit("c"), c)).alias("columns"), _name(c + 1).alias("referenced_table"),
        F.when(~P.every("c_custkey", 3), F.array(F.lit("id"))).alias("referenced_columns"), c.alias("k"),
    )
    other_constraints = constraints.withColumns(
        {
            "constraint_type": F.when(P.every("k", 8), F.lit("Check")).otherwise(F.col("constraint_type")),
            "referenced_table": F.when(P.every("k", 8), F.lit(None)).otherwise(F.col("referenced_table")),
            "referenced_columns": F.when(P.every("k", 12), F.array(F.lit("id"))).otherwise(F.col("referenced_columns")),
        }
    )
    names = columns.select("table_name").distinct()
    tail = f"tab{TABLES - 1}"
    bare = names.limit(0).unionByName(part.filter("p_partkey = 0").select(F.lit("bare").alias("table_name")))
    src = S.Catalog(names.unionByName(bare), columns, indexes, constraints)
    tgt = S.Catalog(
        names.filter(F.col("table_name") != tail).unionByName(bare).unionByName(bare.select(F.lit("fresh").alias("table_name"))),
        changed.unionByName(more), other_indexes, other_constraints,
    )
    return src, tgt


CATALOG_SQL = """
sc AS (SELECT 'tab' || (p_partkey % 60) AS table_name, 'c' || p_partkey AS name,
  CASE p_partkey % 3 WHEN 0 THEN 'INT' WHEN 1 THEN 'varchar(20)' ELSE 'Decimal(10,2)' END AS data_type,
  p_partkey % 4 = 0 AS is_nullable, CASE WHEN p_partkey % 3 = 1 THEN 20 END AS max_length,
  CASE WHEN p_partkey % 3 = 2 THEN 10 END AS prec, CASE WHEN p_partkey % 3 = 2 THEN 2 END AS scl,
  CASE WHEN p_partkey % 10 = 0 THEN '0' END AS default_value, p_partkey AS k FROM part),
tc AS (SELECT table_name, name, CASE WHEN k % 5 = 0 THEN ' ' || upper(data_type) WHEN k % 17 = 0 THEN 'text' ELSE data_type END AS data_type,
  CASE WHEN k % 7 = 0 THEN NOT is_nullable ELSE is_nullable END AS is_nullable, CASE WHEN k % 13 = 0 THEN max_length + 1 ELSE max_length END AS max_length,
  CASE WHEN k % 19 = 0 THEN NULL ELSE prec END AS prec, CASE WHEN k % 19 = 0 THEN 4 ELSE scl END AS scl,
  CASE WHEN k % 20 = 0 THEN '1' ELSE default_value END AS default_value, k FROM sc WHERE k % 11 <> 0
  UNION ALL SELECT table_name, 'new' || k, data_type, is_nullable, max_length, prec, scl, default_value, k FROM sc WHERE k % 23 = 0),
si AS (SELECT 'tab' || (s_suppkey % 60) AS table_name, 'ix' || s_suppkey AS name, 'c' || s_suppkey || ', c' || (s_suppkey + 60) AS cols,
  s_suppkey % 2 = 0 AS is_unique, s_suppkey AS k FROM supplier),
ti AS (SELECT table_name, name, CASE WHEN k % 5 = 0 THEN 'c' || (k + 60) || ', c' || k ELSE cols END AS cols,
  CASE WHEN k % 7 = 0 THEN true ELSE is_unique END AS is_unique, k FROM si WHERE k % 9 <> 0),
sk AS (SELECT 'tab' || (c_custkey % 60) AS table_name, 'fk' || c_custkey AS name, 'ForeignKey' AS kind, 'tab' || ((c_custkey + 1) % 60) AS ref,
  CASE WHEN c_custkey % 3 <> 0 THEN 'id' END AS refcols, c_custkey AS k FROM customer),
tk AS (SELECT table_name, name, CASE WHEN k % 8 = 0 THEN 'Check' ELSE kind END AS kind, CASE WHEN k % 8 = 0 THEN NULL ELSE ref END AS ref,
  CASE WHEN k % 12 = 0 THEN 'id' ELSE refcols END AS refcols, k FROM sk),
st AS (SELECT DISTINCT table_name FROM sc UNION ALL SELECT 'bare'),
tt AS (SELECT DISTINCT table_name FROM sc WHERE table_name <> 'tab59' UNION ALL SELECT 'bare' UNION ALL SELECT 'fresh'),
both_t AS (SELECT table_name FROM st WHERE table_name IN (SELECT table_name FROM tt)),
pairs AS (
  SELECT 'Column' AS object_type, table_name, name, s.k IS NOT NULL AS in_s, t.k IS NOT NULL AS in_t, [
    CASE WHEN lower(trim(s.data_type)) IS DISTINCT FROM lower(trim(t.data_type)) THEN {'p': 'data_type', 's': s.data_type, 't': t.data_type} END,
    CASE WHEN s.is_nullable IS DISTINCT FROM t.is_nullable THEN {'p': 'is_nullable', 's': s.is_nullable::VARCHAR, 't': t.is_nullable::VARCHAR} END,
    CASE WHEN s.max_length IS DISTINCT FROM t.max_length THEN {'p': 'max_length', 's': s.max_length::VARCHAR, 't': t.max_length::VARCHAR} END,
    CASE WHEN s.prec IS DISTINCT FROM t.prec THEN {'p': 'precision', 's': s.prec::VARCHAR, 't': t.prec::VARCHAR} END,
    CASE WHEN s.scl IS DISTINCT FROM t.scl THEN {'p': 'scale', 's': s.scl::VARCHAR, 't': t.scl::VARCHAR} END,
    CASE WHEN s.default_value IS DISTINCT FROM t.default_value THEN {'p': 'default_value', 's': s.default_value, 't': t.default_value} END] AS found
  FROM (SELECT * FROM sc WHERE table_name IN (SELECT * FROM both_t)) s FULL JOIN (SELECT * FROM tc WHERE table_name IN (SELECT * FROM both_t)) t USING (table_name, name)
  UNION ALL
  SELECT 'Index', table_name, name, s.k IS NOT NULL, t.k IS NOT NULL, [
    CASE WHEN s.cols IS DISTINCT FROM t.cols THEN {'p': 'columns', 's': s.cols, 't': t.cols} END,
    CASE WHEN s.is_unique IS DISTINCT FROM t.is_unique THEN {'p': 'is_unique', 's': s.is_unique::VARCHAR, 't': t.is_unique::VARCHAR} END]
  FROM (SELECT * FROM si WHERE table_name IN (SELECT * FROM both_t)) s FULL JOIN (SELECT * FROM ti WHERE table_name IN (SELECT * FROM both_t)) t USING (table_name, name)
  UNION ALL
  SELECT 'Constraint', table_name, name, s.k IS NOT NULL, t.k IS NOT NULL, [
    CASE WHEN s.kind IS DISTINCT FROM t.kind THEN {'p': 'constraint_type', 's': s.kind, 't': t.kind} END,
    CASE WHEN s.ref IS DISTINCT FROM t.ref THEN {'p': 'referenced_table', 's': s.ref, 't': t.ref} END,
    CASE WHEN s.refcols IS DISTINCT FROM t.refcols THEN {'p': 'referenced_columns', 's': s.refcols, 't': t.refcols} END]
  FROM (SELECT * FROM sk WHERE table_name IN (SELECT * FROM both_t)) s FULL JOIN (SELECT * FROM tk WHERE table_name IN (SELECT * FROM both_t)) t USING (table_name, name)),
parts AS (SELECT object_type, table_name, table_name || '.' || name AS object_name,
  CASE WHEN in_s AND in_t THEN list_filter(found, lambda x: x IS NOT NULL) ELSE [] END AS found, in_s, in_t FROM pairs),
changes AS (
  SELECT object_type, table_name, object_name, CASE WHEN NOT in_t THEN 'Removed' WHEN NOT in_s THEN 'Added'
    WHEN len(found) > 0 THEN 'Modified' ELSE 'Unchanged' END AS change_type, found FROM parts
  UNION ALL SELECT 'Table', table_name, table_name, 'Removed', [] FROM st WHERE table_name NOT IN (SELECT table_name FROM tt)
  UNION ALL SELECT 'Table', table_name, table_name, 'Added', [] FROM tt WHERE table_name NOT IN (SELECT table_name FROM st)
  UNION ALL SELECT 'Table', 'bare', 'bare', 'Unchanged', [])
"""


def _changes(spark, sf_dir):
    return S.schema_diff(*catalogs(spark, sf_dir))


@registered(f"WITH {CATALOG_SQL} SELECT object_type, table_name, object_name, change_type FROM changes")
def schema_diff(spark, sf_dir):
    return _changes(spark, sf_dir).drop("details")


@registered(f"""WITH {CATALOG_SQL}, x AS (SELECT object_type, object_name, change_type, unnest(found) AS d FROM changes)
SELECT object_type, object_name, change_type, d.p AS property, d.s AS source_value, d.t AS target_value FROM x""")
def schema_diff_details(spark, sf_dir):
    return S.detail_rows(_changes(spark, sf_dir))


@registered(f"""WITH {CATALOG_SQL} SELECT count(*) FILTER (WHERE change_type = 'Added') AS additions, count(*) FILTER (WHERE change_type = 'Removed') AS removals,
 count(*) FILTER (WHERE change_type = 'Modified') AS modifications, count(*) FILTER (WHERE change_type = 'Unchanged') AS unchanged FROM changes""")
def schema_diff_summary(spark, sf_dir):
    return S.schema_summary(_changes(spark, sf_dir))


@registered(f"WITH {CATALOG_SQL} SELECT object_type, table_name, object_name, change_type FROM changes WHERE change_type = 'Modified' AND object_type = 'Column' AND object_name LIKE '%tab1.%'")
def schema_diff_filter(spark, sf_dir):
    return S.filter_changes(_changes(spark, sf_dir), "Modified", "Column", "TAB1.").drop("details")


@registered(f"""WITH {CATALOG_SQL} SELECT table_name, object_type, count(*) FILTER (WHERE change_type <> 'Unchanged') AS diff_count, count(*) AS n_objects
 FROM changes GROUP BY GROUPING SETS ((table_name, object_type), (table_name))""")
def schema_rollup(spark, sf_dir):
    return S.change_rollup(_changes(spark, sf_dir))


@registered("""WITH c AS (SELECT p_partkey AS k, p_partkey % 3 AS m, p_partkey % 7 AS r FROM part)
SELECT 'tab' || (k % 60) || '.c' || k AS object_name, CASE WHEN (m = 0 AND r <> 3) OR m = 1 OR (m = 2 AND r = 5) THEN 'Unchanged' ELSE 'Modified' END AS change_type,
 CASE m WHEN 0 THEN 'Int' WHEN 1 THEN 'Varchar(20)' ELSE 'Decimal(10,2)' END AS source_type,
 CASE m WHEN 0 THEN CASE WHEN r = 3 THEN 'BigInt' ELSE 'Int' END WHEN 1 THEN 'Varchar(20)' ELSE CASE WHEN r = 5 THEN 'Decimal(10,2)' ELSE 'Double' END END AS target_type
FROM c""")
def schema_diff_cross_engine(spark, sf_dir):
    """The same columns in SQL Server and PostgreSQL terms, compared by meaning."""
    key = P.load(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    m, r = F.pmod("k", F.lit(3)), F.pmod("k", F.lit(7))
    none = {p: F.lit(None).cast("int") for p in ("max_length", "precision", "scale")}
    base = key.select(_name(F.col("k")).alias("table_name"), F.concat(F.lit("c"), "k").alias("name"), "k", F.lit(True).alias("is_nullable"),
                      *[v.alias(n) for n, v in none.items()], F.lit(None).cast("string").alias("default_value"))
    here = base.withColumn("data_type", F.when(m == 0, "INT").when(m == 1, "VARCHAR(20)").otherwise("decimal(10, 2)"))
    there = base.withColumn(
        "data_type",
        F.when(m == 0, F.when(r == 3, F.lit("bigserial")).otherwise(F.lit("serial"))).when(m == 1, F.lit("character varying(20)"))
        .otherwise(F.when(r == 5, F.lit("numeric(10,2)")).otherwise(F.lit("float8"))),
    )
    names = base.select("table_name").distinct()
    a = S.with_canonical_types(S.Catalog(names, here), "SqlServer")
    b = S.with_canonical_types(S.Catalog(names, there), "PostgreSql")
    d = S.schema_diff(a, b).select("object_name", "change_type")
    types = lambda c, n: c.columns.select(F.concat_ws(".", "table_name", "name").alias("object_name"), F.col("data_type").alias(n))
    return d.join(types(a, "source_type"), "object_name").join(types(b, "target_type"), "object_name")


# -- type mapping --------------------------------------------------------------------
# Engine, native type, target engine, canonical, native there, warning, lossy.
_UNICODE = "Unicode type mapped to non-Unicode type; character loss possible"
_MOMENT = "DateTime/Timestamp mapped to TEXT; type safety lost in target"
_JSON = "JSON mapped to text type; JSON validation lost in target"
_UUID = "UUID mapped to string type; UUID validation lost in target"
GOLDEN = [
    ("SqlServer", "nvarchar(max)", "PostgreSql", "NText", "TEXT", _UNICODE, True),
    ("SqlServer", "NVARCHAR(50)", "PostgreSql", "NVarchar(50)", "VARCHAR(50)", _UNICODE, True),
    ("SqlServer", "nchar", "Oracle", "NChar(1)", "NCHAR(1)", "", False),
    ("SqlServer", "money", "MySql", "Decimal(19,4)", "DECIMAL(19,4)", "", False),
    ("SqlServer", "decimal", "Oracle", "Decimal(18,0)", "NUMBER(18,0)", "", False),
    ("SqlServer", "decimal(10,2)", "MongoDb", "Decimal(10,2)", "decimal128", "", False),
    ("SqlServer", "decimal(38,10)", "MongoDb", "Decimal(38,10)", "decimal128", "Target DECIMAL(34,6) has less precision than source DECIMAL(38,10)", True),
    ("SqlServer", "datetime2(3)", "CosmosDb", "DateTime", "string", _MOMENT, True),
    ("SqlServer", "datetimeoffset", "PostgreSql", "Timestamp", "TIMESTAMPTZ", "", False),
    ("SqlServer", "rowversion", "MySql", "Varbinary(8)", "VARBINARY(8)", "", False),
    ("SqlServer", "varbinary(MAX)", "Oracle", "Blob", "BLOB", "", False),
    ("SqlServer", "geography", "PostgreSql", "Unknown(geography)", "GEOGRAPHY", "Unknown source type 'geography'; mapped as-is", False),
    ("SqlServer", "uniqueidentifier", "Sqlite", "Uuid", "TEXT", _UUID, False),
    ("SqlServer", "tinyint", "PostgreSql", "TinyInt", "SMALLINT", "", False),
    ("PostgreSql", "integer[]", "MySql", "Array<Int>", "JSON", "", False),
    ("PostgreSql", "text[]", "PostgreSql", "Array<Text>", "TEXT[]", "", False),
    ("PostgreSql", "numeric(12,4)", "Sqlite", "Decimal(12,4)", "REAL", "DECIMAL(12,4) mapped to floating point; precision loss possible", True),
    ("PostgreSql", "numeric(12,4)", "CosmosDb", "Decimal(12,4)", "number", "DECIMAL(12,4) mapped to floating point; precision loss possible", True),
    ("PostgreSql", "timestamptz", "Sqlite", "Timestamp", "TEXT", _MOMENT, True),
    ("PostgreSql", "timestamp without time zone", "MySql", "DateTime", "DATETIME", "", False),
    ("PostgreSql", "uuid", "MySql", "Uuid", "CHAR(36)", _UUID, False),
    ("PostgreSql", "uuid", "Oracle", "Uuid", "RAW(16)", "", False),
    ("PostgreSql", "jsonb", "Oracle", "Json", "CLOB", _JSON, False),
    ("PostgreSql", "json", "SqlServer", "Json", "NVARCHAR(MAX)", _JSON, False),
    ("PostgreSql", "interval", "SqlServer", "Text", "VARCHAR(MAX)", "", False),
    ("PostgreSql", "inet", "SqlServer", "Varchar(43)", "VARCHAR(43)", "", False),
    ("PostgreSql", "bit(12)", "MySql", "Binary(2)", "BINARY(2)", "", False),
    ("PostgreSql", "character varying", "Oracle", "Varchar(255)", "VARCHAR2(255)", "", False),
    ("PostgreSql", "polygon", "MySql", "Unknown(polygon)", "POLYGON", "Unknown source type 'polygon'; mapped as-is", False),
    ("PostgreSql", "bigint", "Sqlite", "BigInt", "INTEGER", "", False),
    ("MySql", "tinyint(1)", "SqlServer", "Boolean", "BIT", "", False),
    ("MySql", "tinyint(4)", "SqlServer", "TinyInt", "TINYINT", "", False),
    ("MySql", "decimal", "PostgreSql", "Decimal(10,0)", "NUMERIC(10,0)", "", False),
    ("MySql", "year", "Oracle", "SmallInt", "NUMBER(5)", "", False),
    ("MySql", "enum", "PostgreSql", "Varchar(255)", "VARCHAR(255)", "", False),
    ("MySql", "longtext", "Oracle", "Text", "CLOB", "", False),
    ("Oracle", "number(10)", "PostgreSql", "Int", "INTEGER", "", False),
    ("Oracle", "number", "SqlServer", "Decimal(38,0)", "DECIMAL(38,0)", "", False),
    ("Oracle", "number(1)", "MySql", "Boolean", "TINYINT(1)", "", False),
    ("Oracle", "number(8,2)", "PostgreSql", "Decimal(8,2)", "NUMERIC(8,2)", "", False),
    ("Oracle", "raw(16)", "SqlServer", "Uuid", "UNIQUEIDENTIFIER", "", False),
    ("Oracle", "date", "SqlServer", "DateTime", "DATETIME2", "", False),
    ("Oracle", "nclob", "MySql", "NText", "LONGTEXT", _UNICODE, True),
    ("Sqlite", "varchar(20)", "MySql", "Text", "LONGTEXT", "", False),
    ("Sqlite", "unsigned big int", "PostgreSql", "BigInt", "BIGINT", "", False),
    ("Sqlite", "numeric", "PostgreSql", "Double", "DOUBLE PRECISION", "", False),
    ("MongoDb", "objectId", "SqlServer", "Varchar(24)", "VARCHAR(24)", "", False),
    ("MongoDb", "decimal128", "Oracle", "Decimal(34,6)", "NUMBER(34,6)", "", False),
    ("MongoDb", "binData", "PostgreSql", "Blob", "BYTEA", "", False),
    ("MongoDb", "undefined", "MySql", "Unknown(null)", "NULL", "Unknown source type 'null'; mapped as-is", False),
    ("CosmosDb", "number", "PostgreSql", "Double", "DOUBLE PRECISION", "", False),
    ("CosmosDb", "array", "SqlServer", "Json", "NVARCHAR(MAX)", _JSON, False),
]
_QUOTED = [tuple("'" + str(x).replace("'", "''") + "'" if not isinstance(x, bool) else str(x).lower() for x in row) for row in GOLDEN]
GOLDEN_SQL = "golden(n, source_engine, data_type, target_engine, canonical, target_type, warnings, is_lossy) AS (VALUES " + ", ".join(
    f"({i}, {', '.join(row)})" for i, row in enumerate(_QUOTED)
) + ")"


def _typed_parts(spark, sf_dir):
    """Every part gets one of the native types by its key."""
    pick = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("source_engine", "data_type", "target_engine"), row)]) for row in GOLDEN])
    part = P.load(spark, sf_dir, "part")
    return part.select("p_partkey", F.get(pick, F.pmod("p_partkey", F.lit(len(GOLDEN))).cast("int")).alias("x")).select("p_partkey", "x.*")


@registered(f"WITH {GOLDEN_SQL} SELECT p_partkey, source_engine, data_type, target_engine, canonical, target_type, warnings, is_lossy FROM part JOIN golden ON n = p_partkey % {len(GOLDEN)}")
def type_map_warnings(spark, sf_dir):
    return map_types(_typed_parts(spark, sf_dir)).withColumn("canonical", canonical_text(F.col("canonical"))).withColumn(
        "warnings", F.concat_ws("; ", "warnings")
    )


@registered(f"WITH {GOLDEN_SQL} SELECT p_partkey, canonical FROM part JOIN golden ON n = p_partkey % {len(GOLDEN)}")
def type_to_canonical(spark, sf_dir):
    out = canonicalise(_typed_parts(spark, sf_dir), "source_engine", "data_type")
    return out.select("p_partkey", canonical_text(F.col("canonical")).alias("canonical"))


@registered("""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity::INTEGER AS p, l_linenumber AS s,
 'Decimal(' || l_quantity::INTEGER || ',' || l_linenumber || ')' AS canonical, 'NUMBER(' || l_quantity::INTEGER || ',' || l_linenumber || ')' AS target_type,
 'decimal' AS base, false AS is_lossy FROM lineitem""")
def type_map_parametrised(spark, sf_dir):
    """Precision and scale carried through for every line."""
    li = P.load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("q"), F.lit("SqlServer").alias("source_engine"), F.lit("Oracle").alias("target_engine")
    )
    li = li.withColumn("data_type", F.concat(F.lit(" DECIMAL ("), "q", F.lit(", "), "l_linenumber", F.lit(") ")))
    out = map_types(li).withColumn("t", parse_native_type(F.col("data_type")))
    return out.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("t.p1").cast("int").alias("p"), F.col("t.p2").cast("int").alias("s"),
        canonical_text(F.col("canonical")).alias("canonical"), "target_type", "t.base", "is_lossy",
    )


@registered("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'MONEY' ELSE 'NUMERIC(19,4)' END AS target_type FROM part""")
def type_map_overrides(spark, sf_dir):
    part = P.load(spark, sf_dir, "part").select(
        "p_partkey", F.when(P.every("p_partkey", 2), F.lit("smallmoney")).otherwise(F.lit("money")).alias("data_type"),
        F.lit("SqlServer").alias("source_engine"), F.lit("PostgreSql").alias("target_engine"),
    )
    chosen = spark.createDataFrame([("SqlServer", "SMALLMONEY", "MONEY")], "source_engine string, source_type string, target_type string")
    return map_types(part, overrides=chosen).select("p_partkey", "target_type")


_CASTS = [("l_extendedprice", "Decimal", 6, 2), ("l_quantity", "TinyInt", None, None), ("l_discount", "Int", None, None), ("l_partkey", "SmallInt", None, None), ("l_returnflag", "Varchar", 1, None)]


@registered("""SELECT 'l_extendedprice' AS column_name, count(*) FILTER (WHERE round(l_extendedprice, 2) >= 10000) AS overflow, 0 AS decimals_lost, 0 AS truncated, 0 AS non_ascii FROM lineitem
UNION ALL SELECT 'l_quantity', 0, 0, 0, 0 UNION ALL SELECT 'l_discount', 0, count(*) FILTER (WHERE l_discount <> 0), 0, 0 FROM lineitem
UNION ALL SELECT 'l_partkey', count(*) FILTER (WHERE l_partkey > 32767), 0, 0, 0 FROM lineitem UNION ALL SELECT 'l_returnflag', 0, 0, 0, 0""")
def cast_loss(spark, sf_dir):
    return cast_loss_audit(P.load(spark, sf_dir, "lineitem"), _CASTS)


@registered("""SELECT lang, sum(CASE WHEN length(text) > 500 THEN 1 ELSE 0 END)::BIGINT AS truncated,
 sum(CASE WHEN regexp_matches(text, '[^\\x00-\\x7F]') THEN 1 ELSE 0 END)::BIGINT AS non_ascii FROM documents GROUP BY lang""")
def cast_loss_text(spark, sf_dir):
    """Whole documents that would be cut or lose characters, per language."""
    out = cast_loss_audit(P.load(spark, sf_dir, "documents"), [("text", "Varchar", 500, None)], by=["lang"])
    return out.select("lang", "truncated", "non_ascii")


@registered("""SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice, 2) < 10000 AS fits,
 CASE WHEN round(l_extendedprice, 2) < 10000 THEN l_extendedprice::DECIMAL(6,2)::VARCHAR ELSE l_extendedprice::VARCHAR END AS price FROM lineitem""")
def cast_typed_table(spark, sf_dir):
    li = P.load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    good, bad = cast_to(li, [("l_extendedprice", "Decimal", 6, 2)])
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    from parityflow.functions.equality import number_text

    return good.select(*keys, F.lit(True).alias("fits"), F.col("l_extendedprice").cast("string").alias("price")).unionByName(
        bad.select(*keys, F.lit(False).alias("fits"), number_text(F.col("l_extendedprice"), bad.schema["l_extendedprice"].dataType).alias("price"))
    )


_LINE_TYPES = {"l_orderkey": "number(10)", "l_linenumber": "number(3)", "l_quantity": "number(4)", "l_partkey": "number(3)", "l_extendedprice": "number(7,2)", "l_shipdate": "date", "l_returnflag": "varchar2(1)"}


@registered("""SELECT l_orderkey, l_linenumber, l_partkey,
 concat_ws('; ', CASE WHEN l_partkey > 32767 THEN 'l_partkey: no SmallInt' END, CASE WHEN round(l_extendedprice, 2) >= 100000 THEN 'l_extendedprice: no Decimal(7,2)' END) AS reasons,
 CASE WHEN round(l_extendedprice, 2) < 100000 THEN l_extendedprice::DECIMAL(7,2)::VARCHAR END AS price FROM lineitem""")
def cast_by_type_map(spark, sf_dir):
    """Lines of an Oracle table as a PostgreSQL table would hold them."""
    li = P.load(spark, sf_dir, "lineitem").select(*_LINE_TYPES)
    out = by_type_map(li, _LINE_TYPES, "Oracle", "PostgreSql")
    keys = [F.col(f"source.{c}").alias(c) for c in ("l_orderkey", "l_linenumber", "l_partkey")]
    return out.select(*keys, F.array_join("reasons", "; ").alias("reasons"), F.col("row.l_extendedprice").cast("string").alias("price"))


@registered("""SELECT 'SqlServer' AS engine, count(*) FILTER (WHERE p_partkey - 1 < 0 OR p_partkey - 1 > 255) AS overflow FROM part
 UNION ALL SELECT 'MySql', count(*) FILTER (WHERE p_partkey - 1 > 127) FROM part""")
def cast_loss_small(spark, sf_dir):
    """Part numbers (from -1 on) that a tiny integer cannot hold, by engine."""
    part = P.load(spark, sf_dir, "part").select((F.col("p_partkey") - 1).alias("n"))
    each = [cast_loss_audit(part, [("n", "TinyInt", None, None)], engine=e).select(F.lit(e).alias("engine"), "overflow") for e in ("SqlServer", "MySql")]
    return each[0].unionByName(each[1])
