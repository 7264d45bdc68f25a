"""Catalog tables: what tables, columns, indexes and constraints a database has."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLUMN_FIELDS = (
    "table_name string, name string, data_type string, is_nullable boolean, is_primary_key boolean, max_length int, "
    "precision int, scale int, default_value string, ordinal_position int"
)


def list_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Tables of the session catalog in name order, views left out."""
    rows = [(t.name,) for t in spark.catalog.listTables(database) if t.tableType != "VIEW" and not t.isTemporary]
    return spark.createDataFrame(rows, "table_name string").orderBy("table_name")


def schema_columns(spark: SparkSession, tables: Mapping[str, DataFrame], primary_keys: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """The column catalog of DataFrames, from their schemas alone."""
    keys, rows = primary_keys or {}, []
    for table, df in tables.items():
        for i, f in enumerate(df.schema):
            decimal = f.dataType if isinstance(f.dataType, T.DecimalType) else None
            rows.append(
                (
                    table, f.name, f.dataType.simpleString(), f.nullable, f.name in keys.get(table, ()), f.metadata.get("max_length"),
                    decimal.precision if decimal else None, decimal.scale if decimal else None, f.metadata.get("default"), i + 1,
                )
            )
    return spark.createDataFrame(rows, COLUMN_FIELDS)


def assemble_tables(tables: DataFrame) -> DataFrame:
    """Base tables in name order from ``information_schema.tables``."""
    return tables.filter(F.upper("table_type") == "BASE TABLE").select("table_name").orderBy("table_name")


def assemble_columns(columns: DataFrame, table_constraints: DataFrame, key_usage: DataFrame) -> DataFrame:
    """Columns with their primary-key flag from three ``information_schema`` views."""
    pk = (
        table_constraints.filter(F.upper("constraint_type") == "PRIMARY KEY")
        .select("table_name", "constraint_name")
        .join(key_usage.select("table_name", "constraint_name", "column_name"), ["table_name", "constraint_name"])
        .select("table_name", F.col("column_name").alias("name"), F.lit(True).alias("__pk"))
        .distinct()
    )
    base = columns.select(
        "table_name",
        F.col("column_name").alias("name"),
        "data_type",
        (F.upper("is_nullable") == "YES").alias("is_nullable"),
        F.col("character_maximum_length").cast("int").alias("max_length"),
        F.col("numeric_precision").cast("int").alias("precision"),
        F.col("numeric_scale").cast("int").alias("scale"),
        F.col("column_default").alias("default_value"),
        F.col("ordinal_position").cast("int").alias("ordinal_position"),
    )
    out = base.join(pk, ["table_name", "name"], "left_outer").withColumn("is_primary_key", F.col("__pk").isNotNull()).drop("__pk")
    return out.select(*[part.split()[0] for part in COLUMN_FIELDS.split(", ")])


# The kinds of constraints by their standard names.
CONSTRAINT_KINDS = {"PRIMARY KEY": "PrimaryKey", "FOREIGN KEY": "ForeignKey", "UNIQUE": "Unique", "CHECK": "Check", "DEFAULT": "Default"}


def _ordered(position: str, name: str):
    """Column names in position order, repeats from joins taken once."""
    return F.transform(F.array_sort(F.collect_set(F.struct(F.col(position).alias("p"), F.col(name).alias("n")))), lambda x: x["n"])


def assemble_constraints(table_constraints: DataFrame, key_usage: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """One row per constraint with its column lists.

    ``references(constraint_name, position, referenced_table, referenced_column)``.
    """
    kind = F.upper("constraint_type")
    named = F.lit(None).cast("string")
    for standard, name in CONSTRAINT_KINDS.items():
        named = F.when(kind == standard, F.lit(name)).otherwise(named)
    columns = key_usage.groupBy("table_name", "constraint_name").agg(_ordered("ordinal_position", "column_name").alias("columns"))
    out = table_constraints.select("table_name", "constraint_name", named.alias("constraint_type")).join(
        columns, ["table_name", "constraint_name"], "left_outer"
    )
    if references is not None:
        pointed = references.groupBy("constraint_name").agg(
            F.min("referenced_table").alias("referenced_table"), _ordered("position", "referenced_column").alias("referenced_columns")
        )
        out = out.join(pointed, "constraint_name", "left_outer")
    else:
        out = out.withColumn("referenced_table", F.lit(None).cast("string")).withColumn("referenced_columns", F.lit(None).cast("array<string>"))
    return out.select(
        "table_name", F.col("constraint_name").alias("name"), "constraint_type",
        F.coalesce("columns", F.array().cast("array<string>")).alias("columns"), "referenced_table", "referenced_columns",
    )


def assemble_indexes(index_columns: DataFrame) -> DataFrame:
    """One row per index from one row per index column.

    ``index_columns(table_name, index_name, position, column_name, is_unique, is_clustered, index_type)``.
    """
    return index_columns.groupBy("table_name", F.col("index_name").alias("name")).agg(
        _ordered("position", "column_name").alias("columns"),
        F.bool_or("is_unique").alias("is_unique"),
        F.bool_or("is_clustered").alias("is_clustered"),
        F.min("index_type").alias("index_type"),
    )


def read_information_schema(spark: SparkSession, jdbc: Mapping[str, str], schema: str) -> dict[str, DataFrame]:
    """Tables, columns and constraints of a database over JDBC: one read per view for all tables."""

    def view(name: str, columns: str) -> DataFrame:
        query = f"SELECT {columns} FROM information_schema.{name} WHERE table_schema = '{schema}'"
        df = spark.read.format("jdbc").options(**jdbc).option("query", query).load()
        return df.toDF(*[c.lower() for c in df.columns])

    tables = view("tables", "table_name, table_type")
    columns = view(
        "columns",
        "table_name, column_name, data_type, is_nullable, character_maximum_length, numeric_precision, numeric_scale, "
        "column_default, ordinal_position",
    )
    constraints = view("table_constraints", "table_name, constraint_name, constraint_type")
    usage = view("key_column_usage", "table_name, constraint_name, column_name, ordinal_position")
    return {
        "tables": assemble_tables(tables),
        "columns": assemble_columns(columns, constraints, usage),
        "constraints": assemble_constraints(constraints, usage),
    }
