"""Reading tables: files, JDBC, queries, pages, counts and document fields."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parityflow.functions.keys import q


def jdbc_options(
    jdbc: Mapping[str, str], table: str, fetch_size: int, partition_on: str | None, bounds: tuple | None, num_partitions: int
) -> dict[str, str]:
    """Reader options for a whole table, in ranges of ``partition_on`` where it has values."""
    options = {**jdbc, "dbtable": table, "fetchsize": str(fetch_size)}
    if partition_on is not None and bounds is not None and bounds[0] is not None:
        options.update(
            partitionColumn=partition_on, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(num_partitions)
        )
    return options


def read_table(
    spark: SparkSession,
    table: str,
    path: str | None = None,
    fmt: str = "parquet",
    jdbc: Mapping[str, str] | None = None,
    partition_on: str | None = None,
    bounds: tuple[int, int] | None = None,
    num_partitions: int = 32,
    fetch_size: int = 10_000,
    options: Mapping[str, object] | None = None,
) -> DataFrame:
    """Scan a whole table.

    With ``jdbc`` (url, driver, user ...) the table is read through the
    database's driver, in ``num_partitions`` ranges of ``partition_on``.  Bounds
    come from the database when not given.  With ``path`` it is a file table
    read with ``options``, else a table of the session catalog.
    """
    if jdbc is not None:
        if partition_on is not None and bounds is None:
            probe = f"(SELECT MIN({partition_on}) AS lo, MAX({partition_on}) AS hi FROM {table}) b"
            bounds = tuple(spark.read.format("jdbc").options(**{**jdbc, "dbtable": probe}).load().first())
        chosen = jdbc_options(jdbc, table, fetch_size, partition_on, bounds, num_partitions)
        return spark.read.format("jdbc").options(**chosen).load()
    if path is not None:
        return spark.read.format(fmt).options(**(options or {})).load(path)
    return spark.table(table)


def read_query(spark: SparkSession, query: str, jdbc: Mapping[str, str] | None = None) -> DataFrame:
    """Rows of a query: run by the database over JDBC, or by Spark SQL."""
    if jdbc is None:
        return spark.sql(query)
    return spark.read.format("jdbc").options(**jdbc).option("query", query).load()


def page(df: DataFrame, order_by: Sequence[str], limit: int = 100, offset: int = 0, descending: bool = False) -> DataFrame:
    """One page under an explicit order (ties make pages unstable, so end with a unique column)."""
    order = [q(c).desc() if descending else q(c).asc() for c in order_by]
    return df.orderBy(*order).offset(offset).limit(limit)


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``table_name, row_count`` for every table; Parquet answers from its footers."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def profile_json_fields(df: DataFrame, json_column: str, order_by: Sequence[str]) -> DataFrame:
    """Fields of a JSON text column: ``name, data_type, n_rows, ordinal_position``.

    The type is that of the field's first row under ``order_by``.  All rows are
    read, and the aggregation combines per task, so no row is held back.
    """
    parsed = df.select(F.struct(*[q(c) for c in order_by]).alias("at"), F.try_parse_json(q(json_column)).alias("doc"))
    view = parsed.filter(F.col("doc").isNotNull())
    fields = view.lateralJoin(
        view.sparkSession.tvf.variant_explode(F.col("doc").outer()).select("key", "value")
    ).filter(F.col("key").isNotNull())
    # Spark's variant type names and the document store's names for them.
    names = {"BIGINT": "long", "DOUBLE": "double", "STRING": "string", "BOOLEAN": "bool", "VOID": "null"}
    kind = F.regexp_extract(F.schema_of_variant("value"), r"^[A-Z]+", 0)
    named = F.when(kind == "OBJECT", F.lit("object")).when(kind == "ARRAY", F.lit("array")).when(kind == "DECIMAL", F.lit("double"))
    for spark_name, name in names.items():
        named = named.when(kind == spark_name, F.lit(name))
    found = fields.select("key", "at", named.otherwise(F.lower(kind)).alias("data_type"))
    grouped = found.groupBy(F.col("key").alias("name")).agg(
        F.min_by("data_type", "at").alias("data_type"), F.count(F.lit(1)).alias("n_rows")
    )
    return grouped.select("name", "data_type", "n_rows", (F.col("name") == "_id").alias("is_primary_key"))
