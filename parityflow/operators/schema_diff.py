"""Differences between two database schemas held as catalog tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parityflow.functions.keys import q
from parityflow.operators.type_mapping import canonical_text, canonicalise
from parityflow.session import materialised

ADDED, REMOVED, MODIFIED, UNCHANGED = "Added", "Removed", "Modified", "Unchanged"
DETAIL = "array<struct<property:string,source_value:string,target_value:string>>"

COLUMN_PROPERTIES = ("data_type", "is_nullable", "max_length", "precision", "scale", "default_value")
INDEX_PROPERTIES = ("columns", "is_unique", "is_clustered")
CONSTRAINT_PROPERTIES = ("constraint_type", "columns", "referenced_table", "referenced_columns")


@dataclass(frozen=True)
class Catalog:
    """``tables(table_name)``; ``columns``, ``indexes`` and ``constraints`` carry
    ``table_name, name`` and their properties.  Indexes and constraints are optional."""

    tables: DataFrame
    columns: DataFrame
    indexes: DataFrame | None = None
    constraints: DataFrame | None = None


def _shown(c: Column, dtype: str) -> Column:
    return F.when(c.isNotNull(), F.array_join(c, ", ")) if dtype.startswith("array") else c.cast("string")


def _objects(source: DataFrame, target: DataFrame, kind: str, properties: Sequence[str], common: DataFrame) -> DataFrame:
    """Objects of one kind, for tables both sides have."""

    def side(df: DataFrame, prefix: str) -> DataFrame:
        # tables of the other side only do not take part
        known = df.join(common, "table_name", "left_semi")
        return known.select("table_name", "name", *[q(p).alias(prefix + p) for p in properties], F.lit(True).alias(prefix + "here"))

    joined = side(source, "s_").join(side(target, "t_"), ["table_name", "name"], "full_outer")
    types = dict(source.dtypes)
    in_s, in_t = F.col("s_here").isNotNull(), F.col("t_here").isNotNull()
    details = []
    for p in properties:
        s, t = q("s_" + p), q("t_" + p)
        same = F.lower(F.trim(s)).eqNullSafe(F.lower(F.trim(t))) if p == "data_type" else s.eqNullSafe(t)
        entry = F.struct(
            F.lit(p).alias("property"), _shown(s, types[p]).alias("source_value"), _shown(t, types[p]).alias("target_value")
        )
        details.append(F.when(in_s & in_t & ~same, entry))
    found = F.array_compact(F.array(*details)).cast(DETAIL)
    change = (
        F.when(~in_t, F.lit(REMOVED)).when(~in_s, F.lit(ADDED)).when(F.size(found) > 0, F.lit(MODIFIED)).otherwise(F.lit(UNCHANGED))
    )
    return joined.select(
        F.lit(kind).alias("object_type"),
        "table_name",
        F.concat_ws(".", "table_name", "name").alias("object_name"),
        change.alias("change_type"),
        found.alias("details"),
    )


def schema_diff(source: Catalog, target: Catalog) -> DataFrame:
    """``object_type, table_name, object_name, change_type, details``.

    Only in the source is ``Removed``, only in the target ``Added``.  A table both
    sides have shows up itself (``Unchanged``) only when it has no parts at all.
    """
    # the list of tables is read by every part below, so it is worked out once
    names = materialised(
        source.tables.select("table_name", F.lit(True).alias("in_s"), F.lit(False).alias("in_t"))
        .unionByName(target.tables.select("table_name", F.lit(False).alias("in_s"), F.lit(True).alias("in_t")))
        .groupBy("table_name")
        .agg(F.bool_or("in_s").alias("in_s"), F.bool_or("in_t").alias("in_t"))
    )
    common = names.filter("in_s AND in_t").select("table_name")

    def tables(found: DataFrame, change: str) -> DataFrame:
        return found.select(
            F.lit("Table").alias("object_type"), "table_name", F.col("table_name").alias("object_name"),
            F.lit(change).alias("change_type"), F.array().cast(DETAIL).alias("details"),
        )

    parts = _objects(source.columns, target.columns, "Column", COLUMN_PROPERTIES, common)
    if source.indexes is not None and target.indexes is not None:
        parts = parts.unionByName(_objects(source.indexes, target.indexes, "Index", INDEX_PROPERTIES, common))
    if source.constraints is not None and target.constraints is not None:
        parts = parts.unionByName(_objects(source.constraints, target.constraints, "Constraint", CONSTRAINT_PROPERTIES, common))
    filled = source.columns.select("table_name").unionByName(target.columns.select("table_name"))
    for extra in (source.indexes, target.indexes, source.constraints, target.constraints):
        if extra is not None:
            filled = filled.unionByName(extra.select("table_name"))
    bare = common.join(filled.distinct(), "table_name", "left_anti")
    return (
        parts.unionByName(tables(names.filter("NOT in_t"), REMOVED))
        .unionByName(tables(names.filter("NOT in_s"), ADDED))
        .unionByName(tables(bare, UNCHANGED))
    )


def with_canonical_types(catalog: Catalog, engine: str) -> Catalog:
    """The catalog with canonical type names, for a diff across engines."""
    typed = canonicalise(catalog.columns.withColumn("__engine_name", F.lit(engine)), "__engine_name", "data_type", "__canonical")
    columns = typed.withColumn("data_type", canonical_text(F.col("__canonical"))).drop("__canonical", "__engine_name")
    return Catalog(catalog.tables, columns, catalog.indexes, catalog.constraints)


def detail_rows(d: DataFrame) -> DataFrame:
    """One row per changed property."""
    return d.select("object_type", "object_name", "change_type", F.explode("details").alias("d")).select(
        "object_type", "object_name", "change_type", "d.property", "d.source_value", "d.target_value"
    )


def schema_summary(d: DataFrame) -> DataFrame:
    names = {"additions": ADDED, "removals": REMOVED, "modifications": MODIFIED, "unchanged": UNCHANGED}
    return d.agg(*[F.count_if(F.col("change_type") == v).alias(k) for k, v in names.items()])


def filter_changes(
    d: DataFrame, change_type: str | None = None, object_type: str | None = None, text: str | None = None
) -> DataFrame:
    if change_type:
        d = d.filter(F.col("change_type") == change_type)
    if object_type:
        d = d.filter(F.col("object_type") == object_type)
    if text:
        d = d.filter(F.lower("object_name").contains(text.lower()) | F.lower("object_type").contains(text.lower()))
    return d


def change_rollup(d: DataFrame) -> DataFrame:
    """Difference counts per object type within a table and per table (object type NULL)."""
    return (
        d.rollup("table_name", "object_type")
        .agg(F.count_if(F.col("change_type") != UNCHANGED).alias("diff_count"), F.count(F.lit(1)).alias("n_objects"))
        .filter(F.col("table_name").isNotNull())
    )
