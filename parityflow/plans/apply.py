"""Apply a plan to the target table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parityflow.config import CompareConfig, MigrationConfig
from parityflow.functions.casts import held
from parityflow.functions.keys import join_key_columns, q
from parityflow.operators.compare import MATCHED, diff
from parityflow.plans.plan import DELETE, INSERT, KEEP, REVIEW, UPDATE, decide, plan, plan_keys
from parityflow.session import materialised


def misfits(row: Column, have: T.StructType, want: T.StructType) -> Column:
    """``array<string>``: the columns of ``row`` whose value the target column cannot hold."""
    known = {f.name: f.dataType for f in have}
    notes = []
    for f in want:
        if f.name in known and known[f.name] != f.dataType:
            cell = row.getField(f.name)
            lost = cell.isNotNull() & held(cell, known[f.name], f.dataType).isNull()
            notes.append(F.when(lost, F.lit(f"Column '{f.name}' cannot hold the value as {f.dataType.simpleString()}")))
    return F.array_compact(F.array(*notes)) if notes else F.array().cast("array<string>")


def rejected_rows(target: DataFrame, p: DataFrame) -> DataFrame:
    """Planned inserts and updates that ``apply_plan`` leaves out, with ``errors``: values that the target cannot hold."""
    rows = p.filter(F.col("action").isin(INSERT, UPDATE)).withColumn("errors", misfits(F.col("row"), p.schema["row"].dataType, target.schema))
    return rows.filter(F.size("errors") > 0)


def apply_plan(target: DataFrame, p: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """The target after the plan: kept, replaced and inserted rows.

    One null-safe join; an update replaces every row that carries its key, a
    delete removes every such row, as the statements in a database would. A row
    with a value that its target column cannot hold is not applied;
    ``rejected_rows`` gives these.
    """
    keys = list(keys) if keys is not None else plan_keys(p)
    columns = target.columns
    types = {f.name: f.dataType for f in p.schema["row"].dataType}
    known = set(types)
    wrong = misfits(F.col("row"), p.schema["row"].dataType, target.schema)
    p = p.filter((F.col("action") == DELETE) | (F.size(wrong) == 0))

    def cell(name: str):
        dtype = target.schema[name].dataType
        return (held(F.col("__row").getField(name), types[name], dtype) if name in known else F.lit(None).cast(dtype)).alias(name)

    inserts = p.filter(F.col("action") == INSERT).withColumnRenamed("row", "__row").select(*[cell(c) for c in columns])
    changes = p.filter(F.col("action").isin(UPDATE, DELETE)).select(
        *[q(k).try_cast(target.schema[k].dataType).alias(k) for k in keys],
        F.col("action").alias("__action"),
        F.when(F.col("action") == UPDATE, F.col("row")).alias("__row"),  # a delete needs no cells
    )
    t, names = join_key_columns(target, keys)
    c, _ = join_key_columns(changes, keys)
    joined = t.join(c.select(*names, "__action", "__row"), names, "left_outer")
    kept = joined.filter(F.coalesce(F.col("__action"), F.lit(KEEP)) != DELETE)
    # a column only the target has keeps its value
    replaced = [
        F.when(F.col("__action") == UPDATE, cell(n)).otherwise(q(n)).alias(n) if n in known else q(n) for n in columns
    ]
    return kept.select(*replaced).unionByName(inserts)


def result_table(decided: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The table after a decided diff, straight from it: no second join.

    For targets with unique keys; matched rows keep the target's cells, so a hash
    diff, which does not carry them, is refused.
    """
    action = F.col("action")
    lost = (F.col("status") == MATCHED) & F.col("target").isNull()
    kept = F.when(lost, F.raise_error(F.lit("a hash diff has no rows to keep; use a plain diff"))).otherwise(F.col("target"))
    row = F.when(action.isin(INSERT, UPDATE), F.col("row")).otherwise(kept)
    # a source-only row that is kept out (AppendOnly updates and the like) has no target cells
    stays = (action != DELETE) & row.isNotNull()
    return decided.filter(stays).select(*[row.getField(c).alias(c) for c in columns])


def sync(
    source: DataFrame,
    target: DataFrame,
    compare: CompareConfig = CompareConfig(),
    cfg: MigrationConfig = MigrationConfig(),
    partial: bool = False,
) -> DataFrame:
    """Diff, decide and apply in one pass: one shuffle per side in total.

    That holds where ``keys_unique`` promises it, and for a mirror, whose result has one row
    for each key of the source. Otherwise target rows that share a key must all survive, so
    the decisions are joined to the whole target as in ``migrate``.
    """
    if not compare.keys_unique and cfg.mode != "Mirror":
        return migrate(source, target, replace(compare, use_hash_mode=False), cfg, partial)[0]
    d = diff(source, target, replace(compare, use_hash_mode=False))
    return result_table(decide(d, cfg, partial, target.columns), target.columns)


def migrate(
    source: DataFrame,
    target: DataFrame,
    compare: CompareConfig = CompareConfig(),
    cfg: MigrationConfig = MigrationConfig(),
    partial: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """The new target and the plan behind it.

    The plan is written once: it can be reviewed, counted and turned into a
    script, and the tables are compared a single time.
    """
    p = materialised(plan(source, target, compare, cfg, partial))
    return apply_plan(target, p), p


def result_summary(p: DataFrame, status: str = "Completed", errors: int = 0, duration_ms: int = 0) -> DataFrame:
    """One row: rows inserted, updated, deleted, skipped, errors, duration and status."""
    names = {INSERT: "rows_inserted", UPDATE: "rows_updated", DELETE: "rows_deleted", REVIEW: "rows_skipped"}
    return p.agg(*[F.count_if(F.col("action") == a).alias(n) for a, n in names.items()]).select(
        "*",
        F.lit(errors).cast("long").alias("errors"),
        F.lit(duration_ms).cast("long").alias("duration_ms"),
        F.lit(status).alias("status"),
    )
