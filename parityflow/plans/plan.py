"""From a diff to a plan: which row is inserted, updated, deleted or reviewed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parityflow.config import CompareConfig, MigrationConfig
from parityflow.functions.keys import q
from parityflow.operators.compare import DELETED, INSERTED, UPDATED, diff
from parityflow.session import materialised

INSERT, UPDATE, DELETE, REVIEW, KEEP = "insert", "update", "delete", "review", "keep"
ACTION_ORDER = (INSERT, UPDATE, DELETE)


def parse_rules(rules: Sequence[str]) -> dict[str, str]:
    """``column:source|target`` pairs; entries without a colon are ignored, the last one counts."""
    pairs = [r.split(":", 1) for r in rules if ":" in r]
    return {column: side for column, side in pairs}


def _resolved_action(d: DataFrame, cfg: MigrationConfig) -> Column:
    if cfg.policy == "TargetWins":
        return F.lit(KEEP)
    if cfg.policy == "ManualReview":
        return F.lit(REVIEW)
    if cfg.policy == "NewestWins":
        ts = cfg.timestamp_column
        if ts not in d.schema["source"].dataType.fieldNames():
            return F.lit(UPDATE)
        newer = F.col("source").getField(ts) >= F.col("target").getField(ts)
        return F.when(F.coalesce(newer, F.lit(True)), F.lit(UPDATE)).otherwise(F.lit(KEEP))
    return F.lit(UPDATE)


def _resolved_row(d: DataFrame, cfg: MigrationConfig, partial: bool, target_columns: Sequence[str] | None) -> Column:
    """The row an update writes."""
    fields = d.schema["source"].dataType.fieldNames()
    src, tgt = F.col("source"), F.col("target")
    from_target = set()
    if cfg.policy == "CustomRules":
        known = set(fields if target_columns is None else target_columns)
        from_target = {c for c, side in parse_rules(cfg.rules).items() if side == "target" and c in known}
    if not partial and not from_target:
        return src
    cells = []
    for name in fields:
        cell = tgt.getField(name) if name in from_target else src.getField(name)
        if partial and name not in from_target:
            cell = F.when(F.array_contains("changed_columns", name), cell).otherwise(tgt.getField(name))
        cells.append(cell.alias(name))
    return F.struct(*cells)


def decide(
    d: DataFrame,
    cfg: MigrationConfig = MigrationConfig(),
    partial: bool = False,
    target_columns: Sequence[str] | None = None,
) -> DataFrame:
    """The diff with ``action`` and the ``row`` that action writes (for every key, kept ones too)."""
    status = F.col("status")
    inserts, updates, deletes = {
        "InsertUpdate": (True, True, False),
        "Merge": (True, True, False),
        "Mirror": (True, True, True),
        "AppendOnly": (True, False, False),
        "SchemaOnly": (False, False, False),
    }[cfg.mode]
    action = F.lit(KEEP)
    if deletes:
        action = F.when(status == DELETED, F.lit(DELETE)).otherwise(action)
    if updates:
        action = F.when(status == UPDATED, _resolved_action(d, cfg)).otherwise(action)
    if inserts:
        action = F.when(status == INSERTED, F.lit(INSERT)).otherwise(action)
    row = F.when(status == UPDATED, _resolved_row(d, cfg, partial, target_columns))
    row = row.when(status == DELETED, F.col("target")).otherwise(F.col("source"))
    return d.select("*", action.alias("action"), row.alias("row"))


def plan(
    source: DataFrame,
    target: DataFrame,
    compare: CompareConfig = CompareConfig(),
    cfg: MigrationConfig = MigrationConfig(),
    partial: bool = False,
) -> DataFrame:
    """Only the rows that something happens to: ``action, <keys>, row, changed_columns``."""
    decided = decide(diff(source, target, compare), cfg, partial, target.columns)
    return decided.filter(F.col("action") != KEEP).drop("status", "source", "target")


def plan_keys(p: DataFrame) -> list[str]:
    """The key columns of a plan or decided diff."""
    own = ("status", "source", "target", "changed_columns", "action", "row")
    return [c for c in p.columns if c not in own and not c.startswith("__")]


def action_counts(p: DataFrame) -> DataFrame:
    """Dry run: what would happen, one row."""
    names = {INSERT: "inserts", UPDATE: "updates", DELETE: "deletes", REVIEW: "reviews"}
    return p.agg(*[F.count_if(F.col("action") == a).alias(n) for a, n in names.items()])


def batch_count(ops: Column, batch_size: int) -> Column:
    return F.ceil(ops / F.lit(max(1, batch_size))).cast("long")


def plan_counts(source: DataFrame, target: DataFrame, p: DataFrame, cfg: MigrationConfig) -> DataFrame:
    """Row counts of both tables, operations by kind and the number of batches."""
    zero = F.lit(0).cast("long")
    wanted = ["source_rows", "target_rows", "inserts", "updates", "deletes", "reviews"]
    parts = [
        source.agg(F.count(F.lit(1)).alias("source_rows")),
        target.agg(F.count(F.lit(1)).alias("target_rows")),
        action_counts(p),
    ]
    rows = [x.select(*[(F.col(c) if c in x.columns else zero).alias(c) for c in wanted]) for x in parts]
    total = rows[0].unionByName(rows[1]).unionByName(rows[2]).agg(*[F.sum(c).alias(c) for c in wanted])
    ops = F.col("inserts") + F.col("updates") + F.col("deletes")
    return total.withColumn("batch_count", batch_count(ops, cfg.batch_size))


def assign_batches(p: DataFrame, batch_size: int, bucket_rows: int = 100_000) -> DataFrame:
    """Number the operations inserts, updates, deletes and cut them into batches.

    Ranks are local to (action, key bucket) and lifted by the bucket offsets, so
    no task ever sorts the whole plan.  Keys are unique in a plan, hence the
    buckets are even.  The plan is written once and counted; it gets a bucket
    for every ``bucket_rows`` operations.
    """
    keys = plan_keys(p)
    ops = materialised(p.filter(F.col("action").isin(*ACTION_ORDER)))
    buckets = ops.count() // bucket_rows + 1
    place = F.when(F.col("action") == INSERT, 0).when(F.col("action") == UPDATE, 1).otherwise(2)
    ops = ops.withColumn("__place", place).withColumn("__bucket", F.pmod(F.xxhash64(*[q(k) for k in keys]), F.lit(buckets)))
    sizes = ops.groupBy("__place", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    # one row for each bucket of an action: the ordered window sees 3 rows for every ``bucket_rows`` operations
    before = Window.orderBy("__place", "__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__place", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    local = Window.partitionBy("__place", "__bucket").orderBy(*[q(k) for k in keys])
    ranked = ops.withColumn("__rank", F.row_number().over(local)).join(offsets, ["__place", "__bucket"])
    op_no = F.col("__offset") + F.col("__rank") - 1
    return ranked.withColumn("batch_id", F.floor(op_no / F.lit(max(1, batch_size))).cast("long")).drop(
        "__place", "__bucket", "__rank", "__offset"
    )
