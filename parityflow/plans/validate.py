"""Check rows against the target's column rules before an insert."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parityflow.config import CompareConfig, MigrationConfig
from parityflow.functions.equality import is_text
from parityflow.functions.keys import q
from parityflow.operators.compare import diff
from parityflow.plans.plan import DELETE, INSERT, REVIEW, UPDATE, decide


@dataclass(frozen=True)
class ColumnRule:
    """The part of a target column definition that inserts must satisfy."""

    name: str
    is_nullable: bool = True
    max_length: int | None = None
    has_default: bool = False


def rules_from_schema(df: DataFrame) -> list[ColumnRule]:
    """Rules of a Spark table: nullability, and ``max_length``/``default`` metadata."""
    return [
        ColumnRule(f.name, f.nullable, f.metadata.get("max_length"), "default" in f.metadata or "CURRENT_DEFAULT" in f.metadata)
        for f in df.schema
    ]


def required_but_absent(columns: Sequence[str], rules: Sequence[ColumnRule]) -> list[str]:
    """Columns the target demands and the source does not have."""
    return [r.name for r in rules if not r.is_nullable and not r.has_default and r.name not in columns]


def validate(df: DataFrame, rules: Sequence[ColumnRule]) -> DataFrame:
    """Rows with long text cut, plus ``warnings array<string>`` and ``is_valid``.

    A row is invalid when a NOT NULL column without default is NULL or absent.
    """
    cells = {c: q(c) for c in df.columns}
    warnings, rejects = [], []
    for rule in rules:
        required = not rule.is_nullable and not rule.has_default
        if rule.name not in cells:
            if required:
                warnings.append(F.lit(f"Column '{rule.name}' is NOT NULL without default and missing from source"))
                rejects.append(F.lit(True))
            continue
        c, dtype = q(rule.name), df.schema[rule.name].dataType
        if is_text(dtype) and rule.max_length is not None and rule.max_length > 0:
            too_long = F.length(c) > rule.max_length
            cells[rule.name] = F.when(too_long, F.left(c, F.lit(rule.max_length))).otherwise(c).alias(rule.name)
            note = F.concat(F.lit(f"Truncated '{rule.name}': "), F.length(c).cast("string"), F.lit(f" -> {rule.max_length} chars"))
            warnings.append(F.when(too_long, note))
        if required:
            note = F.lit(f"Column '{rule.name}' is NOT NULL without default but value is NULL")
            warnings.append(F.when(c.isNull(), note))
            rejects.append(c.isNull())
    notes = F.array_compact(F.array(*warnings)) if warnings else F.array().cast("array<string>")
    invalid = F.lit(False)
    for r in rejects:
        invalid = invalid | r
    return df.select(*[cells[c] for c in df.columns], notes.alias("warnings"), (~invalid).alias("is_valid"))


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows (data columns only) and rejected rows (with their warnings)."""
    return (
        validated.filter("is_valid").drop("warnings", "is_valid"),
        validated.filter("NOT is_valid").drop("is_valid"),
    )


def project_to_target(df: DataFrame, target_columns: Sequence[str]) -> DataFrame:
    """Only the columns the target has, early enough to prune the scan."""
    known = set(target_columns)
    return df.select(*[q(c) for c in df.columns if c in known])


@dataclass(frozen=True)
class TableRun:
    """One table of a migration."""

    source_table: str
    target_table: str
    source: DataFrame
    target: DataFrame
    keys: Sequence[str]
    rules: Sequence[ColumnRule] = ()
    order_by: Sequence[str] = ()


def dry_run_report(runs: Sequence[TableRun], cfg: MigrationConfig = MigrationConfig()) -> DataFrame:
    """What a run would do, one row per table, nothing written."""
    out = None
    for run in runs:
        source = project_to_target(run.source, [r.name for r in run.rules] or run.target.columns)
        d = diff(source, run.target, CompareConfig(keys=run.keys, order_by=run.order_by))
        p = decide(d, cfg)
        rows = p.select("action", F.col("row.*"))
        # the target's columns are there after alignment; what counts is what the source brings
        present = [c for c in source.columns]
        checked = validate(rows.select("action", *[q(c) for c in present]), run.rules)
        inserts = (F.col("action") == INSERT) & F.col("is_valid")
        refused = (F.col("action") == INSERT) & ~F.col("is_valid")
        notes = [
            f"Target column '{c}' is NOT NULL without default and missing from source - inserts will be skipped"
            for c in required_but_absent(present, run.rules)
        ]
        counts = checked.agg(
            F.count_if(inserts).alias("inserts"),
            F.count_if(F.col("action") == UPDATE).alias("updates"),
            F.count_if(F.col("action") == DELETE).alias("deletes"),
            F.count_if((F.col("action") == REVIEW) | refused).alias("skips"),
        )
        zero = F.lit(0).cast("long")
        names = ["source_rows", "target_rows", "inserts", "updates", "deletes", "skips"]
        parts = [
            run.source.agg(F.count(F.lit(1)).alias("source_rows")),
            run.target.agg(F.count(F.lit(1)).alias("target_rows")),
            counts,
        ]
        parts = [x.select(*[(F.col(c) if c in x.columns else zero).alias(c) for c in names]) for x in parts]
        total = parts[0].unionByName(parts[1]).unionByName(parts[2]).agg(*[F.sum(c).alias(c) for c in names])
        row = total.select(
            F.lit(run.source_table).alias("source_table"),
            F.lit(run.target_table).alias("target_table"),
            "*",
            F.array(*[F.lit(n) for n in notes]).cast("array<string>").alias("warnings"),
        )
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("dry_run_report needs at least one table")
    return out


def progress_rows(migration_id: str, run_summaries: Mapping[str, DataFrame]) -> DataFrame:
    """One progress row per finished table from its ``result_summary``."""
    out = None
    for table, summary in run_summaries.items():
        done = F.col("rows_inserted") + F.col("rows_updated") + F.col("rows_deleted")
        total = done + F.col("rows_skipped")
        row = summary.select(
            F.lit(migration_id).alias("migration_id"),
            F.lit(table).alias("table_name"),
            done.alias("processed_rows"),
            total.alias("total_rows"),
            F.col("rows_inserted").alias("inserted"),
            F.col("rows_updated").alias("updated"),
            F.col("rows_deleted").alias("deleted"),
            F.col("rows_skipped").alias("skipped"),
            "errors",
            "status",
            F.when(total == 0, F.lit(100.0)).otherwise(F.round(done * 100.0 / total, 1)).alias("percent"),
        )
        out = row if out is None else out.unionByName(row)
    return out
