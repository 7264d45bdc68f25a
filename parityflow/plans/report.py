"""Reports as facts, and facts as lines of Markdown.

A report is ``section, item, metric, value``, all text, one row per fact. Facts are made by column
expressions, so the report of a long diff stays distributed; ``markdown`` turns any of them
into lines for ``export_lines``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parityflow.config import MigrationConfig
from parityflow.operators.schema_diff import schema_summary
from parityflow.session import materialised

FACT = "section string, item string, metric string, value string"
TOTALS = ("total_rows", "processed_rows", "inserted", "updated", "deleted", "skipped", "errors")


def _given(spark: SparkSession, section: str, facts: Sequence[tuple[str, str, object]]) -> DataFrame:
    return spark.createDataFrame([(section, item, metric, str(value)) for item, metric, value in facts], FACT)


def _facts(df: DataFrame, section: Column, item: Column, **metrics: Column) -> DataFrame:
    """One fact per row and metric."""
    each = F.array(*[F.struct(F.lit(m).alias("metric"), c.cast("string").alias("value")) for m, c in metrics.items()])
    return df.select(section.alias("section"), item.alias("item"), F.inline(each))


def _all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def schema_diff_report(d: DataFrame, source_name: str, target_name: str) -> DataFrame:
    """What was compared, objects per kind of change, and every object with the properties that differ.

    An object's section is its type; the value of a property is ``old => new``, ``?`` where a side has none.
    """
    d = materialised(d)  # read by every section
    counts = schema_summary(d)
    found = d.select("object_type", "object_name", F.explode("details").alias("x"))
    sides = F.concat(F.coalesce("x.source_value", F.lit("?")), F.lit(" => "), F.coalesce("x.target_value", F.lit("?")))
    return _all(
        [
            _given(d.sparkSession, "compared", [("source", "name", source_name), ("target", "name", target_name)]),
            _facts(counts, F.lit("objects"), F.lit("all"), **{c: F.col(c) for c in counts.columns}),
            _facts(d, F.col("object_type"), F.col("object_name"), change=F.lower("change_type")),
            found.select(F.col("object_type").alias("section"), F.col("object_name").alias("item"), F.col("x.property").alias("metric"), sides.alias("value")),
        ]
    )


def migration_plan_report(dry_run: DataFrame, cfg: MigrationConfig) -> DataFrame:
    """Settings, expected work per table and warnings, from ``dry_run_report``."""
    dry_run = materialised(dry_run)  # read by every section
    table = F.col("source_table")
    work = {c: F.col(c) for c in ("target_table", "source_rows", "inserts", "updates", "deletes", "skips")}
    notes = dry_run.select("source_table", F.posexplode("warnings").alias("n", "w"))
    return _all(
        [
            _given(dry_run.sparkSession, "settings", [("run", "mode", cfg.mode), ("run", "policy", cfg.policy), ("run", "batch_size", cfg.batch_size)]),
            _facts(dry_run, F.lit("tables"), table, **work),
            notes.select(F.lit("warnings").alias("section"), table.alias("item"), (F.col("n") + 1).cast("string").alias("metric"), F.col("w").alias("value")),
        ]
    )


def migration_summary_report(progress: DataFrame, cfg: MigrationConfig, status: str, errors: DataFrame | None = None) -> DataFrame:
    """Outcome, totals, every table and its errors, from ``progress_rows``.

    ``errors(table_name, row_index, message)``; the metric of an error is its row, if it has one.
    """
    progress = materialised(progress)  # read by every section
    table = F.col("table_name")
    parts = [
        _given(progress.sparkSession, "run", [("run", "status", status), ("run", "mode", cfg.mode), ("run", "policy", cfg.policy)]),
        _facts(progress.agg(*[F.sum(c).alias(c) for c in TOTALS]), F.lit("totals"), F.lit("all"), **{c: F.col(c) for c in TOTALS}),
        _facts(progress, F.lit("tables"), table, status=F.col("status"), **{c: F.col(c) for c in TOTALS}),
    ]
    if errors is not None:
        row = F.coalesce(F.concat(F.lit("row "), F.col("row_index").cast("string")), F.lit("table"))
        parts.append(errors.select(F.lit("failures").alias("section"), table.alias("item"), row.alias("metric"), F.col("message").alias("value")))
    return _all(parts)


def markdown(report: DataFrame, title: str) -> DataFrame:
    """``section, item, metric, line``: sort by the first three columns to read it.

    The title comes first, a heading before each section, then a bullet per fact; line ends within a fact become spaces.
    """
    flat = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\R", " ")
    fact = F.concat(F.lit("* "), flat("item"), F.lit(", "), flat("metric"), F.lit(": "), flat("value"))
    empty = F.lit("")
    heads = report.select("section").distinct().select("section", empty.alias("item"), empty.alias("metric"), F.concat(F.lit("## "), flat("section")).alias("line"))
    top = report.sparkSession.createDataFrame([("", "", "", f"# {title}")], "section string, item string, metric string, line string")
    return top.unionByName(heads).unionByName(report.select("section", "item", "metric", fact.alias("line")))
