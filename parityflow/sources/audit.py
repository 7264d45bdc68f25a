"""Audit entries kept as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parityflow.operators.history import expired

FIELDS = (
    "id string, timestamp string, user string, action string, source_connection string, target_connection string, "
    "affected_rows bigint, details string"
)
REQUIRED = ("id", "timestamp", "user", "action")
# The actions an entry may carry.
ACTIONS = (
    "ConnectionCreated", "ConnectionModified", "ConnectionDeleted", "ConnectionTested", "SchemaCompared", "DataCompared",
    "MigrationStarted", "MigrationCompleted", "MigrationFailed", "MigrationCancelled", "JobCreated", "JobExecuted", "SettingsChanged",
)


def parse_audit_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Entries with the original ``line`` and ``is_malformed``; blank lines are left out."""
    parsed = F.from_json(
        F.trim(F.col(line)), FIELDS + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    )
    rows = lines.filter(F.trim(F.col(line)) != "").select(F.col(line).alias("line"), parsed.alias("e"))
    bad = F.col("e").isNull() | F.col("e._corrupt").isNotNull() | ~F.coalesce(F.col("e.action").isin(*ACTIONS), F.lit(False))
    for name in REQUIRED:
        bad = bad | F.col(f"e.{name}").isNull()
    names = [part.split()[0] for part in FIELDS.split(", ")]
    return rows.select(bad.alias("is_malformed"), *[F.when(~bad, F.col(f"e.{n}")).alias(n) for n in names], "line")


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """All well-formed entries of a JSON-lines folder or file."""
    return parse_audit_lines(spark.read.text(path)).filter("NOT is_malformed").drop("is_malformed", "line")


def purge_audit_lines(lines: DataFrame, max_age_days: int, now) -> DataFrame:
    """The lines a purge leaves behind; malformed ones are kept."""
    parsed = parse_audit_lines(lines)
    at = F.try_to_timestamp(F.col("timestamp")).cast("timestamp_ntz")
    return parsed.filter(~expired(at, now, max_age_days)).select(F.col("line").alias("value"))


def append_audit(entries: DataFrame, path: str) -> None:
    """Add entries as JSON lines."""
    entries.write.mode("append").json(path)
