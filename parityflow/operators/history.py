"""Run history, audit entries and schedules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parityflow.functions.cron import matches_cron
from parityflow.functions.keys import q
from parityflow.operators.dedupe import dedupe_last


def latest_execution(runs: DataFrame, job: str = "job_id", started: str = "started_at", tie: Sequence[str] = ("id",)) -> DataFrame:
    """The last run of every job; one row per job leaves each map task."""
    return dedupe_last(runs, [job], [started, *tie])


def executions_of(runs: DataFrame, job_id, job: str = "job_id", started: str = "started_at") -> DataFrame:
    """All runs of one job, oldest first."""
    return runs.filter(q(job) == F.lit(job_id)).orderBy(started)


def expired(ts: Column, now: Column, max_age_days: int) -> Column:
    """Older than ``max_age_days``; entries without a readable time never expire."""
    return F.coalesce(ts < now - F.make_dt_interval(F.lit(max_age_days)), F.lit(False))


def purge(df: DataFrame, ts: str, max_age_days: int, now: Column | None = None) -> DataFrame:
    """What is left after the retention purge (unreadable entries stay)."""
    return df.filter(~expired(q(ts), F.localtimestamp() if now is None else now, max_age_days))


def purged_count(df: DataFrame, ts: str, max_age_days: int, now: Column | None = None) -> DataFrame:
    """How many entries the purge takes."""
    return df.agg(F.count_if(expired(q(ts), F.localtimestamp() if now is None else now, max_age_days)).alias("purged"))


def audit_filter(
    df: DataFrame, date_from=None, date_to=None, action: str | None = None, connection_id: str | None = None
) -> DataFrame:
    """Entries within the inclusive dates, of the action, with the connection on either side."""
    if date_from is not None:
        df = df.filter(F.col("timestamp") >= F.lit(date_from))
    if date_to is not None:
        df = df.filter(F.col("timestamp") <= F.lit(date_to))
    if action is not None:
        df = df.filter(F.col("action") == action)
    if connection_id is not None:
        df = df.filter((F.col("source_connection") == connection_id) | (F.col("target_connection") == connection_id))
    return df


def newest_first(df: DataFrame, ts: str, tie: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(q(ts).desc(), *[q(c).desc() for c in tie])


def replace_by_key(table: DataFrame, rows: DataFrame, keys: Sequence[str], order_by: Sequence[str] = ()) -> DataFrame:
    """``rows`` put into ``table`` by key: whole rows are replaced, new ones added."""
    fresh = dedupe_last(rows, keys, order_by)
    condition = None
    kept, new = table.alias("kept"), fresh.select(*[q(k).alias(f"__{k}") for k in keys])
    for k in keys:
        same = F.col(f"kept.`{k}`").eqNullSafe(q(f"__{k}"))
        condition = same if condition is None else condition & same
    return kept.join(new, condition, "left_anti").unionByName(fresh.select(*table.columns))


def dashboard_counts(jobs: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """``total_jobs, enabled_jobs, runs_24h, failed_24h`` in one row."""
    zero = F.lit(0).cast("long")
    recent = F.col("started_at") >= now - F.make_dt_interval(F.lit(1))
    a = jobs.agg(F.count(F.lit(1)).alias("total_jobs"), F.count_if("enabled").alias("enabled_jobs"))
    b = runs.agg(F.count_if(recent).alias("runs_24h"), F.count_if(recent & (F.col("status") == "Failed")).alias("failed_24h"))
    names = ["total_jobs", "enabled_jobs", "runs_24h", "failed_24h"]
    rows = [x.select(*[(F.col(c) if c in x.columns else zero).alias(c) for c in names]) for x in (a, b)]
    return rows[0].unionByName(rows[1]).agg(*[F.sum(c).alias(c) for c in names])


def recent_feed(jobs: DataFrame, runs: DataFrame, k: int = 10, tie: Sequence[str] = ("id",)) -> DataFrame:
    """The last ``k`` runs with the name of their job; the top-k is taken before the join."""
    top = runs.join(jobs.select("job_id"), "job_id", "left_semi").orderBy(F.desc("started_at"), *[q(c).desc() for c in tie]).limit(k)
    return top.join(jobs.select("job_id", F.col("name").alias("job_name")), "job_id")


def scheduled_minutes(bounds: DataFrame, expression: str) -> DataFrame:
    """Minutes on the schedule between ``low`` and ``high`` (a one-row frame): ``due_at``.

    Days are expanded first, so the minutes of a long span are made by many tasks.
    """
    days = bounds.select("low", "high", F.explode(F.sequence(F.to_date("low"), F.to_date("high"))).alias("day"))
    spread = days.repartition("day")
    minute = F.explode(F.sequence(F.lit(0), F.lit(24 * 60 - 1))).alias("m")
    at = F.col("day").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("m"))
    due = spread.select("low", "high", "day", minute).select("low", "high", at.alias("due_at"))
    return due.filter((F.col("due_at") >= F.col("low")) & (F.col("due_at") <= F.col("high"))).filter(
        matches_cron(F.col("due_at"), expression)
    ).select("due_at")


def missed_runs(runs: DataFrame, expression: str, started: str = "started_at") -> DataFrame:
    """Scheduled minutes, between the first and the last run, in which no run started."""
    bounds = runs.agg(F.date_trunc("minute", F.min(started)).cast("timestamp_ntz").alias("low"), F.max(started).alias("high"))
    # one row per minute, combined in the map tasks, however many runs a minute has
    started_at = runs.select(F.date_trunc("minute", q(started)).cast("timestamp_ntz").alias("due_at")).distinct()
    return scheduled_minutes(bounds, expression).join(started_at, "due_at", "left_anti")
