"""A run over several tables: compared, checked, written in foreign-key order, counted.

Comparing needs no other table, so all tables are compared side by side, parents first, while
results are written level by level: tasks of one table fill the cores that another leaves idle.
The jobs of each table have a tag of their own; ``cancel`` interrupts those under way and keeps
later ones from starting. Counts are taken by an observation while a table's decided rows are
written, so nothing is scanned again for them. A table that fails blocks those that refer to it,
whose results are then not written; the others go on.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Mapping, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from parityflow.config import CompareConfig, MigrationConfig
from parityflow.functions.keys import q
from parityflow.operators.compare import diff
from parityflow.plans.apply import apply_plan, misfits
from parityflow.plans.plan import DELETE, INSERT, KEEP, REVIEW, UPDATE, decide
from parityflow.plans.validate import TableRun, project_to_target, validate
from parityflow.session import shared_dir

COMPLETED, FAILED, BLOCKED, CANCELLED, PENDING = "Completed", "Failed", "Blocked", "Cancelled", "Pending"
SKIPPED, ERROR = "skipped", "error"

SUMMARY = (
    "source_table string, target_table string, level int, rows_inserted long, rows_updated long, rows_deleted long, "
    "rows_skipped long, errors long, duration_ms long, status string, message string"
)
PROGRESS = (
    "migration_id string, table_name string, processed_rows long, total_rows long, inserted long, updated long, deleted long, "
    "skipped long, errors long, status string, percent double"
)
REJECTS = "target_table string, action string, outcome string, reasons array<string>, row string"


@dataclass(frozen=True)
class Outcome:
    """What became of one table."""

    run: TableRun
    level: int = 0
    status: str = PENDING
    counts: Mapping[str, int] | None = None
    duration_ms: int = 0
    message: str | None = None

    def of(self, *names: str) -> int:
        return sum((self.counts or {}).get(n, 0) for n in names)


def decided_rows(run: TableRun, cfg: MigrationConfig) -> DataFrame:
    """``action, outcome, reasons, changed_columns, row, <keys>`` of every row that something happens to.

    The outcome is the action, ``skipped`` (reviews, and inserts that a NOT NULL column refuses) or
    ``error`` (a value that the target column cannot hold). Long text of inserts is cut, with a note.
    """
    source = project_to_target(run.source, [r.name for r in run.rules] or run.target.columns)
    keys = list(run.keys)
    decided = decide(diff(source, run.target, CompareConfig(keys=keys, order_by=run.order_by)), cfg, target_columns=run.target.columns)
    p = decided.filter(F.col("action") != KEEP).select("action", "changed_columns", *[q(k) for k in keys], "row")
    names = p.schema["row"].dataType.fieldNames()
    cells = p.select("row.*")
    checked = validate(p.select("row.*", F.struct("action", "changed_columns", F.struct(*[q(k) for k in keys]).alias("keys"), "row").alias("__p")), run.rules)
    is_insert = q("__p").getField("action") == INSERT
    cut = F.struct(*[q(c).alias(c) for c in names])
    row = F.when(is_insert, cut).otherwise(q("__p").getField("row"))
    notes = F.when(is_insert, F.col("warnings")).otherwise(F.array().cast("array<string>"))
    rows = checked.select(
        q("__p").getField("action").alias("action"), q("__p").getField("changed_columns").alias("changed_columns"),
        *[q("__p").getField("keys").getField(k).alias(k) for k in keys], row.alias("row"), notes.alias("notes"), (~is_insert | F.col("is_valid")).alias("is_valid"),
    )
    wrong = misfits(F.col("row"), cells.schema, run.target.schema)
    rows = rows.withColumn("wrong", F.when(F.col("action").isin(INSERT, UPDATE), wrong).otherwise(F.array().cast("array<string>")))
    outcome = F.when((F.col("action") == REVIEW) | ~F.col("is_valid"), SKIPPED).when(F.size("wrong") > 0, ERROR).otherwise(F.col("action"))
    return rows.select("action", outcome.alias("outcome"), F.concat("notes", "wrong").alias("reasons"), "changed_columns", "row", *[q(k) for k in keys])


class TablesRun:
    """One run; ``start`` does the work, the other methods may be called meanwhile or afterwards."""

    def __init__(
        self,
        spark: SparkSession,
        runs: Sequence[TableRun],
        foreign_keys: Sequence[tuple[str, str]] = (),
        cfg: MigrationConfig = MigrationConfig(),
        workers: int = 4,
        folder: str | None = None,
    ):
        if len({r.target_table for r in runs}) < len(runs):
            raise ValueError("a target table can be named once only")
        self.spark, self.cfg, self.workers = spark, cfg, workers
        self.id = uuid.uuid4().hex
        self.folder = folder or f"{shared_dir(spark)}/run-{self.id}"
        self.parents = {r.target_table: {p for c, p in foreign_keys if c == r.target_table and p != c} for r in runs}
        self.outcomes = {r.target_table: Outcome(r) for r in runs}
        self._stop, self._lock, self._running = threading.Event(), threading.Lock(), []
        self._compared: dict[str, Future] = {}

    def _levels(self) -> list[list[str]]:
        """Tables by level, parents first; those that a cycle keeps back come last, together."""
        out, left = [], set(self.outcomes)
        while left:
            ready = [t for t in self.outcomes if t in left and not (self.parents[t] & left)] or list(left)
            out.append([t for t in self.outcomes if t in ready])
            left -= set(ready)
        return out

    def _note(self, table: str, **changes) -> None:
        with self._lock:
            self.outcomes[table] = replace(self.outcomes[table], **changes)

    def tag(self, table: str) -> str:
        return f"run-{self.id}-{list(self.outcomes).index(table)}"

    def path(self, table: str) -> str:
        return f"{self.folder}/table-{list(self.outcomes).index(table)}"

    def start(self) -> TablesRun:
        levels = self._levels()
        with ThreadPoolExecutor(self.workers) as ahead:
            for level, tables in enumerate(levels):
                for t in tables:
                    self._note(t, level=level)
                    self._compared[t] = ahead.submit(self._compare, t)
            for tables in levels:
                with ThreadPoolExecutor(min(self.workers, len(tables))) as pool:
                    list(pool.map(self._one, tables))
        return self

    def cancel(self) -> None:
        """Stop: start nothing more and interrupt what runs, again until none does, as a table has several jobs."""
        self._stop.set()
        while under_way := list(self._running):
            for t in under_way:
                self.spark.sparkContext.cancelJobsWithTag(self.tag(t))
            time.sleep(0.3)

    def _one(self, table: str) -> None:
        if self._stop.is_set():
            return self._note(table, status=CANCELLED)
        # a cycle keeps its tables on one level, where none of them waits for another
        level = self.outcomes[table].level
        if any((o := self.outcomes.get(p)) and o.level < level and o.status != COMPLETED for p in self.parents[table]):
            return self._note(table, status=BLOCKED, message="a table that it refers to was not written")
        began = time.monotonic()
        try:
            counts, compare_ms = self._compared[table].result()
            _, write_ms = self._tagged(table, self._write)
            self._note(table, status=COMPLETED, counts=counts, duration_ms=compare_ms + write_ms)
        except Exception as e:  # noqa: BLE001 - a table's failure is part of the report
            self._note(table, status=CANCELLED if self._stop.is_set() else FAILED, message=f"{type(e).__name__}: {e}"[:1000], duration_ms=max(1, round((time.monotonic() - began) * 1000)))

    def _tagged(self, table: str, work):
        """What ``work`` gives for the table, its jobs under the table's tag, and the milliseconds it took."""
        if self._stop.is_set():
            raise RuntimeError("the run was cancelled")
        began = time.monotonic()
        self.spark.sparkContext.addJobTag(self.tag(table))
        self._running.append(table)
        try:
            return work(table), max(1, round((time.monotonic() - began) * 1000))
        finally:
            self._running.remove(table)
            self.spark.sparkContext.removeJobTag(self.tag(table))

    def _compare(self, table: str):
        return self._tagged(table, self._decide)

    def _decide(self, table: str) -> dict[str, int]:
        """Write the table's decided rows and count them."""
        measured = Observation()
        counted = [F.count_if(F.col("outcome") == x).alias(x) for x in (INSERT, UPDATE, DELETE, SKIPPED, ERROR)]
        decided_rows(self.outcomes[table].run, self.cfg).observe(measured, *counted).write.parquet(f"{self.path(table)}/rows")
        return measured.get

    def _write(self, table: str) -> None:
        """Apply the decided rows that nothing speaks against."""
        run, path = self.outcomes[table].run, self.path(table)
        rows = self.spark.read.schema(decided_rows(run, self.cfg).schema).parquet(f"{path}/rows")
        chosen = rows.filter(F.col("outcome").isin(INSERT, UPDATE, DELETE)).drop("outcome", "reasons")
        apply_plan(run.target, chosen, run.keys).write.parquet(f"{path}/result")

    def result(self, table: str) -> DataFrame:
        """The written target table."""
        if self.outcomes[table].status != COMPLETED:
            raise ValueError(f"{table} was not written: {self.outcomes[table].status}")
        return self.spark.read.schema(self.outcomes[table].run.target.schema).parquet(f"{self.path(table)}/result")

    def rejected(self) -> DataFrame:
        """Rows that were not written, with their reasons; ``row`` is JSON."""
        out = self.spark.createDataFrame([], REJECTS)
        for t, o in self.outcomes.items():
            if o.status == COMPLETED:
                rows = self.spark.read.parquet(f"{self.path(t)}/rows").filter(F.col("outcome").isin(SKIPPED, ERROR))
                out = out.unionByName(rows.select(F.lit(t).alias("target_table"), "action", "outcome", "reasons", F.to_json("row").alias("row")))
        return out

    def summary(self) -> DataFrame:
        """A row a table: counts as measured, time taken, status."""
        rows = [
            (o.run.source_table, t, o.level, o.of(INSERT), o.of(UPDATE), o.of(DELETE), o.of(SKIPPED), o.of(ERROR), o.duration_ms, o.status, o.message)
            for t, o in self.outcomes.items()
        ]
        return self.spark.createDataFrame(rows, SUMMARY)

    def progress(self) -> DataFrame:
        """A row a table, also while the run goes on."""
        rows = []
        for t, o in self.outcomes.items():
            done, total = o.of(INSERT, UPDATE, DELETE), o.of(INSERT, UPDATE, DELETE, SKIPPED, ERROR)
            percent = (100.0 if not total else round(done * 100.0 / total, 1)) if o.status == COMPLETED else 0.0
            rows.append((self.id, t, done, total, o.of(INSERT), o.of(UPDATE), o.of(DELETE), o.of(SKIPPED), o.of(ERROR), o.status, percent))
        return self.spark.createDataFrame(rows, PROGRESS)


def run_tables(spark: SparkSession, runs: Sequence[TableRun], foreign_keys: Sequence[tuple[str, str]] = (), cfg: MigrationConfig = MigrationConfig(), **more) -> TablesRun:
    """Run all tables, parents before children (``foreign_keys`` pairs child and parent target tables)."""
    return TablesRun(spark, runs, foreign_keys, cfg, **more).start()
