"""Planned changes into a database: inserts, updates and deletes as batches of bound statements.

A Python data source writes each task's rows over a connection of its own. Rows of one statement
text are bound together; a batch is one transaction. If it fails it is rolled back and its rows are
tried one by one, so that a bad row costs itself only and is counted as an error. A repeated task
changes nothing twice: an insert first looks for its key, updates and deletes name their key.
Tasks report their counts with their commit; an aborted job leaves the batches that were committed
before it, which the next run of the same plan repeats harmlessly.

Connections follow the Python database interface (``cursor``, ``executemany``, ``commit``,
``rollback``, ``close``). Document stores get operations instead: their connection has
``write(collection, operations)``.
"""

from __future__ import annotations

import datetime
import json
import math
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from parityflow.functions.sqltext import ENGINES, quote_name
from parityflow.plans.plan import DELETE, INSERT, UPDATE, plan_keys
from parityflow.session import materialised

DOCUMENT_ENGINES = ("MongoDb", "CosmosDb")
MARKERS = {"SqlServer": "?", "Sqlite": "?", "PostgreSql": "%s", "MySql": "%s", "Oracle": ":{}"}
SAMPLES = 20  #: error texts that a task reports


class Unbindable(ValueError):
    """A row that no statement can name: its key is NaN or infinite."""


def bound(value, engine: str):
    """A cell as a parameter of the engine's driver."""
    if isinstance(value, bool):
        return int(value) if engine in ("SqlServer", "Oracle") else value
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, bytearray):
        return bytes(value)
    if isinstance(value, (Row, dict, list)) and engine not in DOCUMENT_ENGINES:
        plain = value.asDict(recursive=True) if isinstance(value, Row) else value
        return json.dumps(plain, default=str, ensure_ascii=False)
    if isinstance(value, Row):
        return value.asDict(recursive=True)
    if isinstance(value, datetime.date) and not isinstance(value, datetime.datetime) and engine in ("MongoDb", "Sqlite"):
        return value.isoformat()
    return value


@dataclass(frozen=True)
class Statements:
    """The statements of one table."""

    engine: str
    table: str
    keys: Sequence[str]

    def __post_init__(self) -> None:
        if self.engine not in ENGINES:
            raise ValueError(f"unknown engine {self.engine!r}, expected one of {ENGINES}")
        if not self.keys:
            raise ValueError("changes need key columns")

    def _text(self, parts: Sequence[str | None]) -> str:
        """Join parts; None stands for a parameter."""
        out, n = [], 0
        for p in parts:
            if p is None:
                n += 1
                p = MARKERS[self.engine].format(n)
            elif MARKERS[self.engine] == "%s":
                p = p.replace("%", "%%")
            out.append(p)
        return "".join(out)

    def _key(self, row: dict) -> tuple[list, list]:
        """The condition that names a row, and its values. Only a NULL key matches NULL."""
        parts, values = [], []
        for i, k in enumerate(self.keys):
            v = row[k]
            if isinstance(v, float) and not math.isfinite(v):
                raise Unbindable(f"key column {k} is {v}")
            name = (" AND " if i else "") + quote_name(k, self.engine)
            if v is None:
                parts.append(f"{name} IS NULL")
            else:
                parts += [f"{name} = ", None]
                values.append(bound(v, self.engine))
        return parts, values

    def statement(self, action: str, row: dict, changed: Sequence[str] | None) -> tuple[str, tuple] | None:
        """Text and parameters; None where there is nothing to set. ``changed`` None sets every column that is no key."""
        name = quote_name(self.table, self.engine)
        where, key_values = self._key(row)
        if action == DELETE:
            return self._text([f"DELETE FROM {name} WHERE ", *where]), tuple(key_values)
        if action == UPDATE:
            columns = [c for c in sorted(row) if c not in self.keys and (changed is None or c in changed)]
            if not columns:
                return None
            sets = [x for i, c in enumerate(columns) for x in ((", " if i else "") + f"{quote_name(c, self.engine)} = ", None)]
            values = [bound(row[c], self.engine) for c in columns]
            return self._text([f"UPDATE {name} SET ", *sets, " WHERE ", *where]), (*values, *key_values)
        columns = sorted(row)
        listed = ", ".join(quote_name(c, self.engine) for c in columns)
        marks = [x for i in range(len(columns)) for x in ((", ", None) if i else (None,))]
        source = " FROM dual" if self.engine in ("Oracle", "MySql") else ""
        head = [f"INSERT INTO {name} ({listed}) SELECT ", *marks, f"{source} WHERE NOT EXISTS (SELECT 1 FROM {name} WHERE ", *where, ")"]
        return self._text(head), (*(bound(row[c], self.engine) for c in columns), *key_values)

    def operation(self, action: str, row: dict, changed: Sequence[str] | None) -> tuple[str, dict] | None:
        """The change as an operation of a document store."""
        self._finite(row)
        name = {k: bound(row[k], self.engine) for k in self.keys}
        if action == DELETE:
            return "delete", {"filter": name}
        cells = {c: bound(row[c], self.engine) for c in sorted(row)}
        if action == UPDATE:
            cells = {c: v for c, v in cells.items() if c not in self.keys and (changed is None or c in changed)}
            return ("update", {"filter": name, "set": cells}) if cells else None
        return "insert", {"filter": name, "set_on_insert": cells}

    def _finite(self, row: dict) -> None:
        for k in self.keys:
            if isinstance(row[k], float) and not math.isfinite(row[k]):
                raise Unbindable(f"key column {k} is {row[k]}")


@dataclass
class Counts(WriterCommitMessage):
    inserted: int = 0
    updated: int = 0
    deleted: int = 0
    skipped: int = 0
    errors: int = 0
    samples: list[str] = field(default_factory=list)

    def add(self, action: str, n: int) -> None:
        name = {INSERT: "inserted", UPDATE: "updated", DELETE: "deleted"}[action]
        setattr(self, name, getattr(self, name) + n)

    def failed(self, problem: Exception) -> None:
        self.errors += 1
        if len(self.samples) < SAMPLES:
            self.samples.append(f"{type(problem).__name__}: {problem}"[:300])


class _Batches:
    """Statements of a task, sent together by text."""

    def __init__(self, connection, made: Statements, size: int):
        self.connection, self.made, self.size = connection, made, size
        self.counts, self.held, self.n = Counts(), {}, 0

    def add(self, action: str, row: dict, changed: Sequence[str] | None) -> None:
        documents = self.made.engine in DOCUMENT_ENGINES
        try:
            one = (self.made.operation if documents else self.made.statement)(action, row, changed)
        except Unbindable as e:
            return self.counts.failed(e)
        if one is None:
            self.counts.skipped += 1
            return None
        text, values = one
        self.held.setdefault((action, text), []).append(values)
        self.n += 1
        if self.n >= self.size:
            self.flush()
        return None

    def flush(self) -> None:
        for (action, text), rows in self.held.items():
            try:
                self._send(text, rows)
                self.counts.add(action, len(rows))
            except Exception:  # noqa: BLE001 - whatever the driver raises, the rows are tried singly
                for values in rows:
                    try:
                        self._send(text, [values])
                        self.counts.add(action, 1)
                    except Exception as e:  # noqa: BLE001
                        self.counts.failed(e)
        self.held, self.n = {}, 0

    def _send(self, text: str, rows: list) -> None:
        if self.made.engine in DOCUMENT_ENGINES:
            return self.connection.write(self.made.table, [(text, r) for r in rows])
        cursor = self.connection.cursor()
        try:
            cursor.executemany(text, rows)
            self.connection.commit()
        except Exception:
            self.connection.rollback()
            raise
        finally:
            cursor.close()
        return None


class ChangesWriter(DataSourceWriter):
    def __init__(self, connect: Callable, made: Statements, size: int, report: Callable[[list[Counts]], None] | None = None):
        self.connect, self.made, self.size, self.report = connect, made, size, report

    def write(self, iterator: Iterator[Row]) -> Counts:
        connection = self.connect()
        try:
            batches = _Batches(connection, self.made, self.size)
            for r in iterator:
                batches.add(r["action"], r["row"].asDict(), r["changed"])
            batches.flush()
            return batches.counts
        finally:
            connection.close()

    def commit(self, messages: list[Counts | None]) -> None:
        if self.report:
            self.report([m for m in messages if m])

    def abort(self, messages: list[Counts | None]) -> None:
        if self.report:
            self.report([])


def write_changes(
    p: DataFrame, engine: str, table: str, connect: Callable, keys: Sequence[str] | None = None, partial: bool = True,
    batch_size: int = 1000, tasks: int | None = None, report: Callable[[list[Counts]], None] | None = None,
) -> None:
    """Carry out a plan (``action, row, changed_columns``) in a database.

    ``connect`` makes a connection within a task. ``partial`` updates set the changed columns only.
    ``tasks`` bounds the connections open at once. ``report`` gets the tasks' counts when the job
    commits, an empty list when it is aborted; it is called in the process that commits.
    """
    spark, made = p.sparkSession, Statements(engine, table, tuple(keys if keys is not None else plan_keys(p)))
    changed = F.col("changed_columns") if partial else F.lit(None).cast("array<string>")
    rows = p.filter(F.col("action").isin(INSERT, UPDATE, DELETE)).select("action", "row", changed.alias("changed"))
    if tasks:
        rows = rows.coalesce(tasks)
    rows = materialised(rows)
    format_name = f"changes_{uuid.uuid4().hex}"

    class Source(DataSource):
        """Holds the caller's connection maker, which options cannot carry."""

        @classmethod
        def name(cls) -> str:
            return format_name

        def writer(self, schema, overwrite: bool) -> DataSourceWriter:
            return ChangesWriter(connect, made, batch_size, report)

    spark.dataSource.register(Source)
    rows.write.format(format_name).mode("append").save()
