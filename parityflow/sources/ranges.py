"""Even ranges of a database table, as predicates for a parallel JDBC read."""

from __future__ import annotations

import datetime
import decimal
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from parityflow.functions.sqltext import quote_name


def quoted_table(table: str, engine: str) -> str:
    """``schema.table`` with every part quoted."""
    return ".".join(quote_name(part, engine) for part in table.split("."))


def bounds_query(table: str, columns: Sequence[str], engine: str, parts: int) -> str:
    """A query for the first key of each of ``parts`` even ranges of the rows without NULL in ``columns``."""
    names = [quote_name(c, engine) for c in columns]
    listed, filled = ", ".join(names), " AND ".join(f"{n} IS NOT NULL" for n in names)
    tiles = f"SELECT {listed}, NTILE({parts}) OVER (ORDER BY {listed}) AS part FROM {quoted_table(table, engine)} WHERE {filled}"
    ranked = f"SELECT {listed}, part, ROW_NUMBER() OVER (PARTITION BY part ORDER BY {listed}) AS place FROM ({tiles}) tiles"
    return f"SELECT {listed} FROM ({ranked}) ranked WHERE place = 1 ORDER BY {listed}"


def sql_value(value, engine: str) -> str:
    """A bound as a literal; numbers that are not finite have none."""
    if isinstance(value, bool):
        raise ValueError("a boolean column cannot be cut into ranges")
    if isinstance(value, (int, decimal.Decimal)):
        return str(value)
    if isinstance(value, float):
        if value != value or value in (float("inf"), float("-inf")):
            raise ValueError("a range cannot start at a number that is not finite")
        return repr(value)
    text = value.isoformat(" ") if isinstance(value, datetime.datetime) else str(value)
    if engine == "MySql":
        text = text.replace("\\", "\\\\")
    quoted = "'" + text.replace("'", "''") + "'"
    if engine == "Oracle" and isinstance(value, datetime.date):
        return ("TIMESTAMP " if isinstance(value, datetime.datetime) else "DATE ") + quoted
    return quoted


def _at_least(names: Sequence[str], bound: Sequence[str]) -> str:
    """Keys at or above ``bound``, column by column."""
    cases = []
    for i, (name, value) in enumerate(zip(names, bound)):
        equal = [f"{n} = {v}" for n, v in zip(names[:i], bound[:i])]
        cases.append(" AND ".join([*equal, f"{name} {'>=' if i == len(names) - 1 else '>'} {value}"]))
    return " OR ".join(f"({c})" for c in cases)


def range_predicates(columns: Sequence[str], bounds: Sequence[Sequence], engine: str) -> list[str]:
    """One predicate per range; together they hold every row once, rows with NULL in a range of their own.

    ``bounds`` are the first keys of the ranges in order; the first range has no lower end and the
    last no upper one. Equal bounds, from a key that fills several ranges, make one range: name a
    second column to cut such a key.
    """
    names = [quote_name(c, engine) for c in columns]
    cuts = list(dict.fromkeys(tuple(sql_value(v, engine) for v in b) for b in bounds))[1:]
    filled, empty = " AND ".join(f"{n} IS NOT NULL" for n in names), " OR ".join(f"{n} IS NULL" for n in names)
    out = [f"({empty})"]
    for low, high in zip([None, *cuts], [*cuts, None]):
        ends = [f"({_at_least(names, low)})"] if low else []
        ends += [f"NOT ({_at_least(names, high)})"] if high else []
        # the range of the first column alone, which an index can serve
        ends += [f"{names[0]} >= {low[0]}"] if low else []
        ends += [f"{names[0]} <= {high[0]}"] if high else []
        out.append(" AND ".join([filled, *ends]))
    return out


def read_ranges(
    spark: SparkSession, table: str, jdbc: Mapping[str, str], columns: Sequence[str], engine: str, parts: int = 32, fetch_size: int = 10_000
) -> DataFrame:
    """A table read in ``parts`` ranges that hold about equally many rows, whatever the keys' distribution."""
    source = {**jdbc, "fetchsize": str(fetch_size)}
    probe = spark.read.format("jdbc").options(**source).option("dbtable", f"({bounds_query(table, columns, engine, parts).rpartition(' ORDER BY ')[0]}) b").load()
    bounds = [tuple(r) for r in probe.orderBy(*[f"`{c}`" for c in columns]).collect()]  # ``parts`` rows at most
    url = source.pop("url")
    return spark.read.jdbc(url, quoted_table(table, engine), predicates=range_predicates(columns, bounds, engine), properties=source)
