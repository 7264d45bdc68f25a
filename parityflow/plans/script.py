"""A plan as a script of SQL statements, one row per statement."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parityflow.functions.sqltext import literal, quote_name
from parityflow.plans.plan import DELETE, INSERT, UPDATE, plan_keys


def render_dml(
    p: DataFrame, engine: str, table: str, keys: Sequence[str] | None = None, partial: bool = False
) -> DataFrame:
    """The plan with a ``statement`` column.

    With ``partial`` an update sets only the changed columns that are not keys;
    a row without any yields no statement.  Nor does an update or delete whose key
    has no literal; ``unscripted`` gives those rows.  The text is built by column
    expressions on the executors; write it with ``.write.text``.
    """
    keys = list(keys) if keys is not None else plan_keys(p)
    fields = {f.name: f.dataType for f in p.schema["row"].dataType}
    names = sorted(fields)
    where_table = quote_name(table, engine)

    def value(name: str) -> Column:
        return literal(F.col("row").getField(name), fields[name], engine) if name in fields else F.lit("NULL")

    def assign(name: str) -> Column:
        return F.concat(F.lit(f"{quote_name(name, engine)} = "), value(name))

    column_list = ", ".join(quote_name(n, engine) for n in names)
    insert = F.concat(
        F.lit(f"INSERT INTO {where_table} ({column_list}) VALUES ("), F.concat_ws(", ", *[value(n) for n in names]), F.lit(");")
    )
    settable = [n for n in names if n not in keys]
    parts = [F.when(F.array_contains("changed_columns", n), assign(n)) if partial else assign(n) for n in settable]
    sets = F.concat_ws(", ", *parts) if parts else F.lit("")
    # only a key that is NULL matches NULL; one without a literal (NaN, infinite) gives no statement
    cells = {k: F.col("row").getField(k) if k in fields else F.lit(None) for k in keys}
    named = reduce(lambda a, b: a & b, [cells[k].isNull() | (value(k) != "NULL") for k in keys], F.lit(True))
    where = F.concat_ws(" AND ", *[F.when(cells[k].isNull(), F.lit(f"{quote_name(k, engine)} IS NULL")).otherwise(assign(k)) for k in keys])
    update = F.concat(F.lit(f"UPDATE {where_table} SET "), sets, F.lit(" WHERE "), where, F.lit(";"))
    if partial:
        update = F.when(sets != "", update)
    delete = F.concat(F.lit(f"DELETE FROM {where_table} WHERE "), where, F.lit(";"))
    action = F.col("action")
    statement = F.when(action == INSERT, insert).when(named & (action == UPDATE), update).when(named & (action == DELETE), delete)
    return p.withColumn("statement", statement).filter(F.col("statement").isNotNull())


def unscripted(p: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Planned updates and deletes with a NaN or infinite key, which no statement can name."""
    keys = list(keys) if keys is not None else plan_keys(p)
    fields = {f.name: f.dataType for f in p.schema["row"].dataType}
    cells = [F.col("row").getField(k) for k in keys if isinstance(fields.get(k), (T.FloatType, T.DoubleType))]
    odd = reduce(lambda a, b: a | b, [F.isnan(c) | (F.abs(c) == float("inf")) for c in cells], F.lit(False))
    return p.filter(F.col("action").isin(UPDATE, DELETE) & odd)
