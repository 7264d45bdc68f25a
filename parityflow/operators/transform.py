"""Column rules applied in order: rename, cast, map, compute, default, filter, drop."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from decimal import Context, Decimal
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parityflow.functions.equality import cell_text, is_number, is_text, parse_number
from parityflow.functions.keys import q

# Texts read as booleans, compared without regard to case.
TRUE_TEXTS = ("true", "1", "yes")
FALSE_TEXTS = ("false", "0", "no")
WHOLE = r"^[+-]?[0-9]{1,38}$"


@dataclass(frozen=True)
class Rename:
    """Rename a column; an existing column of the new name gives way."""

    source: str
    target: str

    def apply(self, df: DataFrame) -> DataFrame:
        if self.source not in df.columns or self.source == self.target:
            return df
        kept = [c for c in df.columns if c != self.target]
        return df.select(*[q(c).alias(self.target) if c == self.source else q(c) for c in kept])


@dataclass(frozen=True)
class Cast:
    """Cast to ``string``, ``number``, ``integer`` or ``boolean``; other names change nothing.

    ``number`` is a double; ``integer`` is a decimal(38, 0), which keeps every
    digit of a whole number written out in text.

    A Spark column has one type, so a cell that cannot be cast becomes NULL
    (``on_error="null"``), or the column stays text and shows the cast result
    where there is one and the old text elsewhere (``on_error="keep"``).
    """

    column: str
    to: str
    on_error: str = "null"

    def _converted(self, c: Column, dtype: T.DataType) -> Column | None:
        to = self.to.lower()
        if to == "string":
            return F.coalesce(cell_text(c, dtype), F.lit("null"))
        if to == "number":
            if is_text(dtype):
                return parse_number(c)
            return c.cast("int") if isinstance(dtype, T.BooleanType) else None
        if to == "integer" and (is_text(dtype) or isinstance(dtype, T.BooleanType)):
            return F.when(c.rlike(WHOLE), c.try_cast("decimal(38,0)")) if is_text(dtype) else c.cast("int").cast("decimal(38,0)")
        if to == "boolean":
            if is_number(dtype):
                return c != 0
            if is_text(dtype):
                return F.when(F.lower(c).isin(*TRUE_TEXTS), True).when(F.lower(c).isin(*FALSE_TEXTS), False)
        return None

    def apply(self, df: DataFrame) -> DataFrame:
        if self.column not in df.columns:
            return df
        c, dtype = q(self.column), df.schema[self.column].dataType
        new = self._converted(c, dtype)
        if new is None:
            return df
        if self.on_error == "keep" and is_text(dtype) and self.to.lower() != "string":
            # whole numbers keep their digits, as in "007" -> "7"
            if self.to.lower() == "number":
                whole = F.when(c.rlike(WHOLE), c.try_cast("decimal(38,0)").cast("string"))
                new = F.coalesce(whole, cell_text(new, T.DoubleType()))
            new = F.coalesce(new.cast("string"), c)
        return df.withColumn(self.column, new)

    def failures(self, df: DataFrame) -> DataFrame:
        """The rows whose cell cannot be cast, with the cell as ``original``."""
        if self.column not in df.columns:
            return df.limit(0).withColumn("original", F.lit(None).cast("string"))
        c, dtype = q(self.column), df.schema[self.column].dataType
        new = self._converted(c, dtype)
        bad = F.lit(False) if new is None else (new.isNull() & c.isNotNull())
        return df.filter(bad).withColumn("original", cell_text(c, dtype))


def _holds(dtype: T.DataType, value: Any) -> bool:
    """Whether a cell of this type can equal the value; whole numbers and decimals hold it digit by digit or not at all."""
    bits = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}.get(type(dtype))
    if value is None or (bits is None and not isinstance(dtype, T.DecimalType)):
        return True
    if isinstance(value, float) and not math.isfinite(value):
        return False
    if bits:
        return value == int(value) and -(1 << (bits - 1)) <= value < 1 << (bits - 1)
    exact = Decimal(str(value)).scaleb(dtype.scale, Context(prec=100))
    return exact == exact.to_integral_value() and abs(exact) < 10**dtype.precision


@dataclass(frozen=True)
class MapValues:
    """Replace cells equal to a mapped value; the first entry for a value counts.

    Types are strict: a text entry never matches a number cell.
    """

    column: str
    mappings: Sequence[tuple[Any, Any]] = field(default_factory=tuple)

    def _usable(self, dtype: T.DataType) -> dict[Any, Any]:
        python = bool if isinstance(dtype, T.BooleanType) else str if is_text(dtype) else (int, float)
        out: dict[Any, Any] = {}
        for old, new in self.mappings:
            fits = old is None or (isinstance(old, python) and (python is bool or not isinstance(old, bool)))
            if fits and _holds(dtype, old) and old not in out:
                out[old] = new
        return out

    def apply(self, df: DataFrame) -> DataFrame:
        if self.column not in df.columns:
            return df
        c, dtype = q(self.column), df.schema[self.column].dataType
        usable = self._usable(dtype)
        if not usable:
            return df
        python = bool if isinstance(dtype, T.BooleanType) else str if is_text(dtype) else (int, float)
        # a target of another type turns the whole column into text
        same = all(v is None or (isinstance(v, python) and (python is bool or not isinstance(v, bool))) for v in usable.values())
        out_type = dtype if same else T.StringType()
        rest = c if same else cell_text(c, dtype)

        def shown(v: Any) -> Column:
            if v is not None and not same:
                v = str(v).lower() if isinstance(v, bool) else str(v)
            return F.lit(v).cast(out_type)

        # the list came with the rule, so its size is that of the rule; broadcast is left to Spark's own check
        entries = [F.struct(F.lit(old).cast(dtype).alias("__old"), shown(new).alias("__new"), F.lit(True).alias("__hit")) for old, new in usable.items()]
        table = df.sparkSession.range(1).select(F.inline(F.array(*entries)))
        joined = df.join(table, c.eqNullSafe(F.col("__old")), "left_outer")
        names = df.columns
        return joined.select(
            *[F.when(F.col("__hit"), F.col("__new")).otherwise(rest).alias(n) if n == self.column else q(n) for n in names]
        )


@dataclass(frozen=True)
class Compute:
    """A new column: ``'text'``, ``a || b`` (NULL counts as empty) or another column.

    ``expr=`` takes any Spark SQL expression instead.
    """

    name: str
    expression: str = ""
    expr: str | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        if self.expr is not None:
            return df.withColumn(self.name, F.expr(self.expr))
        types = {f.name: f.dataType for f in df.schema}
        text = self.expression.strip()

        def piece(name: str) -> Column:
            return F.coalesce(cell_text(q(name), types[name]), F.lit("")) if name in types else F.lit("")

        if len(text) >= 2 and text[0] == text[-1] == "'":
            new = F.lit(text[1:-1])
        elif "||" in text:
            left, right = text.split("||", 1)
            new = F.concat(piece(left.strip()), piece(right.strip()))
        else:
            new = q(text) if text in types else F.lit(None).cast("string")
        return df.withColumn(self.name, new)


@dataclass(frozen=True)
class Default:
    """A value for NULL cells; an absent column is added with it."""

    column: str
    value: Any

    def apply(self, df: DataFrame) -> DataFrame:
        if self.column not in df.columns:
            return df.withColumn(self.column, F.lit(self.value))
        dtype = df.schema[self.column].dataType
        c, value = q(self.column), F.lit(self.value)
        numeric = isinstance(self.value, (int, float)) and not isinstance(self.value, bool)
        if is_text(dtype) or is_number(dtype) == numeric:
            return df.withColumn(self.column, F.coalesce(c, value if is_number(dtype) else value.cast(dtype)))
        return df.withColumn(self.column, F.coalesce(cell_text(c, dtype), value.cast("string")))


@dataclass(frozen=True)
class KeepRows:
    """Keep rows by ``c IS NULL``, ``c IS NOT NULL``, ``c = 'v'`` or ``c != 'v'``.

    NULL differs from every value.  Any other text keeps all rows; ``expr=``
    takes any Spark SQL predicate instead.
    """

    expression: str = ""
    expr: str | None = None

    def condition(self, df: DataFrame) -> Column | None:
        if self.expr is not None:
            return F.expr(self.expr)
        types = {f.name: f.dataType for f in df.schema}
        text = self.expression.strip()
        for suffix, wants_null in ((" IS NOT NULL", False), (" IS NULL", True)):
            if text.endswith(suffix):
                name = text[: -len(suffix)].strip()
                null = q(name).isNull() if name in types else F.lit(True)
                return null if wants_null else ~null
        found = re.fullmatch(r"(.*?)(!=|=)\s*'(.*)'", text, re.S)
        if found is None:
            return None
        name, operator, value = found[1].strip(), found[2], found[3]
        if name not in types or not is_text(types[name]):
            return F.lit(operator == "!=")  # absent or not text: equal to no text
        same = q(name).eqNullSafe(F.lit(value))
        return same if operator == "=" else ~same

    def apply(self, df: DataFrame) -> DataFrame:
        condition = self.condition(df)
        return df if condition is None else df.filter(condition)


@dataclass(frozen=True)
class Drop:
    column: str

    def apply(self, df: DataFrame) -> DataFrame:
        return df.select(*[q(c) for c in df.columns if c != self.column])


class Pipeline:
    """Rules folded over a DataFrame; Catalyst collapses them into one projection."""

    def __init__(self, rules: Sequence[Any] = ()) -> None:
        self.rules = list(rules)

    def add(self, rule: Any) -> Pipeline:
        return Pipeline([*self.rules, rule])

    def apply(self, df: DataFrame) -> DataFrame:
        for rule in self.rules:
            df = rule.apply(df)
        return df


@dataclass(frozen=True)
class TableRule:
    """A rule with its table and its place in that table's order."""

    table: str
    order: int
    rule: Any


def pipelines(rules: Sequence[TableRule]) -> dict[str, Pipeline]:
    """One pipeline per table, its rules sorted by ``order``."""
    out: dict[str, Pipeline] = {}
    for item in sorted(rules, key=lambda r: r.order):
        out.setdefault(item.table, Pipeline()).rules.append(item.rule)
    return out


def transform_tables(tables: Mapping[str, DataFrame], rules: Sequence[TableRule]) -> dict[str, DataFrame]:
    by_table = pipelines(rules)
    return {name: by_table[name].apply(df) if name in by_table else df for name, df in tables.items()}
