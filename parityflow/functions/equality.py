"""When do two cells count as equal?"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parityflow.config import CompareConfig

# Fixed value: what may be read as a number when it arrives as text.
NUMBER_PATTERN = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.StringType)


def is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def parse_number(c: Column) -> Column:
    """Text to double; NULL unless the whole text is a number."""
    return F.when(c.rlike(NUMBER_PATTERN), c.try_cast("double"))


def number_text(c: Column, dtype: T.DataType) -> Column:
    """Numbers as plain text: ``1.5``, ``10000000.0``, never ``1.0E7``."""
    if not isinstance(dtype, (T.FloatType, T.DoubleType)):
        return c.cast("string")
    text = c.cast("string")
    plain = F.rtrim(text.cast("decimal(38,22)").cast("string"), F.lit("0"))
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    # Spark turns to exponents at 1e7 already, and below 1e-3
    size = F.abs(c)
    return (
        F.when(~F.contains(text, F.lit("E")), text)
        .when((size < 1e16) & (size >= 1e-5), plain)
        .otherwise(F.lower(text))
    )


def cell_text(c: Column, dtype: T.DataType) -> Column:
    """Any cell as text; NULL stays NULL."""
    if is_text(dtype):
        return c
    if is_number(dtype):
        return number_text(c, dtype)
    if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(c)
    return c.cast("string")


def contains_type(dtype: T.DataType, *kinds: type) -> bool:
    """Is one of ``kinds`` anywhere inside the type?"""
    if isinstance(dtype, kinds):
        return True
    if isinstance(dtype, T.ArrayType):
        return contains_type(dtype.elementType, *kinds)
    if isinstance(dtype, T.MapType):
        return contains_type(dtype.keyType, *kinds) or contains_type(dtype.valueType, *kinds)
    return isinstance(dtype, T.StructType) and any(contains_type(f.dataType, *kinds) for f in dtype)


def comparable(c: Column, dtype: T.DataType) -> Column:
    """A form with equality and a hash for types that Spark gives none.

    A map becomes its sorted entries; maps inside other types and variants become text.
    """
    if isinstance(dtype, T.MapType) and not contains_type(dtype.valueType, T.MapType, T.VariantType):
        return F.array_sort(F.map_entries(c))
    return F.to_json(c) if contains_type(dtype, T.MapType, T.VariantType) else c


def normalized(c: Column, dtype: T.DataType, cfg: CompareConfig) -> Column:
    """The form of a cell on which equality is plain ``<=>``."""
    if is_text(dtype):
        if cfg.normalize_whitespace:
            c = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
        if cfg.case_insensitive:
            c = F.lower(c)
        return F.coalesce(c, F.lit("")) if cfg.null_equals_empty else c
    return comparable(c, dtype)


def values_equal(a: Column, a_type: T.DataType, b: Column, b_type: T.DataType, cfg: CompareConfig) -> Column:
    """A never-NULL boolean: do the two cells agree under ``cfg``?"""
    if is_text(a_type) != is_text(b_type):
        a, b = cell_text(a, a_type), cell_text(b, b_type)
        text_a, text_b = normalized(a, T.StringType(), cfg), normalized(b, T.StringType(), cfg)
        a_type = b_type = T.StringType()
    else:
        text_a, text_b = normalized(a, a_type, cfg), normalized(b, b_type, cfg)
    same = text_a.eqNullSafe(text_b)
    if cfg.numeric_tolerance is None or not (is_text(a_type) or (is_number(a_type) and is_number(b_type))):
        return same
    x = parse_number(a) if is_text(a_type) else a.cast("double")
    y = parse_number(b) if is_text(b_type) else b.cast("double")
    # equal cells are equal even where their difference is no number
    return F.when(x.isNotNull() & y.isNotNull(), same | (F.abs(x - y) <= F.lit(float(cfg.numeric_tolerance)))).otherwise(same)
