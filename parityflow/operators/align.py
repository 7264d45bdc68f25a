"""Bring two tables to one set of columns and types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parityflow.functions.equality import cell_text
from parityflow.functions.keys import q


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The narrowest type that holds both; text when nothing else does."""
    if a == b:
        return a
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
        if isinstance(a, whole) and isinstance(b, whole):
            return max(a, b, key=lambda t: whole.index(type(t)))
        if isinstance(a, (T.FloatType, T.DoubleType)) or isinstance(b, (T.FloatType, T.DoubleType)):
            return T.DoubleType()

        def digits(t: T.DataType) -> tuple[int, int]:
            return (t.precision - t.scale, t.scale) if isinstance(t, T.DecimalType) else (19, 0)

        lead, scale = max(digits(a)[0], digits(b)[0]), max(digits(a)[1], digits(b)[1])
        # beyond 38 digits no number type holds both
        return T.DecimalType(lead + scale, scale) if lead + scale <= 38 else T.StringType()
    moments = (T.DateType, T.TimestampNTZType, T.TimestampType)
    if isinstance(a, moments) and isinstance(b, moments):
        return max(a, b, key=lambda t: moments.index(type(t)))
    return T.StringType()


def _digits_text(c: Column, dtype: T.DataType) -> Column:
    """A whole number or decimal as text, without zeros at the end of a fraction."""
    text = c.cast("string")
    if not isinstance(dtype, T.DecimalType) or not dtype.scale:
        return text
    # small decimals are shown with an exponent, so the text is built from the unscaled digits
    plain = F.format_number(c, dtype.scale)
    return F.regexp_replace(F.regexp_replace(plain, ",", ""), r"\.?0+$", "")


def align(source: DataFrame, target: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with the union of their columns in name order.

    A column only one side has is NULL on the other.  Decimals that no common
    decimal holds are compared as text.
    """
    src, tgt = source.schema, target.schema
    left, right = [], []
    for name in sorted(set(source.columns) | set(target.columns)):
        if name not in target.columns:
            left.append(q(name))
            right.append(F.lit(None).cast(src[name].dataType).alias(name))
        elif name not in source.columns:
            left.append(F.lit(None).cast(tgt[name].dataType).alias(name))
            right.append(q(name))
        else:
            a, b = src[name].dataType, tgt[name].dataType
            wide = common_type(a, b)

            def as_wide(dtype: T.DataType, wide=wide, name=name, a=a, b=b):
                if dtype == wide:
                    return q(name)
                if isinstance(wide, T.StringType) and isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
                    return _digits_text(q(name), dtype).alias(name)
                if isinstance(wide, T.StringType):
                    return cell_text(q(name), dtype).alias(name)
                return q(name).cast(wide).alias(name)

            left.append(as_wide(a))
            right.append(as_wide(b))
    return source.select(*left), target.select(*right)
