"""Row fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parityflow.config import CompareConfig
from parityflow.functions.equality import cell_text, contains_type, is_number, normalized
from parityflow.functions.keys import q


def row_hash(df: DataFrame, columns: Sequence[str], cfg: CompareConfig) -> Column:
    """SHA-256 over the normalised cells of ``columns`` in name order.

    Every part carries a null flag and its length, so no two different rows
    feed the hash the same bytes.
    """
    parts = []
    for name in sorted(columns):
        dtype = df.schema[name].dataType
        value = normalized(q(name), dtype, cfg)
        # both sides have one type here, so Spark's own number text will do
        if contains_type(dtype, T.MapType, T.VariantType):
            value = value.cast("string")
        else:
            value = value.cast("string") if is_number(dtype) else cell_text(value, dtype)
        parts.append(F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat_ws(",", *parts) if parts else F.lit(""), 256)


def row_fingerprint(df: DataFrame, columns: Sequence[str], cfg: CompareConfig) -> Column:
    """128 bits over the same cells, for comparing two rows of one key.

    Much cheaper than SHA-256 as no cell is turned into text; null flags are
    hashed too, as a NULL alone leaves a hash unchanged.
    """
    cells = []
    for name in sorted(columns):
        value = normalized(q(name), df.schema[name].dataType, cfg)
        cells += [value, value.isNull()]
    return F.struct(F.xxhash64(F.lit(1), *cells).alias("a"), F.xxhash64(F.lit(2), *reversed(cells)).alias("b"))
