"""Key choice and null-safe key columns."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY_PREFIX = "__k"
NULL_MASK = "__knull"
CELLS_PER_ROW = 8  #: of a bitmap over keys; a key that is not in it meets a marked cell with one chance in about as many
BLOCK_CELLS = 1 << 15  #: cells of a bitmap that lie in one row
MOST_BLOCKS = 1 << 13  #: bounds a bitmap to 32 MB


def q(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def resolve_keys(columns: Sequence[str], keys: Sequence[str] = ()) -> list[str]:
    """Given keys, else ``id`` when present, else all columns in name order."""
    if keys:
        missing = [k for k in keys if k not in columns]
        if missing:
            raise ValueError(f"key columns {missing} are not in {sorted(columns)}")
        return list(keys)
    return ["id"] if "id" in columns else sorted(columns)


def _stand_in(dtype: T.DataType):
    """The value a NULL key part is replaced by; the null mask tells them apart."""
    if isinstance(dtype, T.StringType):
        return F.lit("")
    if isinstance(dtype, T.BooleanType):
        return F.lit(False)
    if isinstance(dtype, T.DateType):
        return F.lit(datetime.date(1970, 1, 1))
    if isinstance(dtype, T.NumericType):
        return F.lit(0).cast(dtype)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.lit("1970-01-01 00:00:00").cast(dtype)
    if isinstance(dtype, T.BinaryType):
        return F.lit(b"")
    return None


def join_key_columns(df: DataFrame, keys: Sequence[str], not_null: bool = False) -> tuple[DataFrame, list[str]]:
    """Add non-null helper columns on which NULL keys match each other.

    A plain ``<=>`` join hashes derived expressions, so a window that already
    partitioned by the key could not be reused.  With the helpers as real
    columns the window and the join share one exchange and one sort.
    """
    names, columns, masks = [], [], []
    for i, key in enumerate(keys):
        dtype, name = df.schema[key].dataType, f"{KEY_PREFIX}{i}"
        stand_in = _stand_in(dtype)
        value = q(key) if stand_in is not None else F.to_json(q(key))
        if not not_null:
            masks.append(F.when(q(key).isNull(), F.lit(1 << (i % 31))).otherwise(F.lit(0)))
            value = F.coalesce(value, stand_in if stand_in is not None else F.lit(""))
        names.append(name)
        columns.append(value.alias(name))
    if masks:
        if len(keys) > 31:  # one bit per key part does not fit; keep the flags as text
            flags = F.concat(*[F.when(q(k).isNull(), F.lit("1")).otherwise(F.lit("0")) for k in keys])
        else:
            flags = masks[0]
            for mask in masks[1:]:
                flags = flags.bitwiseOR(mask)
        names.append(NULL_MASK)
        columns.append(flags.alias(NULL_MASK))
    return df.select("*", *columns), names


def _celled(df: DataFrame, keys: Sequence[str], cells: int) -> DataFrame:
    """``df`` with ``__block, __word, __bit``, the place of its keys in a bitmap; matching keys share it."""
    keyed, names = join_key_columns(df, keys)
    # a hash tells texts apart that a collation holds equal, so these do not count
    plain = [n for n in names if not isinstance(t := keyed.schema[n].dataType, T.StringType) or t.isUTF8BinaryCollation()]
    blocks = min(max(1, -(-cells // BLOCK_CELLS)), MOST_BLOCKS)
    cell = F.pmod(F.xxhash64(*[q(n) for n in plain]) if plain else F.lit(0).cast("long"), F.lit(blocks * BLOCK_CELLS))
    places = {"__block": F.shiftright(cell, 15), "__word": F.shiftright(cell, 6).bitwiseAND(F.lit(511)), "__bit": cell.bitwiseAND(F.lit(63))}
    return keyed.select(*[q(c) for c in df.columns], *[c.cast("int").alias(n) for n, c in places.items()])


def marked_cells(df: DataFrame, keys: Sequence[str], cells: int) -> DataFrame:
    """``__block, __words``: a bitmap of about ``cells`` cells in which the keys of ``df`` are marked."""
    words = _celled(df, keys, cells).groupBy("__block", "__word").agg(F.bit_or(F.expr("shiftleft(1L, __bit)")).alias("__bits"))
    blocks = words.groupBy("__block").agg(F.map_from_entries(F.collect_list(F.struct("__word", "__bits"))).alias("__map"))
    every = F.sequence(F.lit(0), F.lit(BLOCK_CELLS // 64 - 1))
    return blocks.select("__block", F.transform(every, lambda i: F.coalesce(F.try_element_at("__map", i), F.lit(0).cast("long"))).alias("__words"))


def key_cells(df: DataFrame, keys: Sequence[str], cells: int, marks: DataFrame) -> DataFrame:
    """``df`` with ``__marked``: whether the cell of its keys is marked in ``marks``, which every task gets."""
    placed = _celled(df, keys, cells).join(F.broadcast(marks), "__block", "left")
    return placed.withColumn("__marked", F.coalesce(F.getbit(F.get("__words", "__word"), F.col("__bit")) == 1, F.lit(False)))
