"""One row per key, and reports on the rows that lost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parityflow.functions.equality import comparable
from parityflow.functions.keys import join_key_columns, q


TIE = "__tie"


def tie_break(df: DataFrame, keys: Sequence[str]) -> Column:
    """A repeatable last resort where ``order_by`` leaves rows of a key tied."""
    rest = sorted(c for c in df.columns if c not in set(keys))
    cells = [comparable(q(c), df.schema[c].dataType) for c in rest]
    return F.xxhash64(*cells) if cells else F.lit(0)


def keep_last(df: DataFrame, key_names: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The top row per key.

    ``row_number() = 1`` is cut to one row per key in every map task before the
    shuffle, so a key that owns a third of the table costs one row per task.
    """
    w = Window.partitionBy(*[q(k) for k in key_names]).orderBy(*[q(c).desc() for c in order_by])
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def dedupe_last(df: DataFrame, keys: Sequence[str], order_by: Sequence[str] = ()) -> DataFrame:
    """Last row wins per key; ``order_by`` says what "last" is."""
    ranked = df.withColumn(TIE, tie_break(df, keys))
    return keep_last(ranked, keys, [*order_by, TIE]).drop(TIE)


def keep_last_counted(df: DataFrame, key_names: Sequence[str], order_by: Sequence[str], n_lost: str) -> DataFrame:
    """``keep_last`` and how many rows of its key each row won against, as column ``n_lost``.

    One aggregate: every map task keeps the best row of a key and a count, so one exchange
    carries a row per key and task, also where one key owns most of the table.
    """
    cells = [c for c in df.columns if c not in set(key_names)]
    best = F.max_by(F.struct(*[q(c) for c in cells]), F.struct(*[q(c) for c in order_by])).alias("__best")
    out = df.groupBy(*[q(k) for k in key_names]).agg(best, (F.count(F.lit(1)) - 1).alias(n_lost))
    return out.select(*[F.col("__best").getField(c).alias(c) for c in cells], *[q(k) for k in key_names], q(n_lost))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once and how often (map-side combined)."""
    return df.groupBy(*[q(k) for k in keys]).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def duplicate_rows(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The rows ``dedupe_last`` drops, as error rows.

    ``order_by`` must order the rows of a key without ties.  Rows are compared
    with their key's winner in a join, so a hot key is split by AQE instead of
    being ranked in one task.
    """
    ranked, names = join_key_columns(df, keys)
    ranked = ranked.withColumn("__rank", F.struct(*[q(c) for c in order_by]))
    best = (
        ranked.groupBy(*names)
        .agg(F.max("__rank").alias("__best"), F.count(F.lit(1)).alias("__n"))
        .filter("__n > 1")
    )
    joined = ranked.join(best, names, "inner").filter(F.col("__rank") < F.col("__best"))
    return joined.select(*[q(c) for c in df.columns], F.lit("error").alias("status"), F.lit("duplicate key").alias("error"))
