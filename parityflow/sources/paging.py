"""Pages far into a table, found by counting ranges instead of sorting everything."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parityflow.functions.keys import q

SAMPLE_PER_RANGE = 32


def range_bounds(df: DataFrame, order_by: Sequence[str], n_rows: int, ranges: int) -> list[tuple]:
    """Ascending order keys that cut ``df`` into about even ranges, from a sample of bounded expected size."""
    sample = df.select(*[q(c) for c in order_by])
    share = ranges * SAMPLE_PER_RANGE / max(1, n_rows)
    if share < 1:
        sample = sample.sample(share, 11)
    keys = [tuple(r) for r in sample.orderBy(*[q(c) for c in order_by]).collect()]
    return list(dict.fromkeys(keys[i * len(keys) // ranges] for i in range(1, ranges))) if keys else []


def _reaches(df: DataFrame, order_by: Sequence[str], bound: tuple) -> Column:
    """Whether a row's key is at or above ``bound``; NULL is the smallest value, NaN the largest."""
    cells = [F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(order_by, bound)]
    return F.struct(*[q(c) for c in order_by]) >= F.struct(*cells)


def deep_page(
    df: DataFrame, order_by: Sequence[str], limit: int = 100, offset: int = 0, descending: bool = False, ranges: int = 64, most: int = 100_000
) -> DataFrame:
    """The page that ``page`` gives, at any offset: rows ``offset`` to ``offset + limit`` of the order.

    The table is cut into ranges of the order key, the ranges are counted, and only those that hold
    the page go on, until they hold ``most`` rows or cannot be cut further; these are sorted. Each
    round reads the order columns alone, and its bounds on the first of them reach the scan, unless that holds floating-point numbers. No
    task sorts more than ``most`` rows and the page, unless more rows than that share one key.
    As with ``page``, end the order with a unique column: rows of one key have no order.
    An empty table, or an offset at or beyond its end, gives no rows.
    """
    if limit < 0 or offset < 0 or ranges < 2:
        raise ValueError("limit and offset are at least 0, ranges at least 2")
    rows, skip, left = df, offset, df.count()
    while left > max(most, 4 * limit):
        bounds = range_bounds(rows, order_by, left, ranges)
        if not bounds:
            break
        above = [_reaches(df, order_by, b).cast("int") for b in bounds]
        found = reduce(lambda a, b: a + b, above)
        counted = rows.groupBy(found.alias("__range")).agg(F.count(F.lit(1)).alias("n")).collect()
        before, held = 0, []
        for number, n in sorted(((r[0], r.n) for r in counted), reverse=descending):
            if before < skip + limit and before + n > skip:
                held.append((number, n, before))
            before += n
        if not held:  # the page lies behind the last row
            return df.limit(0)
        kept = sum(n for _, n, _ in held)
        if kept == left:
            break
        low, high = min(x for x, _, _ in held), max(x for x, _, _ in held)
        first = q(order_by[0])
        # statistics of files and caches pass over NaN, so a bound on such a column would lose it
        pushed = not isinstance(df.schema[order_by[0]].dataType, (T.FloatType, T.DoubleType))
        if low:
            rows = rows.filter(_reaches(df, order_by, bounds[low - 1]))
            if pushed and bounds[low - 1][0] is not None:
                rows = rows.filter(first >= F.lit(bounds[low - 1][0]))
        if high < len(bounds):
            rows = rows.filter(~_reaches(df, order_by, bounds[high]))
            if pushed and bounds[high][0] is not None:
                rows = rows.filter(first.isNull() | (first <= F.lit(bounds[high][0])))
        skip, left = skip - held[0][2], kept
    order = [q(c).desc() if descending else q(c).asc() for c in order_by]
    return rows.orderBy(*order).offset(skip).limit(limit)
