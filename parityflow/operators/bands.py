"""Match by an expression of equal parts, bands and a further condition.

Equal parts and the buckets of the bands become join keys, so the join is an equi-join: a bucket is
four times as wide as its band, and a target row stands in every bucket that its band reaches, one
or two. What shares a bucket is then tested exactly. Skewed keys are split by the adaptive skew join.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parityflow.functions.keys import q
from parityflow.session import materialised

KEYED_BANDS = 2  #: bands that make keys (one or two copies of a target row each); further ones are tested only
BUCKET_BANDS = 4  #: widths of the band that a bucket holds
REACH = 0.26  #: of a bucket, a little more than a band; rounding moves no pair beyond it


@dataclass(frozen=True)
class Band:
    """``abs(source - target) <= width``; with ``relative``, width is a share (below 1) of the source's size.

    The expressions are Spark SQL over the columns of their side. Dates and timestamps are measured
    in days. NULL and NaN are in no band.
    """

    source: str
    target: str
    width: float
    relative: bool = False

    def __post_init__(self) -> None:
        if not (0 < self.width < (1 if self.relative else math.inf)):
            raise ValueError("a band needs a width above 0, and below 1 if it is relative")


def _number(df: DataFrame, expression: str) -> Column:
    kind = df.select(F.expr(expression).alias("x")).schema["x"].dataType.typeName()
    value = F.expr(expression)
    if kind == "date":
        return F.unix_date(value).cast("double")
    if kind in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(value.cast("timestamp")) / F.lit(86_400_000_000.0)
    number = value.cast("double")
    return F.when(~F.isnan(number), number)


def _place(value: Column, band: Band) -> tuple[Column, Column]:
    """A value counted in buckets, and its sign; relative bands have buckets of equal ratio. A zero is near zeros only."""
    if not band.relative:
        return value / F.lit(band.width * BUCKET_BANDS), F.lit(0)
    step = -math.log1p(-band.width) * BUCKET_BANDS
    place = F.when(value == 0, F.lit(0.0)).otherwise(F.log(F.abs(value)) / F.lit(step))
    return place, F.when(value > 0, 1).when(value < 0, -1).otherwise(0)


def _bucket(place: Column) -> Column:
    far = float(1 << 62)  # what lies beyond shares the last bucket
    return F.floor(F.least(F.greatest(place, F.lit(-far)), F.lit(far)))


def band_pairs(
    source: DataFrame, target: DataFrame, equal: Sequence[tuple[str, str]] = (), bands: Sequence[Band] = (), condition: str | None = None
) -> DataFrame:
    """Pairs of rows as structs ``source`` and ``target``.

    ``equal`` pairs expressions over the source and over the target (NULL agrees with NULL);
    ``condition`` is SQL over ``source.x`` and ``target.y``.
    """
    if not equal and not bands:
        raise ValueError("a match needs an equal part or a band; a condition alone would compare all pairs")
    s = source.select(F.struct(*[q(c) for c in source.columns]).alias("source"), *[F.expr(a).alias(f"se{i}") for i, (a, _) in enumerate(equal)],
                      *[_number(source, b.source).alias(f"sb{i}") for i, b in enumerate(bands)])
    t = target.select(F.struct(*[q(c) for c in target.columns]).alias("target"), *[F.expr(b).alias(f"te{i}") for i, (_, b) in enumerate(equal)],
                      *[_number(target, b.target).alias(f"tb{i}") for i, b in enumerate(bands)])
    tests = [F.col(f"se{i}").eqNullSafe(F.col(f"te{i}")) for i in range(len(equal))]
    copies = t
    for i, band in enumerate(bands):
        x, y = F.col(f"sb{i}"), F.col(f"tb{i}")
        tests.append(F.abs(x - y) <= (F.abs(x) * F.lit(band.width) if band.relative else F.lit(band.width)))
        if i < KEYED_BANDS:
            place, sign = _place(x, band)
            s = s.withColumn(f"sk{i}", _bucket(place)).withColumn(f"ss{i}", sign)
            place, sign = _place(y, band)
            reached = F.array_distinct(F.array(_bucket(place - F.lit(REACH)), _bucket(place + F.lit(REACH))))
            copies = copies.withColumn(f"ts{i}", sign).withColumn(f"tk{i}", F.explode(reached))
            tests += [F.col(f"sk{i}") == F.col(f"tk{i}"), F.col(f"ss{i}") == F.col(f"ts{i}")]
    if condition:
        tests.append(F.expr(condition))
    matched = reduce(lambda a, b: a & b, tests)
    return s.join(copies, matched).select("source", "target")


def band_diff(
    source: DataFrame, target: DataFrame, source_key: Sequence[str], target_key: Sequence[str], equal: Sequence[tuple[str, str]] = (),
    bands: Sequence[Band] = (), condition: str | None = None,
) -> DataFrame:
    """``status, source, target``: ``matched`` pairs, ``inserted`` source rows and ``deleted`` target rows without a partner.

    A row may be in several pairs. The keys tell the rows of a side apart; they serve to find the rows without a partner.
    The pairs are written once, as all three read them.
    """
    pairs = materialised(band_pairs(source, target, equal, bands, condition))

    def alone(df: DataFrame, side: str, key: Sequence[str]) -> DataFrame:
        seen = pairs.select(*[F.col(side).getField(k).alias(f"__{i}") for i, k in enumerate(key)]).distinct()
        same = reduce(lambda a, b: a & b, [q(k).eqNullSafe(F.col(f"__{i}")) for i, k in enumerate(key)])
        return df.join(seen, same, "left_anti").select(F.struct(*[q(c) for c in df.columns]).alias(side))

    none_s, none_t = (F.lit(None).cast(pairs.schema[c].dataType) for c in ("source", "target"))
    matched = pairs.select(F.lit("matched").alias("status"), "source", "target")
    inserted = alone(source, "source", source_key).select(F.lit("inserted").alias("status"), "source", none_t.alias("target"))
    deleted = alone(target, "target", target_key).select(F.lit("deleted").alias("status"), none_s.alias("source"), "target")
    return matched.unionByName(inserted).unionByName(deleted)
