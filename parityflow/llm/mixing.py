"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target in words. Every document of it first gets the whole copies that are
certain (the whole part of target / source size). What the target still lacks is sampled
without replacement: a document with the random odds u / (1 - u) and inclusion odds p / (1 - p)
ranks by the quotient of the two, and documents are taken in that order until the words are
used up. The words left over at the end are offered to the documents behind that fit, twice.
The random number comes from the id, so reruns agree.

Size is the number of ``[^\\x20\\x09-\\x0D]+`` in the text, 0 for null. Sources in code point
order, null last, weigh 5, 2, 1, repeating. Rows that agree in id, source and text are one unit
and are taken alike; ties in rank go to the smaller id (null first), then the smaller size.
Sources without words have target 0 and documents without words are taken 0 times. An empty
table gives an empty table; extra columns pass through unless they bear an output's name.

Only DataFrame functions are used. A source may hold most of the rows: words are summed up
within (source, slice of the rank) and lifted by the sums of the slices before, with as many
slices as the square root of the rows. One row per source meets in one task to share the targets.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parityflow.session import materialised

WEIGHTS = (5, 2, 1)
SHARE = 1.5  #: of all words, that the mix takes
CAP = 2.0  #: times its size that a source or document is taken at most
TOP_UPS = 2  #: times that left-over words are offered again


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _key(doc_id: Column, source: Column, text: Column) -> dict[str, Column]:
    cells = [doc_id, doc_id.isNull(), source, source.isNull(), text, text.isNull()]
    return {"__k1": F.xxhash64(F.lit(1), *cells), "__k2": F.xxhash64(F.lit(2), *reversed(cells))}


def source_targets(units: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``source, source_size, target``: weighted shares, held at ``cap`` times the source, the excess shared again.

    Sources reach the cap in the order of cap / weight; the level at which the others stand is
    what is left of the words over what is left of the weights.
    """
    sums = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n_rows")).alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    w = sums.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    everything = Window.orderBy(F.col("most") / F.col("weight"), F.asc_nulls_last("source"))
    before, whole = everything.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    # the level of the first source that stays below its cap holds for all that follow
    leveled = w.withColumns({"level": level, "turn": F.row_number().over(everything)})
    below = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct("turn", "level"))
    final = leveled.withColumn("final", F.min(below).over(whole)["level"])
    return final.select("source", "source_size", F.least(F.col("most"), F.coalesce(F.col("final") * F.col("weight"), F.col("most"))).alias("target"))


def _take(ranked: DataFrame, slices: int) -> DataFrame:
    """Of ``source, rank, doc_id, size, words, gap`` the rows that fit into ``gap`` in the order of rank."""
    sliced = ranked.withColumn("slice", F.floor(F.col("rank") / (F.col("rank") + 1) * slices))
    sums = sliced.groupBy("source", "slice").agg(F.sum("words").alias("in_slice"))
    order = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("s2"), F.col("slice").alias("l2"), F.coalesce(F.sum("in_slice").over(order), F.lit(0)).alias("before"))
    joined = sliced.join(offsets, F.col("source").eqNullSafe(F.col("s2")) & (F.col("slice") == F.col("l2")))
    inside = Window.partitionBy("source", "slice").orderBy("rank", "doc_id", "size", "__k1", "__k2").rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn("upto", F.col("before") + F.sum("words").over(inside)).filter(F.col("upto") <= F.col("gap")).select("__k1", "__k2")


def decide(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = "",
) -> DataFrame:
    """One row per unit: ``__k1, __k2, doc_id, source, size, n_rows, source_size, target, copies``."""
    if not 0 <= share <= cap:
        raise ValueError("the mix cannot take more than cap times the words")
    i, s, t = F.col(f"`{doc_id}`"), F.col(f"`{source}`"), F.col(f"`{text}`")
    rows = docs.select(i.alias("doc_id"), s.alias("source"), word_count(t).alias("size"), *[c.alias(k) for k, c in _key(i, s, t).items()])
    units = materialised(rows.groupBy("__k1", "__k2", "doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n_rows")))
    total = units.count()
    slices = max(64, math.isqrt(total))
    targets = materialised(source_targets(units, weights, share, cap)).withColumnRenamed("source", "s1")
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    state = units.join(targets, F.col("source").eqNullSafe(F.col("s1"))).drop("s1")
    state = state.withColumns({"words": F.col("size") * F.col("n_rows"), "rate": rate}).withColumns({"copies": F.when(F.col("size") > 0, F.floor("rate")).otherwise(0), "p": F.col("rate") - F.floor("rate")})
    state = materialised(state.withColumn("rank", F.when(F.col("p") > 0, u / (1 - u) * ((1 - F.col("p")) / F.col("p")))))
    for n in range(1 + TOP_UPS):
        used = state.groupBy(F.col("source").alias("s1")).agg(F.sum(F.col("copies") * F.col("words")).alias("used"))
        open_ = state.filter(F.col("rank").isNotNull() & (F.col("words") > 0)).join(used, F.col("source").eqNullSafe(F.col("s1")))
        fits = open_.withColumn("gap", F.col("target") - F.col("used")).filter(F.col("words") <= F.col("gap") if n else F.lit(True))
        taken = _take(fits, slices).withColumn("taken", F.lit(1))
        state = state.join(taken, ["__k1", "__k2"], "left")
        chosen = F.col("taken").isNotNull()
        state = materialised(
            state.withColumns({"copies": F.col("copies") + F.when(chosen, 1).otherwise(0), "rank": F.when(~chosen, F.col("rank"))}).drop("taken")
        )
    return state.select("__k1", "__k2", "doc_id", "source", "size", "n_rows", "source_size", "target", "copies")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **settings) -> DataFrame:
    """``docs`` as the mix takes them: rows repeated by their copies, rows with none gone."""
    keys = _key(F.col(f"`{doc_id}`"), F.col(f"`{source}`"), F.col(f"`{text}`"))
    copies = decide(docs, doc_id, text, source, **settings).filter(F.col("copies") > 0).select("__k1", "__k2", F.col("copies").alias("__copies"))
    joined = docs.withColumns(keys).join(copies, ["__k1", "__k2"])
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])
