"""Changed rows by checksums of key buckets: rows travel only where buckets differ.

Both sides add up row hashes per bucket of keys first, in the map tasks, so what is shuffled is a
row a bucket and task. The sums do not depend on the order of rows. Equal sums of all rows of a
bucket mean equal rows; the rows of the other buckets go through the ordinary diff.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parityflow.config import CompareConfig
from parityflow.functions.hashing import row_fingerprint
from parityflow.functions.keys import join_key_columns, q, resolve_keys
from parityflow.operators.align import align
from parityflow.operators.compare import MATCHED, diff
from parityflow.session import materialised

BUCKETS = 1 << 16  #: bounds the list of differing buckets, which is sent to every task
BUCKET = "__bucket"


def with_bucket(df: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    """``df`` with the bucket of its keys; NULL keys have one, too."""
    keyed, names = join_key_columns(df, keys)
    return keyed.withColumn(BUCKET, F.pmod(F.xxhash64(*[q(n) for n in names]), F.lit(buckets)).cast("int")).select(*[q(c) for c in df.columns], BUCKET)


def bucket_sums(df: DataFrame, keys: Sequence[str], cfg: CompareConfig, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n`` and four sums, the halves of two hashes of each row.

    Halves of 32 bits do not overflow a long below 2^31 rows a bucket. Where rows may share a key,
    all columns count, as any of them may decide which row stands for the key.
    """
    columns = [c for c in df.columns if not cfg.keys_unique or c in keys or c not in cfg.ignore_columns]
    hashed = with_bucket(df, keys, buckets).select(BUCKET, row_fingerprint(df, columns, cfg).alias("h"))

    def halves(h: Column) -> list[Column]:
        return [F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF))]

    parts = [*halves(F.col("h.a")), *halves(F.col("h.b"))]
    return hashed.groupBy(F.col(BUCKET).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(p).alias(f"s{i}") for i, p in enumerate(parts)])


def differing_buckets(source: DataFrame, target: DataFrame, cfg: CompareConfig, buckets: int = BUCKETS) -> DataFrame:
    """``bucket`` of those whose rows are not the same on both sides; at most ``buckets`` rows."""
    s, t = align(source, target)
    keys = resolve_keys(s.columns, cfg.keys)
    both = bucket_sums(s, keys, cfg, buckets).withColumn("side", F.lit(1)).unionByName(bucket_sums(t, keys, cfg, buckets).withColumn("side", F.lit(-1)))
    names = ["n", "s0", "s1", "s2", "s3"]
    sums = both.groupBy("bucket").agg(*[F.sum(F.col(c) * F.col("side")).alias(c) for c in names])
    return sums.filter(" OR ".join(f"{c} <> 0" for c in names)).select("bucket")


def changed_rows(source: DataFrame, target: DataFrame, cfg: CompareConfig = CompareConfig(), buckets: int = BUCKETS) -> DataFrame:
    """The rows of ``diff`` that are not matched, comparing only the buckets that differ.

    Reads both tables twice and shuffles rows of few buckets once: for tables that are nearly the
    same. Rows equal under a tolerance have differing sums, are compared, and count as matched.
    """
    if buckets < 1:
        raise ValueError("at least one bucket is needed")
    s, t = align(source, target)
    keys = resolve_keys(s.columns, cfg.keys)
    differing = F.broadcast(materialised(differing_buckets(s, t, cfg, buckets)).withColumnRenamed("bucket", BUCKET))

    def some(df: DataFrame) -> DataFrame:
        return with_bucket(df, keys, buckets).join(differing, BUCKET, "left_semi").drop(BUCKET)

    return diff(some(s), some(t), replace(cfg, keys=keys, use_hash_mode=False)).filter(F.col("status") != MATCHED)
