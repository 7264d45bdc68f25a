"""Text scans over whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parityflow.functions.keys import q
from parityflow.functions.text import identifier_problem, question_complexity, stripped, suspicious_reason, without_control_characters


def scan_text(df: DataFrame, columns: Sequence[str], max_length: int = 10_000) -> DataFrame:
    """Add ``reason``: the first failing check over ``columns`` in the given order, NULL when all pass."""
    # the capitals are made once per text, in a step of their own, not once per pattern
    upper = {f"__upper{i}": F.upper(q(c)) for i, c in enumerate(columns)}
    checks = [suspicious_reason(q(c), max_length, F.col(f"__upper{i}")) for i, c in enumerate(columns)]
    return df.withColumns(upper).withColumn("reason", F.coalesce(*checks)).drop(*upper)


def validate_identifiers(df: DataFrame, name: str) -> DataFrame:
    """Add ``problem``: why the name is no safe identifier, NULL when it is one."""
    return df.withColumn("problem", identifier_problem(q(name)))


def strip_control_characters(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: without_control_characters(q(c)) for c in columns})


def tag_complexity(df: DataFrame, text: str) -> DataFrame:
    """Add ``complexity``: ``complex`` or ``simple``."""
    staged = df.withColumn("__text", stripped(q(text))).withColumn("__lower", F.lower("__text"))
    return staged.withColumn("complexity", question_complexity(F.col("__text"), F.col("__lower"))).drop("__text", "__lower")
