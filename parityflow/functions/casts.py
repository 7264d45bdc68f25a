"""Casts that give NULL where a value does not fit, for every pair of types."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def castable(a: T.DataType, b: T.DataType) -> bool:
    """Does Spark know a cast of these types?"""
    try:
        SparkSession.active().range(0).select(F.lit(None).cast(a).try_cast(b)).schema
    except AnalysisException:
        return False
    return True


def held(cell: Column, a: T.DataType, b: T.DataType) -> Column:
    """A cell in another type, NULL where that cannot hold it or where no cast exists."""
    if a == b:
        return cell
    return cell.try_cast(b) if castable(a, b) else F.lit(None).cast(b)
