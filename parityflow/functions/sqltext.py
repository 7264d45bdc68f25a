"""SQL text of identifiers and cells for a target engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parityflow.functions.equality import cell_text

ENGINES = ("SqlServer", "PostgreSql", "MySql", "Sqlite", "MongoDb", "Oracle", "CosmosDb")


def quote_name(name: str, engine: str) -> str:
    opening, closing = {"SqlServer": ("[", "]"), "MySql": ("`", "`")}.get(engine, ('"', '"'))
    return f"{opening}{name.replace(closing, closing * 2)}{closing}"


def literal(c: Column, dtype: T.DataType, engine: str) -> Column:
    """A cell as a SQL literal; never a null column. NaN and infinite numbers become NULL."""
    if isinstance(dtype, T.BooleanType):
        yes, no = ("1", "0") if engine == "SqlServer" else ("TRUE", "FALSE")
        text = F.when(c, F.lit(yes)).otherwise(F.lit(no))
        return F.when(c.isNull(), F.lit("NULL")).otherwise(text)
    text = cell_text(c, dtype)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):  # engines have no literal for these
        text = F.when(~(F.isnan(c) | (F.abs(c) == float("inf"))), text)
    if not isinstance(dtype, T.NumericType):
        if engine == "MySql":
            text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
        text = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))
    return F.coalesce(text, F.lit("NULL"))
