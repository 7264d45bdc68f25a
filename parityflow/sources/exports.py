"""Writing diffs and scripts as text files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parityflow.functions.equality import cell_text
from parityflow.functions.keys import q
from parityflow.operators.compare import flat_rows


def display_rows(d: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """``_rowId, _status, _changedColumns`` and the data columns of a diff."""
    flat = flat_rows(d)
    types = {f.name: f.dataType for f in flat.schema}
    names = list(columns) if columns is not None else [c for c in flat.columns if c not in ("status", "changed_columns")]
    row_id = F.concat_ws("|", *[F.coalesce(cell_text(q(k), types[k]), F.lit("")) for k in keys])
    return flat.select(row_id.alias("_rowId"), F.col("status").alias("_status"), F.col("changed_columns").alias("_changedColumns"), *[q(c) for c in names])


def csv_rows(rows: DataFrame) -> DataFrame:
    """Display rows with every cell as text, NULL as the empty text."""
    cells = []
    for f in rows.schema:
        c = F.concat_ws(";", q(f.name)) if f.name == "_changedColumns" else cell_text(q(f.name), f.dataType)
        cells.append(F.coalesce(c, F.lit("")).alias(f.name))
    return rows.select(*cells)


def export_csv(rows: DataFrame, path: str) -> None:
    """Quoted only where needed, quotes doubled, one header per part file."""
    csv_rows(rows).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option(
        "emptyValue", ""
    ).csv(path)


def export_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def export_lines(df: DataFrame, line: str, path: str) -> None:
    """One text line per row, such as statements or report lines."""
    df.select(q(line).alias("value")).write.mode("overwrite").text(path)
