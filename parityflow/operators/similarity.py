"""Cosine top-k over embedded text, and the text documents to embed."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parityflow.functions.keys import q
from parityflow.functions.vectors import cosine_similarity

BLOCK_ROWS = 8192
QUERY_BLOCK_ROWS = 32_768
STEP_QUERIES = 512  # scored at a time, so a step holds STEP_QUERIES x BLOCK_ROWS scores


def similar_to(vectors: DataFrame, query: Sequence[float], k: int = 5, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` rows most similar to one vector; rows without a vector do not take part.

    Every task keeps its own top k, only those meet.
    """
    wanted = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.filter(q(vector).isNotNull()).withColumn("score", cosine_similarity(q(vector), wanted))
    return scored.orderBy(F.desc("score"), q(id_column).asc()).limit(k)


def _matrix(cells: pd.Series) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Unit rows by vector length: positions and matrix.  Zero vectors stay zero."""
    sizes = cells.map(len).to_numpy()
    out = {}
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        rows = np.empty((len(at), size))
        for i, cell in enumerate(cells.iloc[at]):
            rows[i] = cell
        norms = np.sqrt(np.einsum("ij,ij->i", rows, rows))
        usable = norms > 0
        np.divide(rows, np.where(usable, norms, 1.0)[:, None], out=rows)
        rows[~usable] = 0.0
        out[int(size)] = (at, rows)
    return out


def _block_top(query_ids: np.ndarray, queries: dict, ids: np.ndarray, rows: dict, k: int) -> pd.DataFrame:
    """Top k of one block of vectors for every query of one block."""
    n = sum(len(at) for at, _ in queries.values()) * min(k, len(ids))
    asked, found, reached, filled = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64), np.empty(n), 0
    # vectors of another length score 0.0, so every query sees all ids
    steps = [(size, at[i : i + STEP_QUERIES], lines[i : i + STEP_QUERIES]) for size, (at, lines) in queries.items() for i in range(0, len(at), STEP_QUERIES)]
    for size, q_at, q_rows in steps:
        scores = np.zeros((len(q_at), len(ids)))
        if size in rows and size > 0:
            at, matrix = rows[size]
            scores[:, at] = q_rows @ matrix.T
        for line, position in zip(scores, q_at):
            if len(ids) > k:
                # keep every row that ties with the k-th score, then order by id
                floor = np.partition(line, -k)[-k]
                near = np.flatnonzero(line >= floor)
            else:
                near = np.arange(len(ids))
            order = near[np.lexsort((ids[near], -line[near]))][:k]
            part = slice(filled, filled + len(order))
            asked[part], found[part], reached[part], filled = position, order, line[order], filled + len(order)
    return pd.DataFrame({"query_id": query_ids[asked[:filled]], "match_id": ids[found[:filled]], "score": reached[:filled]})


def _final(partial: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("match_id"))
    return partial.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def batch_top_k(
    queries: DataFrame, vectors: DataFrame, k: int = 5, id_column: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """``query_id, match_id, score, rank``: the ``k`` best vectors for every query vector.

    Queries and vectors are cut into blocks.  Each pair of blocks is multiplied
    as matrices and gives off only its own top k per query; the full table of
    scores never exists.  Ids keep the type they have.
    """
    asked = queries.filter(q(vector).isNotNull()).select(q(id_column).alias("query_id"), q(vector).alias("v"))
    base = vectors.filter(q(vector).isNotNull()).select(q(id_column).alias("match_id"), q(vector).alias("v"))
    schema = T.StructType([asked.schema["query_id"], base.schema["match_id"], T.StructField("score", T.DoubleType())])

    def blocks(df: DataFrame, rows: int) -> int:
        return max(1, -(-df.count() // rows))

    n_query, n_base = blocks(asked, QUERY_BLOCK_ROWS), blocks(base, BLOCK_ROWS)
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    q_side = asked.withColumn("qb", place("query_id", n_query)).withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(n_base - 1))))
    v_side = base.withColumn("vb", place("match_id", n_base)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_query - 1))))

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "match_id": [], "score": []})
        return _block_top(left["query_id"].to_numpy(), _matrix(left["v"]), right["match_id"].to_numpy(), _matrix(right["v"]), k)

    # a cell holds about a block of each side whatever the data looks like
    grid = q_side.groupBy("qb", "vb").cogroup(v_side.groupBy("qb", "vb")).applyInPandas(cell, schema)
    return _final(grid, k)


def save_chunks(index: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks put into the index by ``id``."""
    from parityflow.operators.history import replace_by_key

    return replace_by_key(index, chunks, ["id"])


def clear_connection(index: DataFrame, connection_id: str) -> DataFrame:
    """The index without the chunks of one connection."""
    return index.filter(~F.col("connection_id").eqNullSafe(F.lit(connection_id)))


def entity_documents(
    details: DataFrame, entity: str, position: str, line: str, header: DataFrame | None = None, lines_per_chunk: int = 2000
) -> DataFrame:
    """Detail rows gathered into text: ``entity, chunk_no, content``.

    ``position`` numbers the lines of an entity from 0 without repeats; it also
    cuts very long entities into chunks, so no group outgrows
    ``lines_per_chunk`` and no line is lost.  ``header(entity, head)`` is put on top.
    """
    placed = details.select(
        q(entity).alias("entity"), F.floor(q(position) / F.lit(lines_per_chunk)).alias("chunk_no"),
        F.struct(q(position).alias("at"), q(line).alias("line")).alias("x"),
    )
    text = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n")
    out = placed.groupBy("entity", "chunk_no").agg(text.alias("content"))
    if header is not None:
        out = out.join(header, "entity", "left_outer").withColumn("content", F.concat_ws("\n", "head", "content")).drop("head")
    return out


def column_line(name="name", data_type="data_type", max_length="max_length", nullable="is_nullable", pk="is_primary_key"):
    """``column name type(length), optional, key``"""
    size = F.when(q(max_length).isNotNull(), F.concat(F.lit("("), q(max_length).cast("string"), F.lit(")"))).otherwise(F.lit(""))
    marks = [F.when(q(c), F.lit(mark)).otherwise(F.lit("")) for c, mark in ((nullable, ", optional"), (pk, ", key"))]
    return F.concat(F.lit("column "), q(name), F.lit(" "), q(data_type), size, *marks)


def index_line():
    """``unique index name on a, b``"""
    kind = F.when(F.col("is_unique"), F.lit("unique index ")).otherwise(F.lit("index "))
    return F.concat(kind, F.col("name"), F.lit(" on "), F.array_join("columns", ", "))


def constraint_line():
    """``Kind name on a, b``"""
    return F.concat(F.col("constraint_type"), F.lit(" "), F.col("name"), F.lit(" on "), F.array_join("columns", ", "))


def schema_chunks(
    columns: DataFrame, indexes: DataFrame, constraints: DataFrame, row_counts: DataFrame, connection_id: str,
    connection_name: str, schema_name: str = "public", lines_per_chunk: int = 2000,
) -> DataFrame:
    """The definition of every table as text: columns, then indexes, then constraints.

    Catalog tables as in ``schema_diff`` with an ``ordinal_position``; ``row_counts(table_name, row_count)``.
    A definition of more than ``lines_per_chunk`` lines goes on in further chunks under the same head.
    """

    def lines(df: DataFrame, section: int, line) -> DataFrame:
        return df.select("table_name", F.lit(section).alias("section"), F.col("ordinal_position").cast("long").alias("at"), line.alias("line"))

    everything = lines(columns, 0, column_line()).unionByName(lines(indexes, 1, index_line())).unionByName(lines(constraints, 2, constraint_line()))
    numbered = everything.withColumn("position", F.row_number().over(Window.partitionBy("table_name").orderBy("section", "at", "line")) - 1)
    count = F.coalesce(F.col("row_count").cast("string"), F.lit("?"))
    named = everything.select("table_name").distinct().join(row_counts, "table_name", "left_outer")
    heads = named.select(F.col("table_name").alias("entity"), F.concat(F.lit(f"{schema_name}."), "table_name", F.lit(", rows: "), count).alias("head"))
    texts = entity_documents(numbered, "table_name", "position", "line", heads, lines_per_chunk)
    return texts.select(
        F.concat(F.lit(f"{connection_id}/{schema_name}/"), "entity", F.lit("#"), F.col("chunk_no").cast("string")).alias("id"),
        F.lit(connection_id).alias("connection_id"),
        F.lit("table").alias("chunk_type"),
        F.concat(F.lit(f"{schema_name}."), "entity", F.lit(f" @ {connection_name}")).alias("label"),
        "content",
    )


def summary_chunks(tables: DataFrame, connection_id: str, connection_name: str, engine: str, names_per_chunk: int = 2000) -> DataFrame:
    """The names of a connection's tables, dealt by their hash into chunks of about ``names_per_chunk``; none without tables."""
    title, names = f"{connection_name}, {engine}", tables.select("table_name").filter("table_name IS NOT NULL").distinct()
    n = names.count()
    place = F.conv(F.substring(F.md5("table_name"), 1, 8), 16, 10).cast("long") % max(1, -(-n // names_per_chunk))
    listed = names.groupBy(place.alias("chunk_no")).agg(F.array_join(F.array_sort(F.collect_list("table_name")), "\n").alias("names"))
    return listed.select(
        F.concat(F.lit(f"{connection_id}/#"), F.col("chunk_no").cast("string")).alias("id"),
        F.lit(connection_id).alias("connection_id"),
        F.lit("tables").alias("chunk_type"),
        F.lit(title).alias("label"),
        F.concat(F.lit(f"{title}, tables: {n}\n"), "names").alias("content"),
    )
