"""Exact top-k by inner product with the threshold algorithm.

The vectors are dealt into blocks. A block holds its rows sorted by every dimension; for a query
the lists are read from the end that the query's sign asks for, a few places deeper each time,
rows met for the first time are scored in full, and reading stops once the score that the
current places would give cannot beat or tie the k-th best. The blocks' best are then ranked.

Components are the whole numbers ``floor(SCALE * x)``, scores are exact, and a score outside the
range of long is ranked by its exact value and given as the nearest long. Vectors with a
component of ``LARGEST`` or more are kept apart and scored in Python's whole numbers, as is
everything for a query whose products could leave the long range. Vectors that are null or hold
null or non-finite components take no part; vectors meet only vectors of their length.
Rows that share the query's id are never its candidates; repeated candidate rows each count,
equal query rows are asked once. Ties go to the smaller id; null ids take no part. An empty
table gives an empty result, and extra columns are not read.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parityflow.session import materialised

SCALE = 1024
BLOCK_ROWS = 4096  #: rows of a block, of candidates and of queries
MIN_BLOCKS = 64
LARGEST = 1 << 28  #: scaled components below this are held as int, and multiplied as long
_LOW = (1 << 63) - 1
_WIDEST = 2176  #: bits that hold any sum of 2^64 products of two scaled doubles, and a sign


def whole_numbers(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """``id, v, far, dims`` of the vectors that take part: whole numbers in ``v``, or where one is too large the components in ``far``."""
    e = F.col(f"`{embedding}`").cast("array<double>")
    inf = float("inf")
    sound = F.col(f"`{embedding}`").isNotNull() & F.col(f"`{vec_id}`").isNotNull() & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == inf))
    large = F.exists(e, lambda x: F.abs(x) >= LARGEST / SCALE)
    numbers = F.when(~large, F.transform(e, lambda x: F.floor(x * SCALE).cast("int")))
    return vectors.filter(sound).select(F.col(f"`{vec_id}`").cast("long").alias("id"), numbers.alias("v"), F.when(large, e).alias("far"), F.size(e).alias("dims"))


def _scaled(x: float) -> int:
    """``floor(SCALE * x)``, whatever the size."""
    return int(x) * SCALE if abs(x) >= 1 << 53 else math.floor(x * SCALE)


def _far(table: pa.Table) -> dict[int, list[int]]:
    """Whole numbers of the rows of ``table`` that have components in ``far``, by place."""
    return {i: [_scaled(x) for x in values] for i, values in enumerate(table.column("far").to_pylist()) if values is not None}


def _parts(score: int) -> tuple[int, int, bytes | None]:
    """What orders scores of any size: the bits above 63, the lower 63, and between them, where the upper ones leave long, all bits as bytes."""
    high = score >> 63
    if abs(high) < 1 << 62:
        return high, score & _LOW, None
    return (1 << 62 if high > 0 else -1 << 62), 0, (score + (1 << _WIDEST - 1)).to_bytes(_WIDEST // 8)


def best_of_block(rows: np.ndarray, ids: np.ndarray, order: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the ``k`` best rows for one query, by the threshold algorithm."""
    n = len(rows)
    active = np.flatnonzero(query)
    if not len(active):  # every row scores 0
        places = np.flatnonzero(ids != own)
        places = places[np.argsort(ids[places], kind="stable")[:k]]
        return ids[places], np.zeros(len(places), np.int64)
    weights = query[active]
    lists = order[:, active]
    lists = np.where(weights > 0, lists[::-1], lists)
    seen = ids == own
    best_ids, best = np.empty(0, np.int64), np.empty(0, np.int64)
    depth, step = 0, 4
    while depth < n:
        end = min(n, depth + step)
        new = np.unique(lists[depth:end])
        new = new[~seen[new]]
        seen[new] = True
        best_ids, best = np.concatenate([best_ids, ids[new]]), np.concatenate([best, rows[new] @ query])
        keep = np.lexsort((best_ids, -best))[:k]
        best_ids, best = best_ids[keep], best[keep]
        bound = int(weights @ rows[lists[end - 1], active])
        if len(best) == k and best[-1] > bound:
            break
        depth, step = end, step * 2
    return best_ids, best


def _matrix(table: pa.Table, dims: int) -> np.ndarray:
    """The whole numbers in ``v`` as rows; zeros where there are none."""
    column = table.column("v").combine_chunks()
    out = np.zeros((table.num_rows, dims), np.int64)
    held = column.is_valid().to_numpy(zero_copy_only=False)
    out[held] = column.flatten().to_numpy(zero_copy_only=False).reshape(int(held.sum()), dims)
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's ``k`` best rows of ``vectors``.

    Candidates and queries meet block by block, each once: a cell holds ``BLOCK_ROWS`` of
    either at most, on average, and gives off ``k`` rows for a query.
    """
    rows, asked = whole_numbers(vectors, vec_id, embedding), materialised(whole_numbers(queries, vec_id, embedding).dropDuplicates(["id", "v", "far"]))
    blocks = max(MIN_BLOCKS, -(-vectors.count() // BLOCK_ROWS))
    chunks = max(1, -(-asked.count() // BLOCK_ROWS))
    mark = F.xxhash64("id", "v", "far")
    left = rows.withColumn("block", F.pmod(mark, F.lit(blocks))).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    right = asked.withColumns({"mark": mark, "chunk": F.pmod(mark, F.lit(chunks)).cast("int")})
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def cell(candidates: pa.Table, asked_here: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], [], []]

        def give(own: int, m: int, found: list[int], scores: list[tuple]) -> None:
            for values, more in zip(out, ([own] * len(found), [m] * len(found), found, *([s[i] for s in scores] for i in range(3)))):
                values += more

        if candidates.num_rows and asked_here.num_rows:
            dims = candidates.column("dims")[0].as_py()
            far, far_asked = _far(candidates), _far(asked_here)
            everything, all_ids = _matrix(candidates, dims), candidates.column("id").to_numpy().astype(np.int64)
            near = np.array([i for i in range(len(all_ids)) if i not in far], np.int64)
            matrix, ids = (everything[near], all_ids[near]) if far else (everything, all_ids)
            order = np.argsort(matrix, axis=0, kind="stable")
            largest = int(np.abs(matrix).max(initial=0))
            wanted = _matrix(asked_here, dims)
            for place, (q, own, m) in enumerate(zip(wanted, asked_here.column("id").to_pylist(), asked_here.column("mark").to_pylist())):
                exact = {i: v for i, v in far.items() if all_ids[i] != own}
                query = far_asked.get(place)
                if query is not None or int(np.abs(q).sum()) * largest >= 1 << 62:
                    exact |= {int(i): everything[i].tolist() for i in near if all_ids[i] != own}
                elif len(ids):
                    found, scores = best_of_block(matrix, ids, order, q, own, k)
                    give(own, m, found.tolist(), list(zip((scores >> 63).tolist(), (scores & _LOW).tolist(), [None] * len(found))))
                if exact:
                    query = query if query is not None else q.tolist()
                    scored = ((sum(a * b for a, b in zip(v, query)), -int(all_ids[i])) for i, v in exact.items())
                    best = heapq.nlargest(k, scored)
                    give(own, m, [-i for _, i in best], [_parts(s) for s, _ in best])
        numbers = [pa.array(v, pa.int64()) for v in out[:5]]
        return pa.table([*numbers, pa.array(out[5], pa.binary())], ["query_id", "mark", "vec_id", "high", "low", "between"])

    keys = ("dims", "block", "chunk")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, "query_id long, mark long, vec_id long, high long, low long, between binary")
    best_first = Window.partitionBy("query_id", "mark").orderBy(F.desc("high"), F.desc("between"), F.desc("low"), "vec_id")
    least = F.lit(-1 << 63)
    score = F.when(F.col("high") > 0, F.lit(_LOW)).when(F.col("high") < -1, least).when(F.col("high") == 0, F.col("low")).otherwise(F.col("low") + least)
    ranked = found.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", score.alias("score"))
