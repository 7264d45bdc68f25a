"""Near-duplicate embeddings: binary codes by iterative quantisation, multi-index tables, exact rerank.

A rotation that balances the signs of the principal components is learned from a bounded sample
of vectors; the signs are a vector's code. The code is cut into ``TABLES`` substrings, and two
vectors of one label meet where a substring agrees, which is certain for codes that differ in
fewer places than there are tables. What meets is compared by the cosine of the original vectors
in double precision; a pair that meets in several tables counts in the first.

Equal vectors of a label are one class, so copies are never paired with each other. A large
bucket is cut into chunks that are compared chunk by chunk; a task gives off sums of links and
a forest, not the pairs. Vectors that are null, zero or hold null or non-finite components,
and vectors with a null label, link with nothing, nor do vectors of different lengths. Rows
with the same id are one node of the components; a null id has no component, keeps its row
and links with nothing. Empty tables give empty tables; extra columns are not returned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parityflow.llm.graph import Forest, components
from parityflow.session import materialised

THRESHOLD = 0.98
SAMPLE_ROWS = 20_000  #: vectors that the rotation is learned from
ROUNDS = 50  #: of quantisation
BITS = 64  #: of a code at most
TABLES = 8
CHUNK_ROWS = 2_048  #: rows of a bucket that are compared at a time
BIN_ROWS = 20_000  #: rows of the cells that one call compares, about, for vectors of 64 numbers
HELD = 1 << 20  #: numbers that a comparison holds at a time


def learn_rotation(sample: np.ndarray, bits: int = BITS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (dimensions x bits) whose signs are balanced codes."""
    mean = sample.mean(axis=0)
    centred = sample - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    projected = centred @ (axes := axes[:, ::-1][:, : min(bits, sample.shape[1])])
    turn = np.linalg.qr(np.random.default_rng(7).standard_normal((axes.shape[1],) * 2))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.where(projected @ turn >= 0, 1.0, -1.0).T @ projected)
        turn = (u @ v).T
    return mean, axes @ turn


def _vectors(column, dims: int | None = None) -> np.ndarray:
    """Rows of a list column of one length, or cut and filled up with zeros to ``dims`` numbers."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if dims is None:
        return values.reshape(len(lists), -1)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    within = np.arange(dims)
    held = within < sizes[:, None]
    out = np.zeros((len(lists), dims))
    out[held] = values[((np.cumsum(sizes) - sizes)[:, None] + within)[held]]
    return out


def _hits(a: np.ndarray, b: np.ndarray, threshold: float, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of ``a`` and ``b`` that are ``wanted`` and whose cosine reaches the threshold, by ``HELD`` numbers at a time however many pairs reach it."""
    square_a, square_b = (np.einsum("ij,ij->i", x, x) for x in (a, b))
    unit_b = b / np.sqrt(square_b)[:, None]
    rows, pairs = max(1, HELD // len(b)), max(1, HELD // a.shape[1])
    for at in range(0, len(a), rows):
        near = (a[at : at + rows] / np.sqrt(square_a[at : at + rows])[:, None]) @ unit_b.T >= threshold - 1e-9
        i, j = np.nonzero(near)
        for k in range(0, len(i), pairs):
            x, y = i[k : k + pairs] + at, j[k : k + pairs]
            new = wanted(x, y)
            x, y = x[new], y[new]
            exact = np.einsum("ij,ij->i", a[x], b[y]) / np.sqrt(square_a[x] * square_b[y])
            reached = exact >= threshold
            yield x[reached], y[reached]


def _compare(table: pa.Table, threshold: float) -> pa.Table:
    """Links within the cells of one bin: summed per class, and as a forest of ids."""
    cells = table.column("cell").to_numpy()
    order = np.argsort(cells, kind="stable")
    starts = np.flatnonzero(np.diff(cells[order], prepend=cells[order][0] - 1))
    rep, n, at, mine = (table.column(c).to_numpy() for c in ("rep", "n", "t", "mine"))
    codes = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(len(cells), -1)
    embeddings = table.column("embedding").combine_chunks()
    others, forest, root = np.zeros(len(cells), np.int64), Forest(), rep.copy()
    for start, end in zip(starts, [*starts[1:], len(order)]):
        here = order[start:end]
        left, right = here[mine[here] < 2], here[mine[here] > 0]  # 0 and 2: sides of a pair of chunks; 1: both
        if len(here) < 2 or not len(left) or not len(right):
            continue
        a, b = (_vectors(embeddings.take(pa.array(x))) for x in (left, right))

        def wanted(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            x, y = left[i], right[j]
            first = ~(codes[x, : at[here[0]]] == codes[y, : at[here[0]]]).any(axis=1)
            return first & (x < y) if mine[here[0]] == 1 else first

        for i, j in _hits(a, b, threshold, wanted):
            x, y = left[i], right[j]
            np.add.at(others, x, n[y])
            np.add.at(others, y, n[x])
            apart = root[x] != root[y]
            if apart.any():
                for p, q in zip(root[x[apart]].tolist(), root[y[apart]].tolist()):
                    forest.join(p, q)
                known, place = np.unique(root[here], return_inverse=True)
                root[here] = np.array([forest.root(r) for r in known.tolist()])[place]
    linked = np.flatnonzero(others)
    summed = pa.table({"a": table.column("k1").take(linked), "b": table.column("k2").take(linked), "n": others[linked]}).group_by(["a", "b"]).aggregate([("n", "sum")])
    nodes, roots = forest.links()
    counts = pa.table({"counts": pa.repeat(True, len(summed)), "a": summed.column("a"), "b": summed.column("b"), "n": summed.column("n_sum")})
    tree = pa.table({"counts": pa.repeat(False, len(nodes)), "a": pa.array(nodes, pa.int64()), "b": pa.array(roots, pa.int64()), "n": pa.repeat(pa.scalar(0, pa.int64()), len(nodes))})
    return pa.concat_tables([counts, tree])


def link_embeddings(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD, tables: int = TABLES
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row."""
    e, name = F.col(f"`{embedding}`"), F.col(f"`{label}`")
    sound = e.isNotNull() & name.isNotNull() & F.col(f"`{vec_id}`").isNotNull() & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0)
    floats = vectors.select(e).schema[0].dataType.simpleString() == "array<float>"  # widened without loss where they are compared
    kind = "array<float>" if floats else "array<double>"
    rows = vectors.select(
        F.col(f"`{vec_id}`").cast("long").alias("vec_id"), e.cast(kind).alias("embedding"), F.coalesce(sound, F.lit(False)).alias("sound"),
        F.xxhash64(F.lit(1), name, e).alias("k1"), F.xxhash64(F.lit(2), e, name).alias("k2"), F.xxhash64(name, F.size(e)).alias("label"),
    )
    grouped = rows.filter("sound").groupBy("k1", "k2", "label").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding"))
    classes = materialised(grouped)
    sample = classes.orderBy("k1", "k2").limit(SAMPLE_ROWS).select("embedding").toArrow().column(0)

    def single(df: DataFrame) -> DataFrame:
        return df.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))

    if not len(sample):
        return single(rows)
    dims = pc.max(pc.list_value_length(sample)).as_py()
    mean, projection = learn_rotation(_vectors(sample, dims))
    parts = np.array_split(np.arange(projection.shape[1]), min(tables, projection.shape[1]))

    def encode(batches):
        for batch in batches:
            column, step = batch.column(batch.schema.get_field_index("embedding")), max(1, HELD // dims)
            code = []
            for start in range(0, batch.num_rows, step):
                signs = (_vectors(column.slice(start, step), dims) - mean) @ projection >= 0
                # a substring of up to 8 bits is one byte of the code
                code += [r.tobytes() for r in np.stack([np.packbits(signs[:, p], axis=1)[:, 0] for p in parts], axis=1).astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code, pa.binary())], [*batch.schema.names, "code"])

    coded = materialised(classes.mapInArrow(encode, f"k1 long, k2 long, label long, rep long, n long, embedding {kind}, code binary"))
    # vectors travel once they are dealt into bins; buckets are counted and cut without them
    spread = coded.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(len(parts) - 1))))
    spread = spread.select("k1", "k2", "t", F.xxhash64("label", "t", F.substring("code", F.col("t") + 1, F.lit(1))).alias("bucket"))
    sizes = materialised(spread.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / CHUNK_ROWS).cast("int").alias("chunks"), F.count(F.lit(1)).alias("size")).filter("size > 1"))
    chunked = spread.join(sizes, "bucket").withColumn("c", F.pmod("k1", "chunks").cast("int"))
    celled = coded.drop("label").join(chunked, ["k1", "k2"]).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    celled = celled.withColumn("cell", F.xxhash64("bucket", F.least("c", "o"), F.greatest("c", "o")))
    celled = celled.withColumn("mine", F.when(F.col("c") == F.col("o"), 1).when(F.col("c") < F.col("o"), 0).otherwise(2))
    # a row comes once for every chunk of its bucket
    repeated = sizes.agg(F.sum(F.col("size") * F.col("chunks"))).first()[0] or 0
    bins = max(64, repeated * max(dims, 64) // (64 * BIN_ROWS))
    binned = celled.select("k1", "k2", "rep", "n", "embedding", "code", "t", "cell", "mine", F.pmod("cell", F.lit(bins)).alias("bin"))
    compared = materialised(binned.groupBy("bin").applyInArrow(lambda t: _compare(t, threshold), "counts boolean, a long, b long, n long"))
    links = compared.filter("counts").groupBy(F.col("a").alias("k1"), F.col("b").alias("k2")).agg(F.sum("n").alias("others"))
    groups = components(compared.filter("NOT counts").select("a", "b"))
    found = classes.select("k1", "k2", "rep", "n").join(links, ["k1", "k2"], "left").join(groups, F.col("rep") == F.col("node"), "left")
    per_class = found.select("k1", "k2", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = rows.filter("sound").select("vec_id", "k1", "k2").join(per_class, ["k1", "k2"])
    linked = linked.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return linked.union(single(rows.filter("NOT sound")))
