"""Connected components of links, on Spark."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parityflow.session import materialised

FOREST_LINKS = 500_000  #: links a task joins before it hands its forest on


class Forest:
    """Union by smallest id, within a task."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up, at = self.up, x
        while (nxt := up.get(at, at)) != at:
            at = nxt
        while x != at:
            up[x], x = at, up.get(x, x)
        return at

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def links(self) -> tuple[list[int], list[int]]:
        nodes = list(self.up)
        return nodes, [self.root(x) for x in nodes]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()

    def rows():
        a, b = forest.links()
        forest.up.clear()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.join(a, b)
        if len(forest.up) >= FOREST_LINKS:
            yield rows()
    yield rows()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of every node in the two id columns of ``links``: the smallest id reachable.

    Tasks first reduce their links to forests; then every node is linked to the smallest of its
    larger and of its smaller neighbours in turn, until nothing changes. Nodes without a link to
    another node are left out. Minima are combined before they are shuffled, and what a round
    makes is written to the shared folder, so lost executors cost one round at most.
    """
    a, b = (F.col(f"`{c}`").cast("long") for c in links.columns[:2])
    pairs = links.select(a.alias("a"), b.alias("b")).filter((F.col("a") != F.col("b")))
    edges = materialised(pairs.mapInArrow(_forests, "a long, b long").filter(F.col("a") != F.col("b")).distinct())
    mark = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialised(small.union(low).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b")).distinct()
        mark = now
