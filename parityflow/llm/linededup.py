"""Removal of lines that other documents hold, over levelled sorted runs of line hashes.

A store of runs remembers which document holds each line first. Runs are Parquet tables sorted
by line hash, without overlap; new ones enter level 0, and when a level has ``FANOUT`` of them
they are merged into one run of the next level. A batch of documents is merge-joined with the
runs: a line found there belongs to an earlier document, and the lines that no run knows are
added as a new run. Batches therefore come in the order of their ids.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z lower-cased.
Keys shorter than ``MIN_CHARS`` code points are left alone, also when they repeat. A longer key
stays where the smallest id holds it, with all its repeats there. Null or empty text is one empty
line. A null id counts as larger than every other, and rows that share an id are one document,
each row keeping its own text. Empty tables give empty tables; extra columns pass through.
Keys are compared by 128 hash bits.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parityflow.session import materialised, shared_dir

MIN_CHARS = 10  #: shorter keys are never dropped
FANOUT = 3  #: runs of a level that are merged into the next
BATCHES = 4  #: batches that a whole table is split into
_LAST = (1 << 63) - 1


def line_key(line: Column) -> Column:
    trimmed = F.btrim(line, F.lit(" \t\n\x0b\f\r"))
    return F.translate(trimmed, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _lines(docs: DataFrame) -> DataFrame:
    """``id, t, pos, h1, h2``: the long enough lines of every row; ``t`` is the hash of its text."""
    rows = docs.select("id", F.xxhash64("text").alias("t"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keys = rows.filter(F.length("line") >= MIN_CHARS).select("id", "t", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= MIN_CHARS)
    # the second hash reads the key the other way round, so that both are independent
    return keys.select("id", "t", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.reverse("key")).alias("h2"))


class LineRuns:
    """Levelled sorted runs ``h1, h2, first`` in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.levels = spark, [[]]
        self.folder = folder or f"{shared_dir(spark)}/line-runs-{uuid.uuid4().hex}"

    def _write(self, rows: DataFrame) -> str:
        path = f"{self.folder}/run-{uuid.uuid4().hex}"
        rows.repartition("h1", "h2").sortWithinPartitions("h1", "h2").write.parquet(path)
        return path

    def known(self) -> DataFrame | None:
        """All runs together; every key is in one of them."""
        paths = [p for level in self.levels for p in level]
        return self.spark.read.schema("h1 long, h2 long, first long").parquet(*paths) if paths else None

    def add(self, docs: DataFrame) -> DataFrame:
        """Take in ``id, text`` rows with larger ids than before; returns ``id, t, pos`` of the lines to drop."""
        return self.add_lines(materialised(_lines(docs)))

    def add_lines(self, lines: DataFrame) -> DataFrame:
        """The same for stored lines ``id, t, pos, h1, h2``, which are read twice."""
        before = self.known()
        own = lines.groupBy("h1", "h2").agg(F.min("id").alias("first"))
        fresh = own if before is None else own.join(before, ["h1", "h2"], "left_anti")
        self.levels[0].append(self._write(fresh))
        drops = lines.join(self.known(), ["h1", "h2"]).filter(F.col("first") < F.col("id")).select("id", "t", "pos")
        path = f"{self.folder}/drops-{uuid.uuid4().hex}"
        drops.write.parquet(path)
        self._compact()
        return self.spark.read.schema("id long, t long, pos int").parquet(path)

    def _compact(self) -> None:
        for n, level in enumerate(self.levels):
            if len(level) >= FANOUT:
                merged = self._write(self.spark.read.schema("h1 long, h2 long, first long").parquet(*level))
                self.levels[n] = []
                if n + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[n + 1].append(merged)
                break


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batches: int = BATCHES) -> DataFrame:
    """``docs`` with ``text`` replaced by its kept lines, and ``n_lines`` and ``n_dropped`` added."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    points = [i / batches for i in range(1, batches)]
    cuts = sorted(set(rows.stat.approxQuantile("id", points, 0.01))) if points else []
    runs, dropped = LineRuns(spark), []
    # texts are split once; a batch is a folder of the stored lines
    batch = sum((F.when(F.col("id") > cut, 1).otherwise(0) for cut in cuts), F.lit(0))
    path = f"{runs.folder}/lines"
    _lines(rows).withColumn("batch", batch).write.partitionBy("batch").parquet(path)
    lines = spark.read.schema("id long, t long, pos int, h1 long, h2 long, batch int").parquet(path)
    for n in range(len(cuts) + 1):
        dropped.append(runs.add_lines(lines.filter(F.col("batch") == n).drop("batch")))
    drops = dropped[0]
    for d in dropped[1:]:
        drops = drops.union(d)
    # one row per changed text; its positions are bounded by its own lines
    gone = drops.groupBy(F.col("id").alias("__id"), F.col("t").alias("__t")).agg(F.collect_set("pos").alias("__gone"))
    made = {"n_lines", "n_dropped"}
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in made])
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    keyed = base.withColumns({"__id": F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)), "__t": F.xxhash64(whole)})
    joined = keyed.join(gone, ["__id", "__t"], "left").withColumn("__lines", F.split(whole, "\n", -1))
    places = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    kept = F.when(F.col("__gone").isNull(), whole).otherwise(F.array_join(F.transform(places, lambda p: F.col("__lines")[p]), "\n"))
    out = joined.withColumns({text: kept, "n_lines": F.size("__lines").cast("long"), "n_dropped": F.coalesce(F.size("__gone"), F.lit(0)).cast("long")})
    return out.select(*base.columns, "n_lines", "n_dropped")
