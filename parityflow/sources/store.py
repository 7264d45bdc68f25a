"""A versioned Parquet table: new versions beside the old, then one atomic switch."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parityflow.functions.keys import q

BUCKET = "__bucket"


class VersionedTable:
    """Rows are laid out by key bucket; a manifest says which version of each bucket counts.

    A publish writes only the buckets it is given, then replaces the small
    ``_current`` file by a rename.  A failed or killed publish leaves the old
    version in place; older versions stay as backups.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = 64) -> None:
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets

    # -- small files through the cluster's file system ---------------------------------
    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _read_small(self, name: str) -> str | None:
        fs, p = self._fs(f"{self.path}/{name}")
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _write_small(self, name: str, text: str) -> None:
        fs, p = self._fs(f"{self.path}/{name}")
        fs.mkdirs(p.getParent())
        temp = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}.tmp")
        stream = fs.create(temp, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        flags = gateway.new_array(rename, 1)
        flags[0] = rename.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(fs.makeQualified(temp), fs.makeQualified(p), flags)

    def manifest(self) -> dict | None:
        version = self._read_small("_current")
        return None if version is None else json.loads(self._read_small(f"_manifest/{int(version):08d}.json"))

    # -- data ---------------------------------------------------------------------------
    def bucket_of(self, df: DataFrame):
        return F.pmod(F.xxhash64(*[q(k) for k in self.keys]), F.lit(self.buckets)).cast("int")

    def read(self, buckets: Sequence[int] | None = None) -> DataFrame | None:
        """The current rows, all or of some buckets; None before the first publish."""
        m = self.manifest()
        if m is None:
            return None
        wanted = m["buckets"].items() if buckets is None else [(str(b), m["buckets"][str(b)]) for b in buckets if str(b) in m["buckets"]]
        schema = T.StructType.fromJson(m["schema"])
        paths = [f"{self.path}/data/v={v:08d}/{BUCKET}={b}" for b, v in wanted]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def publish(self, df: DataFrame, buckets: Sequence[int] | None = None, tag: str | None = None) -> int:
        """Write ``df`` as the new content of ``buckets`` (default: of the whole table)."""
        old = self.manifest()
        version = self._next_version(old)
        target = f"{self.path}/data/v={version:08d}"
        placed = df.withColumn(BUCKET, self.bucket_of(df))
        # rows of a bucket meet in few tasks; large buckets are split, small ones share a task
        placed.hint("rebalance", BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(target)
        fs, p = self._fs(target)
        written = {s.getPath().getName().split("=")[1] for s in fs.listStatus(p) if s.isDirectory() and "=" in s.getPath().getName()}
        kept = {} if buckets is None or old is None else {b: v for b, v in old["buckets"].items() if int(b) not in set(buckets)}
        manifest = {
            "version": version,
            "previous": old["version"] if old else None,
            "tag": tag,
            "schema": df.schema.jsonValue(),
            "buckets": {**kept, **{b: version for b in written}},
        }
        self._write_small(f"_manifest/{version:08d}.json", json.dumps(manifest))
        self._write_small("_current", str(version))
        return version

    def _next_version(self, current: dict | None) -> int:
        """One above every manifest there is, so that a rolled-back version is never reused."""
        fs, p = self._fs(f"{self.path}/_manifest")
        known = [0] if current is None else [current["version"]]
        if fs.exists(p):
            known += [int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json")]
        return max(known) + 1

    def rollback(self) -> int | None:
        """Back to the version before the current one; None when there is none."""
        m = self.manifest()
        if m is None or m["previous"] is None:
            return None
        self._write_small("_current", str(m["previous"]))
        return m["previous"]


def write_jdbc(df: DataFrame, jdbc, table: str, mode: str = "append", batch_size: int = 1000) -> None:
    """Rows into a database table through Spark's JDBC writer."""
    df.write.format("jdbc").options(**jdbc).option("dbtable", table).option("batchsize", str(batch_size)).mode(mode).save()
