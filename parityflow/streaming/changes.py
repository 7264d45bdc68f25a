"""Applying a stream of changed rows, and removing repeats from a stream."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parityflow.config import CompareConfig, MigrationConfig
from parityflow.operators.compare import diff
from parityflow.operators.dedupe import dedupe_last
from parityflow.plans.apply import result_table
from parityflow.plans.plan import DELETE, KEEP, action_counts, decide
from parityflow.sources.store import VersionedTable


def apply_batch(
    store: VersionedTable,
    batch: DataFrame,
    tag: str,
    order_by: Sequence[str],
    cfg: MigrationConfig = MigrationConfig(),
    delete_flag: str | None = None,
    on_progress: Callable[[DataFrame, str], None] | None = None,
) -> bool:
    """Put one batch of changes into the store; False when ``tag`` was applied before.

    A tag is ``<stream>-<number>``; of each stream the store keeps the last number, and a
    batch that is not beyond it was applied before. A NULL ``delete_flag`` keeps the row.

    Only the key buckets that occur in the batch are read and rewritten.
    ``delete_flag`` names a boolean column that marks rows to delete.
    """
    current = store.manifest()
    stream, _, number = tag.rpartition("-")
    done = json.loads(current["tag"]) if current is not None and current["tag"] else {}
    if number.isdigit() and stream in done and int(number) <= done[stream]:
        return False
    if not number.isdigit():
        stream, number = tag, "0"
        if tag in done:
            return False
    mark = json.dumps(done | {stream: int(number)})
    changes = dedupe_last(batch, store.keys, order_by)
    drop = [delete_flag] if delete_flag else []
    columns = [c for c in batch.columns if c not in drop]
    touched = sorted(r[0] for r in batch.select(store.bucket_of(batch)).distinct().collect())  # at most the number of buckets
    if current is not None and not touched:
        return False
    # the first batch goes the same way, against an empty table
    base = batch.select(*columns).limit(0) if current is None else store.read(touched)
    flagged = base.withColumn(delete_flag, F.lit(False)) if delete_flag else base
    compare = CompareConfig(keys=store.keys, ignore_columns=drop, keys_unique=True)
    decided = decide(diff(changes, flagged, compare), cfg)
    if delete_flag:
        gone = F.coalesce(F.col("source").getField(delete_flag), F.lit(False))
        here = F.col("target").isNotNull()
        decided = decided.withColumn("action", F.when(gone & here, F.lit(DELETE)).when(gone, F.lit(KEEP)).otherwise(F.col("action")))
    store.publish(result_table(decided, base.columns), None if current is None else touched, tag=mark)
    if on_progress is not None:
        on_progress(action_counts(decided), tag)
    return True


def apply_stream(
    changes: DataFrame,
    store: VersionedTable,
    checkpoint: str,
    order_by: Sequence[str],
    cfg: MigrationConfig = MigrationConfig(),
    delete_flag: str | None = None,
    on_progress: Callable[[DataFrame, str], None] | None = None,
    trigger: dict | None = None,
):
    """Start a query that applies every micro-batch to the store exactly once.

    The published version carries the last batch number of every stream, which its
    checkpoint names, so a batch that is replayed after a failure is recognised and
    skipped, and several streams may feed one store, one after the other.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            apply_batch(store, batch, f"{checkpoint.rstrip('/')}-{batch_id}", order_by, cfg, delete_flag, on_progress)
        finally:
            batch.unpersist()

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def dedupe_stream(events: DataFrame, keys: Sequence[str], ts: str, delay: str = "10 minutes") -> DataFrame:
    """The first of several events with one key; state is dropped once ``delay`` has passed."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))
