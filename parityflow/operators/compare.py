"""Row diff of two tables: inserted, updated, deleted, matched."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parityflow.config import CompareConfig
from parityflow.functions.equality import cell_text, values_equal
from parityflow.functions.hashing import row_fingerprint
from parityflow.functions.keys import CELLS_PER_ROW, join_key_columns, key_cells, marked_cells, q, resolve_keys
from parityflow.operators.align import align
from parityflow.operators.dedupe import TIE, keep_last, keep_last_counted, tie_break
from parityflow.session import materialised

INSERTED, UPDATED, DELETED, MATCHED = "inserted", "updated", "deleted", "matched"


def _prepared(
    df: DataFrame, keys: Sequence[str], cfg: CompareConfig, payload: Sequence[Column] | None = None, n_lost: str | None = None
) -> tuple[DataFrame, list[str]]:
    """Helper key columns added and one row left per key.

    ``payload`` replaces the columns that travel through the shuffle; ``n_lost`` names a column
    for the number of rows that each row's key has lost.
    """
    order = list(cfg.order_by)
    if unknown := [c for c in order if c not in df.columns]:
        raise ValueError(f"order_by names columns that the table lacks: {', '.join(unknown)}")
    out, names = join_key_columns(df, keys, cfg.keys_not_null)
    carried = list(payload) if payload is not None else [q(c) for c in df.columns]
    helpers = [q(n) for n in names]
    if cfg.keys_unique:
        return out.select(*carried, *helpers, *([F.lit(0).cast("long").alias(n_lost)] if n_lost else [])), names
    # order columns travel anyway with whole rows; next to a payload they are added
    extra = [f"__o{i}" for i in range(len(order))] if payload is not None else []
    ranks = [q(c).alias(n) for c, n in zip(order, extra)]
    out = out.select(*carried, *helpers, *ranks, tie_break(df, keys).alias(TIE))
    if n_lost:
        return keep_last_counted(out, names, [*(extra or order), TIE], n_lost).drop(*extra, TIE), names
    return keep_last(out, names, [*(extra or order), TIE]).drop(*extra, TIE), names


def _sided(df: DataFrame, side: str, names: Sequence[str]) -> DataFrame:
    """Prefix the data columns, keep the join keys under a side name."""
    return df.select(
        *[q(c).alias(f"{side}.{c}") for c in df.columns if c not in names],
        *[q(c).alias(f"{side}{c}") for c in names],
        F.lit(True).alias(f"{side}__present"),
    )


def _join_sides(s: DataFrame, t: DataFrame, names: Sequence[str]) -> DataFrame:
    condition = reduce(lambda a, b: a & b, [q(f"s{n}") == q(f"t{n}") for n in names])
    return _sided(s, "s", names).join(_sided(t, "t", names), condition, "full_outer")


def _classified(joined: DataFrame, shape: DataFrame, keys: Sequence[str], cfg: CompareConfig, more: Mapping[str, Column] | None = None) -> DataFrame:
    """Status, both rows and the changed columns from joined sides, and the columns ``more``."""
    in_s, in_t = q("s__present").isNotNull(), q("t__present").isNotNull()
    skip = set(keys) | set(cfg.ignore_columns)
    compared = [c for c in sorted(shape.columns) if c not in skip]
    types = {f.name: f.dataType for f in shape.schema}
    differs = {c: ~values_equal(q(f"s.{c}"), types[c], q(f"t.{c}"), types[c], cfg) for c in compared}
    any_differs = reduce(lambda a, b: a | b, differs.values(), F.lit(False))
    both = in_s & in_t
    status = (
        F.when(~in_t, F.lit(INSERTED))
        .when(~in_s, F.lit(DELETED))
        .when(any_differs, F.lit(UPDATED))
        .otherwise(F.lit(MATCHED))
    )
    changed = (
        F.array_compact(F.array(*[F.when(both & d, F.lit(c)) for c, d in differs.items()]))
        if differs
        else F.array().cast("array<string>")
    )
    row = sorted(shape.columns)
    return joined.select(
        status.alias("status"),
        *[F.when(in_s, q(f"s.{k}")).otherwise(q(f"t.{k}")).alias(k) for k in keys],
        F.when(in_s, F.struct(*[q(f"s.{c}").alias(c) for c in row])).alias("source"),
        F.when(in_t, F.struct(*[q(f"t.{c}").alias(c) for c in row])).alias("target"),
        changed.alias("changed_columns"),
        *[c.alias(name) for name, c in (more or {}).items()],
    )


def diff(source: DataFrame, target: DataFrame, cfg: CompareConfig = CompareConfig()) -> DataFrame:
    """One row per key: ``status, <keys>, source, target, changed_columns``.

    A single null-safe full outer join; each side is shuffled once, and the
    duplicate removal reuses that shuffle.  Columns nobody reads later are
    pruned down to the scan.
    """
    if cfg.use_hash_mode:
        return hash_diff(source, target, cfg)
    s, t = align(source, target)
    keys = resolve_keys(s.columns, cfg.keys)
    (s_one, names), (t_one, _) = _prepared(s, keys, cfg), _prepared(t, keys, cfg)
    return _classified(_join_sides(s_one, t_one, names), s, keys, cfg)


def diff_counted(source: DataFrame, target: DataFrame, cfg: CompareConfig = CompareConfig()) -> DataFrame:
    """``diff`` with ``source_lost`` and ``target_lost``: rows of the key that a later row of that side replaced.

    Winners and counts come from one aggregate per side, so each side is still shuffled once. The
    counts of a key that one side lacks are 0 there.
    """
    s, t = align(source, target)
    keys = resolve_keys(s.columns, cfg.keys)
    (s_one, names), (t_one, _) = _prepared(s, keys, cfg, n_lost="__lost"), _prepared(t, keys, cfg, n_lost="__lost")
    lost = {f"{side}_lost": F.coalesce(q(f"{side[0]}.__lost"), F.lit(0)) for side in ("source", "target")}
    return _classified(_join_sides(s_one, t_one, names), s, keys, cfg, lost)


def diff_summary_errors(source: DataFrame, target: DataFrame, cfg: CompareConfig = CompareConfig()) -> DataFrame:
    """One row: keys of every status, and as ``errors`` the rows of both sides that lost their key."""
    d = diff_counted(source, target, cfg)
    counts = [F.count_if(F.col("status") == status).alias(status) for status in (MATCHED, INSERTED, UPDATED, DELETED)]
    return d.agg(*counts, F.coalesce(F.sum(F.col("source_lost") + F.col("target_lost")), F.lit(0)).alias("errors"))


def hash_status(source: DataFrame, target: DataFrame, cfg: CompareConfig) -> DataFrame:
    """``status`` per key from row hashes only; ``updated`` may still be a false alarm
    when a numeric tolerance is set."""
    s, t = align(source, target)
    keys = resolve_keys(s.columns, cfg.keys)
    hashed = [c for c in s.columns if c not in keys and c not in cfg.ignore_columns]

    def narrow(df: DataFrame) -> tuple[DataFrame, list[str]]:
        # two plain longs travel in less than half the bytes of a struct
        fingerprint = row_fingerprint(df, hashed, cfg)
        halves = [fingerprint.getField(h).alias(f"__hash_{h}") for h in "ab"]
        return _prepared(df, keys, cfg, [*[q(k) for k in keys], *halves])

    (s_h, names), (t_h, _) = narrow(s), narrow(t)
    joined = _join_sides(s_h, t_h, names)
    in_s, in_t = q("s__present").isNotNull(), q("t__present").isNotNull()
    status = (
        F.when(~in_t, F.lit(INSERTED))
        .when(~in_s, F.lit(DELETED))
        .when((q("s.__hash_a") != q("t.__hash_a")) | (q("s.__hash_b") != q("t.__hash_b")), F.lit(UPDATED))
        .otherwise(F.lit(MATCHED))
    )
    return joined.select(
        status.alias("status"),
        *[F.when(in_s, q(f"s.{k}")).otherwise(q(f"t.{k}")).alias(k) for k in keys],
    )


def hash_diff(source: DataFrame, target: DataFrame, cfg: CompareConfig) -> DataFrame:
    """Two-step diff for wide rows.

    Step one ships only key and hash; its narrow result is written once.  Keys
    that are not plainly equal mark their cell, one of about eight for each, in
    a bitmap of at most 32 MB that every task gets.  Step two fetches the full
    rows of all keys in marked cells before anything is shuffled, so a side
    ships its open rows and few others.  Matched rows carry the key only, their
    ``source``/``target`` stay NULL, also where a tolerance makes rows of
    different hash equal, or where a cell is shared with an open key.
    """
    s, t = align(source, target)
    keys = resolve_keys(s.columns, cfg.keys)
    base = replace(cfg, use_hash_mode=False)
    status = materialised(hash_status(s, t, cfg))
    open_keys = status.filter(F.col("status") != MATCHED)
    cells = open_keys.count() * CELLS_PER_ROW
    marks = materialised(marked_cells(open_keys, keys, cells))

    def in_cells(df: DataFrame, marked: bool) -> DataFrame:
        return key_cells(df, keys, cells, marks).filter("__marked" if marked else "NOT __marked").select(*[q(c) for c in df.columns])

    matched = in_cells(status.filter(F.col("status") == MATCHED), marked=False)
    detail = diff(in_cells(s, marked=True), in_cells(t, marked=True), base)
    detail = detail.withColumns({side: F.when(F.col("status") != MATCHED, F.col(side)) for side in ("source", "target")})
    row_type, tgt_type = detail.schema["source"].dataType, detail.schema["target"].dataType
    quiet = matched.select(
        "status",
        *[q(k) for k in keys],
        F.lit(None).cast(row_type).alias("source"),
        F.lit(None).cast(tgt_type).alias("target"),
        F.array().cast("array<string>").alias("changed_columns"),
    )
    return detail.unionByName(quiet)


def expression_diff(
    source: DataFrame,
    target: DataFrame,
    match_on: Sequence[tuple[str, str]],
    cfg: CompareConfig = CompareConfig(),
) -> DataFrame:
    """Diff whose match is an expression instead of a column.

    ``match_on`` pairs one Spark SQL expression over the source with one over
    the target; rows match when every pair agrees (NULL agrees with NULL).  The
    expressions become key columns ``match_0 ..``, so it stays an equi-join and
    a hot match value is reduced before the shuffle like any duplicate key.
    """
    if not match_on:
        raise ValueError("match_on needs at least one pair of expressions")
    names = [f"match_{i}" for i in range(len(match_on))]
    s = source.select("*", *[F.expr(a).alias(n) for n, (a, _) in zip(names, match_on)])
    t = target.select("*", *[F.expr(b).alias(n) for n, (_, b) in zip(names, match_on)])
    return diff(s, t, replace(cfg, keys=names, use_hash_mode=False))


def append_rows(source: DataFrame, target: DataFrame, cfg: CompareConfig = CompareConfig()) -> DataFrame:
    """Source rows whose key the target lacks; reads only keys of the target."""
    keys = resolve_keys(source.columns, cfg.keys)
    s_keys, t_keys = align(source.select(*[q(k) for k in keys]), target.select(*[q(k) for k in keys]))
    types = {f.name: f.dataType for f in s_keys.schema}
    s = source.select(*[q(c).cast(types[c]).alias(c) if c in types else q(c) for c in source.columns])
    s_one, names = _prepared(s, keys, cfg)
    t_one, _ = join_key_columns(t_keys, keys, cfg.keys_not_null)
    t_one = t_one.select(*names) if cfg.keys_unique else t_one.select(*names).distinct()
    return s_one.join(t_one, names, "left_anti").select(*[q(c) for c in source.columns])


def diff_summary(d: DataFrame) -> DataFrame:
    """One row with the count of every status."""
    return d.agg(
        *[
            F.count_if(F.col("status") == status).alias(status)
            for status in (MATCHED, INSERTED, UPDATED, DELETED)
        ]
    )


def changed_column_frequency(d: DataFrame) -> DataFrame:
    """How many updated rows changed each column."""
    return (
        d.filter(F.col("status") == UPDATED)
        .select(F.explode("changed_columns").alias("column_name"))
        .groupBy("column_name")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def filter_status(d: DataFrame, *statuses: str) -> DataFrame:
    return d.filter(F.col("status").isin(*statuses))


def flat_rows(d: DataFrame) -> DataFrame:
    """The displayed row: source cells, or target cells for deleted rows."""
    fields = d.schema["source"].dataType.fieldNames()
    pick = F.when(F.col("status") == DELETED, F.col("target")).otherwise(F.col("source"))
    keys = [c for c in d.columns if c not in ("status", "source", "target", "changed_columns")]
    cells = [
        (pick.getField(f) if f not in keys else q(f)).alias(f) for f in fields
    ]
    return d.select(F.col("status"), F.col("changed_columns"), *cells)


def search_rows(df: DataFrame, text: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows in which any of ``columns`` contains ``text``, ignoring case."""
    if not text:
        return df
    types = {f.name: f.dataType for f in df.schema}
    names = list(columns) if columns is not None else [c for c in df.columns if c not in ("status", "changed_columns")]
    hits: list[Column] = [
        F.coalesce(F.lower(cell_text(q(c), types[c])).contains(text.lower()), F.lit(False)) for c in names
    ]
    return df.filter(reduce(lambda a, b: a | b, hits))


def row_similarity(
    s: dict[str, Column], t: dict[str, Column], types: dict, cfg: CompareConfig
) -> Column:
    """Share of the compared columns on which two rows agree (no columns: 1.0)."""
    names = [c for c in sorted(set(s) | set(t)) if c not in cfg.ignore_columns]
    if not names:
        return F.lit(1.0)
    hits = [
        F.when(values_equal(s[c], types[c], t[c], types[c], cfg), 1).otherwise(0) if c in s and c in t else F.lit(0)
        for c in names
    ]
    return reduce(lambda a, b: a + b, hits) / F.lit(float(len(names)))
