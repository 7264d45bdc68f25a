"""Exact n-gram Jaccard join by the pigeonhole principle over a partitioned universe.

Two sets with a Jaccard similarity of 3/4 or more differ in at most ``(r + s) / 7`` elements. The
universe of shingles is dealt by hash into segments, as many as suit a band of set sizes, so a
set falls into subsets, and more subsets than can differ must hold an equal one. A set therefore
gives off as signatures one subset more than may differ. Which ones is a matter of cost:

* first subsets without frequent shingles (frequent in a bounded sample; this sways cost only),
* if these are too few, also their one-deletion neighbourhoods, as missing both takes two changes,
* if that is still too little, the subsets with frequent shingles.

Sets of under 64 shingles have one segment for every shingle. A set that may pair with one of
the next smaller band gives off signatures for that band too.

Sets with an equal signature are compared exactly: first everything with one of its group; what
this links is one component, and only groups that still hold several components are compared
further, in chunks. Before texts are compared, a parity sketch sorts out pairs that differ too
much, and pairs within a component that other pairs have made are left out. From a chunk no
pairs come: first the ids that have a possible pair, then, from the texts of these, links that
join components, fewer than there are components. Equal sets are
linked to the smallest of their ids beforehand and sign once in a task. No group is cut short.

Rows with null or empty text have an empty set and link with nothing; a null id links with
nothing and has no component. Rows that share an id are one document with several texts.
Empty tables give empty tables; extra columns are not returned. Shingles and sets are compared
by 64-bit hashes; signatures keep 48 bits, as a chance meeting costs a comparison only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parityflow.llm.graph import Forest, components
from parityflow.llm.shingles import mix, shingle_sets
from parityflow.session import materialised

SMALL_SET = 64  #: smaller sets have one segment per shingle
SAMPLE_DOCS = 5_000  #: documents in which shingles are counted, about
FREQUENT = 4  #: documents of the sample that make a shingle frequent
FREQUENT_SHINGLES = 65_536  #: most of them that are told to the tasks
SKETCH_BITS = 512  #: of the smallest sketches; larger sets have as many bits as elements, rounded up to a power of two
CHUNK_ROWS = 1_024  #: sets of a group that are compared at a time
BIN_ROWS = 20_000
BLOCK_NUMBERS = 1 << 19  #: 64-bit numbers of sketches that are compared at a time
CHUNK_SHINGLES = 4_000_000  #: of the texts of a bin that are held together
FILTER_BITS = 1 << 24  #: of the filter that keeps texts without candidates from being moved
STEP_TEXTS = 1_024


def most_changes(r: int, s: int) -> int:
    return (r + s) // 7


def similar(both: int, r: int, s: int) -> bool:
    return 100 * both >= 75 * (r + s - both)


def _roles(n: int) -> list[tuple[int, int]]:
    """Bands in which a set of ``n`` takes part, as the number of segments (0: one per shingle) and of signatures."""

    def segments(low: int) -> int:
        return 2 * low if low >= SMALL_SET else 0

    low = 1 << (n.bit_length() - 1)
    own = (segments(low), most_changes(n, 4 * n // 3) + 1)
    if low < SMALL_SET or -(-3 * n // 4) > low - 1:
        return [own]
    return [own, (segments(low // 2), most_changes(low - 1, n) + 1)]


def signatures(tokens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Signatures of one set of sorted shingle hashes."""
    places = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1) if len(frequent) else np.zeros(len(tokens), int)
    often = frequent[places] == tokens if len(frequent) else np.zeros(len(tokens), bool)
    out = []
    for segments, needed in _roles(len(tokens)):
        band = np.uint64(segments)
        if not segments:
            rare = mix(tokens[~often] + band)
            out.append(np.sort(rare)[:needed] if len(rare) >= needed else mix(tokens + band))
            continue
        segment = (tokens >> np.uint64(17)) % band
        order = np.argsort(segment, kind="stable")
        part, member, common = segment[order], tokens[order], often[order]
        start = np.flatnonzero(np.diff(part, prepend=np.uint64(1 << 63)))
        size = np.diff(start, append=len(part))
        total, hot = np.add.reduceat(member, start), np.add.reduceat(common.astype(np.int64), start)
        salt = mix(part[start] + (band << np.uint64(20)))
        exact = mix(total ^ salt)
        cheap = exact[hot == 0]
        if len(cheap) >= needed:
            out.append(np.sort(cheap)[:needed])
            continue
        group = np.repeat(np.arange(len(start)), size)
        fit = (size[group] > 1) & (hot[group] - common == 0)
        out += [cheap, mix((total[group] - member)[fit] ^ salt[group][fit])]
        supply = len(cheap) + int(((hot == 0) & (size > 1)).sum())
        if supply < needed:
            out.append(exact[hot > 0])
            supply += int((hot > 0).sum())
        if supply < needed:
            raise ValueError("the segments of a set are too few; its links could be lost")
    return np.unique(np.concatenate(out))


def fingerprint(tokens: np.ndarray) -> int:
    """One signed 64-bit number for a set."""
    return int(mix(np.array([mix(tokens).sum(dtype=np.uint64) + np.uint64(len(tokens))], np.uint64)).view(np.int64)[0])


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Steps of a batch with the shingle sets of its last column."""
    for at in range(0, batch.num_rows, STEP_TEXTS):
        step = batch.slice(at, STEP_TEXTS)
        yield step, list(shingle_sets(step.column(step.num_columns - 1).to_pylist()))


def _describe(batches):
    """``id, n, f`` of ``id, text``."""
    for batch in batches:
        for step, sets in _sets(batch):
            n, f = [len(s) for s in sets], [fingerprint(s) for s in sets]
            yield pa.RecordBatch.from_arrays([step.column(0), pa.array(n, pa.int64()), pa.array(f, pa.int64())], ["id", "n", "f"])


def _count_shingles(batches):
    for batch in batches:
        for _, sets in _sets(batch):
            token, n = np.unique(np.concatenate([*sets, np.empty(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n, pa.int64())], ["token", "n"])


def _grouped(sig: np.ndarray, f: np.ndarray):
    """Sorted by signature, then set: starts of the signatures, and the sets, without repeats."""
    order = np.lexsort((f, sig))
    sig, f = sig[order], f[order]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (f[1:] != f[:-1])
    sig, f = sig[new], f[new]
    start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.empty(0, int)
    return sig[start], start, np.diff(start, append=len(f)), f


SIGN_ROWS = 1_000_000  #: signatures that a task groups before it hands them on


SIGN_SETS = 1 << 16  #: sets that a task groups at most; their places fill the bits that a signature leaves free


def _packed(held: list[tuple[np.ndarray, int]]) -> Iterator[pa.RecordBatch]:
    """``sig, id, more`` of signatures and their ids, which ``held`` gives away.

    A signature and the place of its id are one number, so they are sorted where they lie.
    """
    ids, place = np.unique(np.array([x for _, x in held], np.int64), return_inverse=True)
    packed = np.concatenate([s for s, _ in held])
    place = np.repeat(place.astype(np.uint16), [len(s) for s, _ in held])
    held.clear()
    packed &= ~np.uint64(SIGN_SETS - 1)
    packed |= place
    del place
    packed.sort()
    new = np.ones(len(packed), bool)
    np.not_equal(packed[1:], packed[:-1], out=new[1:])
    packed = packed[new]
    ids = ids[(packed & np.uint64(SIGN_SETS - 1)).astype(np.uint16)]
    packed >>= np.uint64(16)
    first = np.ones(len(packed), bool)
    np.not_equal(packed[1:], packed[:-1], out=first[1:])
    ends = np.append(np.flatnonzero(first), len(packed))
    ends -= np.arange(len(ends))  # further ids before each signature
    columns = [pa.array(packed[first].view(np.int64)), pa.array(ids[first])]
    del packed
    valid = np.packbits(ends[1:] > ends[:-1], bitorder="little")
    parts = [pa.py_buffer(valid), pa.py_buffer((8 * ends).astype(np.int32)), pa.py_buffer(ids[~first])]
    table = pa.table([*columns, pa.Array.from_buffers(pa.binary(), len(ends) - 1, parts)], ["sig", "id", "more"])
    del ids, first, ends
    yield from table.to_batches(max_chunksize=65_536)


def _sign(frequent: np.ndarray):
    """``sig, id, more``: per task one row for each signature, further ids packed into ``more``."""

    def run(batches):
        held: list[tuple[np.ndarray, int]] = []
        count, known = 0, set()

        for batch in batches:
            for step, sets in _sets(batch):
                for own, tokens in zip(step.column(0).to_pylist(), sets):
                    if not len(tokens) or (f := fingerprint(tokens)) in known:
                        continue
                    if len(known) < SIGN_ROWS:
                        known.add(f)
                    held.append((signatures(tokens, frequent), own))
                    count += len(held[-1][0])
                if count >= SIGN_ROWS or len(held) > SIGN_SETS - STEP_TEXTS:
                    yield from _packed(held)
                    count = 0
        if held:
            yield from _packed(held)

    return run


def _meet(batches):
    """Of the signatures of a partition: pairs with the first set of a group, and members of larger groups."""
    sigs, sets = [], []
    for batch in batches:
        sig, f = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        sigs.append(sig)
        sets.append(f)
        more = batch.column(2)
        for i in np.flatnonzero(more.is_valid().to_numpy(zero_copy_only=False)):
            others = np.frombuffer(more[int(i)].as_py(), np.int64)
            sigs.append(np.full(len(others), sig[i]))
            sets.append(others)
    if not sigs:
        return
    sig, f = np.concatenate(sigs), np.concatenate(sets)
    del sigs, sets
    # most signatures come once and meet nothing
    order = np.argsort(sig)
    sig = sig[order]
    again = np.zeros(len(sig) + 1, bool)
    again[1:-1] = sig[1:] == sig[:-1]
    again = again[1:] | again[:-1]
    sig, f = sig[again], f[order[again]]
    del order, again
    if not len(sig):
        return
    keys, start, size, f = _grouped(sig, f)
    group = np.repeat(np.arange(len(keys)), size)
    many = size[group] > 1
    rest = np.flatnonzero(many & (np.arange(len(f)) != start[group]))
    pairs = np.unique(np.stack([f[start[group[rest]]], f[rest]], axis=1), axis=0) if len(rest) else np.empty((0, 2), np.int64)
    large = np.flatnonzero(size[group] > 2)
    # groups of the same sets are one group
    sums = np.add.reduceat(mix(f.view(np.uint64)), start)
    _, chosen = np.unique(sums, return_index=True)
    large = large[np.isin(group[large], chosen)]
    out = [(False, pairs[:, 0], pairs[:, 1]), (True, sums.view(np.int64)[group[large]], f[large])]
    for kind, a, b in out:
        yield from pa.table([pa.array(np.full(len(a), kind)), pa.array(a), pa.array(b)], ["large", "a", "b"]).to_batches(max_chunksize=65_536)


def _sketch(tokens: np.ndarray) -> bytes:
    """Parity of the set in each cell: two sketches differ in no more cells than the sets in elements."""
    bits = max(SKETCH_BITS, 1 << max(0, len(tokens) - 1).bit_length())
    counts = np.bincount(((tokens >> np.uint64(23)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def _fold(sketches: np.ndarray) -> np.ndarray:
    """The sketches of half the width."""
    half = sketches.shape[-1] // 2
    return sketches[..., :half] ^ sketches[..., half:]


def _differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cells in which sketches differ, at the smaller width."""
    while x.shape[-1] > y.shape[-1]:
        x = _fold(x)
    while y.shape[-1] > x.shape[-1]:
        y = _fold(y)
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def _possible(batches):
    """Pairs ``a, b`` of ``a, b, n1, n2, x, y`` that sizes and sketches leave possible."""
    for batch in batches:
        if not batch.num_rows:
            continue
        n1, n2 = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        x, y = ([np.frombuffer(v, np.uint64) for v in batch.column(i).to_pylist()] for i in (4, 5))
        differ = np.array([int(_differ(p, q)) for p, q in zip(x, y)])
        fit = (4 * np.minimum(n1, n2) >= 3 * np.maximum(n1, n2)) & (differ <= (n1 + n2) // 7)
        yield batch.select([0, 1]).filter(pa.array(fit))


def _fetch(bits: np.ndarray, sketch: bool):
    """``id, n, body`` (texts, or sketches with the sizes of their sets) of ``id, place, text`` where the filter has ``place``."""

    def run(batches):
        for batch in batches:
            place = batch.column(1).to_numpy(zero_copy_only=False)
            keep = (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1
            wanted = batch.filter(pa.array(keep.astype(bool)))
            if not sketch:
                none = pa.nulls(wanted.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([wanted.column(0), none, wanted.column(2).cast(pa.binary())], ["id", "n", "body"])
                continue
            for step, sets in _sets(wanted):
                columns = [step.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_sketch(s) for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n", "body"])

    return run


def _verify(batches):
    """Pairs ``a, b`` of ``a, b, x, y`` whose texts have similar sets."""
    last = (None, None)  # pairs with one text come together
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3)):  # texts of a batch are taken one by one, as together they are large
            if last[0] != (x := x.as_py()):
                last = (x, next(shingle_sets([x.decode()])))
            x, y = last[1], next(shingle_sets([y.as_py().decode()]))
            r, s = sorted((len(x), len(y)))
            keep.append(4 * r >= 3 * s and similar(len(np.intersect1d(x, y, assume_unique=True)), r, s))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _by_width(sketches: list[bytes]) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """Width of every sketch, its row among those of that width, and these as one array a width."""
    width = np.array([len(v) // 8 for v in sketches], np.int64)
    row, tables = np.zeros(len(width), np.int64), {}
    for w in np.unique(width).tolist():
        here = np.flatnonzero(width == w)
        row[here] = np.arange(len(here))
        tables[w] = np.frombuffer(b"".join([sketches[i] for i in here.tolist()]), np.uint64).reshape(-1, w)
    return width, row, tables


def _near(rows: np.ndarray, mine: np.ndarray, ids: np.ndarray, n: np.ndarray, component: np.ndarray, sketches, done=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs ``i, j`` among ``rows`` of a cell, of different components, that sizes and sketches leave possible, block by block.

    Pairs of two rows marked in ``done`` when their block comes are left out.
    """
    width, row, tables = sketches
    left, right = rows[mine[rows] < 2], rows[mine[rows] > 0]
    for v in np.unique(width[left]).tolist():
        a = left[width[left] == v]
        for w in np.unique(width[right]).tolist():
            if not w // 2 <= v <= 2 * w:  # sizes too far apart
                continue
            b = right[width[right] == w]
            x, y = tables[v][row[a]], tables[w][row[b]]
            x, y = _fold(x) if v > w else x, _fold(y) if w > v else y
            step = max(1, BLOCK_NUMBERS // (len(b) * x.shape[1]))
            for at in range(0, len(a), step):
                i = a[at : at + step, None]
                fit = (component[i] != component[b]) & (4 * np.minimum(n[i], n[b]) >= 3 * np.maximum(n[i], n[b])) & ((mine[i] == 0) | (ids[i] < ids[b]))
                if done is not None:
                    fit &= ~(done[i] & done[b])
                p, q = np.nonzero(fit)
                i, j = a[at + p], b[q]
                few = np.bitwise_count(x[at + p] ^ y[q]).sum(axis=1, dtype=np.int64) <= (n[i] + n[j]) // 7
                if few.any():
                    yield i[few], j[few]


def _compare(table: pa.Table) -> pa.Table:
    """``bin, id, n`` once for every id of a bin with a pair, within a cell, that its sketches leave possible."""
    cells = table.column("cell").to_numpy()
    order = np.argsort(cells, kind="stable")
    starts = np.flatnonzero(np.diff(cells[order], prepend=cells[order][0] - 1))
    ids, n, component, mine = (table.column(c).to_numpy() for c in ("id", "n", "component", "mine"))
    sketches = _by_width(table.column("body").to_pylist())
    own, code = np.unique(ids, return_inverse=True)
    found, done = np.zeros(len(own), bool), np.zeros(len(ids), bool)
    for start, end in zip(starts, [*starts[1:], len(order)]):
        here = order[start:end]
        done[here] = found[code[here]]
        for i, j in _near(here, mine, ids, n, component, sketches, done):
            found[code[i]] = found[code[j]] = True
            done[i] = done[j] = True
    size = np.zeros(len(own), np.int64)
    np.maximum.at(size, code, n)
    bin_ = np.full(int(found.sum()), table.column("bin")[0].as_py(), np.int64)
    return pa.table([pa.array(bin_), pa.array(own[found]), pa.array(size[found])], ["bin", "id", "n"])


def _join(table: pa.Table) -> pa.Table:
    """Links ``a, b`` enough to join the components that similar texts of a cell join: fewer than it has components."""
    sets = list(shingle_sets([v.decode() for v in table.column("body").to_pylist()]))
    ids, component, mine = (table.column(c).to_numpy() for c in ("id", "component", "mine"))
    n = np.array([len(s) for s in sets], np.int64)
    rows, forest, a, b = np.flatnonzero(n), Forest(), [], []
    for left, right in _near(rows, mine, ids, n, component, _by_width([_sketch(s) for s in sets])):
        order = np.argsort(left, kind="stable")
        left, right = left[order], right[order]
        cuts = np.flatnonzero(np.diff(left)) + 1
        for i, others in zip(left[[0, *cuts]].tolist(), np.split(right, cuts)):
            at = forest.root(int(component[i]))
            others = [j for j in others.tolist() if forest.root(int(component[j])) != at]
            if not others:
                continue
            x, y = sets[i], np.concatenate([sets[j] for j in others])
            both = x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y
            both = np.add.reduceat(both.astype(np.int64), np.cumsum([0, *n[others[:-1]]]))
            for j, k in zip(others, both.tolist()):
                if similar(k, len(x), len(sets[j])) and forest.root(int(component[i])) != forest.root(int(component[j])):
                    forest.join(int(component[i]), int(component[j]))
                    a.append(int(ids[i]))
                    b.append(int(ids[j]))
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _wanted_texts(docs: DataFrame, ids: DataFrame, sketch: bool) -> DataFrame:
    """``id, n, body`` of the documents in ``ids``.

    A filter of fixed size, summed up in the tasks, tells which texts to look at; what passes it
    by chance goes with the join, so it sways cost only.
    """
    wanted = materialised(ids.distinct())
    place = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    # bitmap positions and buckets count from one
    maps = wanted.select((place + 1).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    bits = np.zeros((FILTER_BITS // 32_768 + 1, 4_096), np.uint8)
    for row in maps.collect():  # at most FILTER_BITS / 8 bytes
        bits[row.bucket - 1] = np.frombuffer(row.bits, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bits.reshape(-1))
    fetch = lambda batches: _fetch(shared.value, sketch)(batches)
    bodies = docs.select("id", place.alias("place"), "text").mapInArrow(fetch, "id long, n long, body binary")
    return bodies.join(wanted, "id", "left_semi")


def _links(pairs: DataFrame, docs: DataFrame, known: DataFrame) -> DataFrame:
    """Links enough to join what the similar ones of the pairs ``a, b`` join, added to ``known`` links.

    One pair of every document is compared first; of the others only those that join components.
    """
    first = known.union(_compared(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), docs))
    groups = components(first)
    of_a, of_b = (groups.select(F.col("node").alias(f"n{x}"), F.col("component").alias(f"c{x}")) for x in "ab")
    placed = pairs.join(of_a, F.col("a") == F.col("na"), "left").join(of_b, F.col("b") == F.col("nb"), "left")
    apart = placed.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    return materialised(first.union(_compared(materialised(apart), docs)))


def _compared(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose texts have similar sets."""
    bodies = _wanted_texts(docs, pairs.select(F.col("a").alias("id")).union(pairs.select("b")), sketch=False)
    left, right = bodies.select(F.col("id").alias("a"), F.col("body").alias("x")), bodies.select(F.col("id").alias("b"), F.col("body").alias("y"))
    return materialised(pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(_verify, "a long, b long"))


def _joined(likely: DataFrame, docs: DataFrame, groups: DataFrame) -> DataFrame:
    """Links ``a, b`` that join the components of the ids of a bin in ``likely`` whose texts have similar sets.

    The ids of a bin are dealt into chunks by the size of their sets, and each two chunks are compared in a cell.
    """
    bins = likely.groupBy("bin").agg(F.ceil(F.sum("n") / CHUNK_SHINGLES).cast("int").alias("chunks"))
    texts = _wanted_texts(docs, likely.select("id"), sketch=False).select("id", "body")
    held = likely.join(bins, "bin").join(groups, F.col("id") == F.col("node"), "left").select("bin", "chunks", "id", F.coalesce("component", "id").alias("component"))
    held = held.withColumn("c", F.pmod(F.xxhash64("id"), "chunks").cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    held = held.withColumn("cell", F.xxhash64("bin", F.least("c", "o"), F.greatest("c", "o")))
    held = held.withColumn("mine", F.when(F.col("c") == F.col("o"), 1).when(F.col("c") < F.col("o"), 0).otherwise(2))
    return held.join(texts, "id").select("id", "component", "body", "cell", "mine").groupBy("cell").applyInArrow(_join, "a long, b long")


def jaccard_components(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row."""
    spark = documents.sparkSession
    every = documents.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    sets = materialised(every.mapInArrow(_describe, "id long, n long, f long"))
    docs, full = every.filter("id IS NOT NULL AND text IS NOT NULL"), sets.filter("id IS NOT NULL AND n > 0")
    copies = full.join(full.groupBy("f").agg(F.min("id").alias("first")), "f").filter("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    share = min(1.0, SAMPLE_DOCS / max(1, full.count()))
    sampled = docs.filter(F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(1_000_000)) < int(share * 1_000_000))
    counts = sampled.mapInArrow(_count_shingles, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT)
    top = counts.orderBy(F.desc("n"), "token").limit(FREQUENT_SHINGLES).select("token").toArrow()
    shared = spark.sparkContext.broadcast(np.sort(top.column(0).to_numpy().astype(np.int64).view(np.uint64)))
    signed = docs.mapInArrow(lambda batches: _sign(shared.value)(batches), "sig long, id long, more binary")
    met = materialised(signed.repartition("sig").mapInArrow(_meet, "large boolean, a long, b long"))
    pairs = materialised(met.filter("NOT large").select("a", "b").distinct())
    sketches = materialised(_wanted_texts(docs, pairs.select(F.col("a").alias("id")).union(pairs.select("b")), sketch=True))
    left, right = (sketches.select(F.col("id").alias(i), F.col("n").alias(n), F.col("body").alias(body)) for i, n, body in (("a", "n1", "x"), ("b", "n2", "y")))
    compared = pairs.join(right, "b").join(left, "a").select("a", "b", "n1", "n2", "x", "y")
    likely = materialised(compared.mapInArrow(_possible, "a long, b long").distinct())
    links = _links(likely, docs, materialised(copies))
    first = materialised(components(links))
    # groups that one component holds are done; the others are compared across components
    members = met.filter("large").select(F.col("a").alias("grp"), F.col("b").alias("id")).distinct()
    placed = members.join(first, F.col("id") == F.col("node"), "left").select("grp", "id", F.coalesce("component", "id").alias("component"))
    placed = materialised(placed)
    open_ = placed.groupBy("grp").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("id").alias("family"), F.count(F.lit(1)).alias("size")).filter("low <> high")
    # groups with one smallest set hold many pairs in common: they share bins, as many as their rows ask for, and a bin gives off a pair once
    open_ = open_.withColumn("chunks", F.ceil(F.col("size") / CHUNK_ROWS).cast("int"))
    families = open_.groupBy("family").agg(F.ceil(F.sum(F.col("size") * F.col("chunks")) / BIN_ROWS).alias("slices"))
    open_ = open_.join(families, "family").select("grp", "family", "slices", "chunks")
    pending = materialised(placed.join(open_, "grp"))
    rows = pending.join(sketches, "id").withColumn("c", F.pmod(F.xxhash64("id"), "chunks").cast("int"))
    celled = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    celled = celled.withColumn("cell", F.xxhash64("grp", F.least("c", "o"), F.greatest("c", "o")))
    celled = celled.withColumn("mine", F.when(F.col("c") == F.col("o"), 1).when(F.col("c") < F.col("o"), 0).otherwise(2))
    bins = max(64, pending.count() // BIN_ROWS)
    slot = F.xxhash64("family", F.pmod("cell", "slices"))
    binned = celled.select("id", "n", "component", "body", "cell", "mine", F.pmod(slot, F.lit(bins)).alias("bin"))
    # what sketches leave possible goes by its ids to a second step, which compares the sets themselves and gives off links between components only
    likely = materialised(binned.groupBy("bin").applyInArrow(_compare, "bin long, id long, n long"))
    # written first, as components() starts in Python too and a task would have two workers, each with texts it has held
    groups = first if likely.isEmpty() else components(first.filter("node <> component").union(materialised(_joined(likely, docs, first))))
    joined = sets.join(groups, F.col("id") == F.col("node"), "left")
    return joined.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
