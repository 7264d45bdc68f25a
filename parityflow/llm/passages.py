"""Passages that repeat across documents, by MinHash banding of paragraphs.

A text is cut into paragraphs: short sentences go with the next sentence of at least
``LONG_SENTENCE`` words, and a line's end always cuts, so where a paragraph ends depends on its
last sentence alone and copies of a passage are cut alike wherever they stand. Paragraphs of
``LONG_SENTENCE`` words or more have a set of five-word shingles; in a run of shorter ones, such as
short lines, overlapping groups of about ``MIN_WORDS`` words have one, from each of them on.
``BANDS`` bands of ``ROWS`` minima find similar paragraphs (a pair at similarity 0.75 meets with
probability 0.96 at least). Of what meets, everything is compared first with one of its bucket by
exact Jaccard similarity; the links form clusters, and members of buckets that still hold several
clusters are compared with each other, in chunks.

Where a paragraph runs on into other text, phrases find the copy: of ``GAP`` neighbouring places
the one with the least hash gives its ``PHRASE`` words, so texts that share ``PHRASE + GAP - 1``
words share a phrase, and of a longer copy at most ``GAP - 1`` words at either end are in none.

Of a cluster or phrase that several documents hold, the words of the smallest id stay and the
others are marked. Marked words with fewer than ``LONG_SENTENCE`` words between them make one
passage, these words included, which is reported from ``MIN_WORDS`` words on.

Equal paragraphs are one node, so copies are never paired. Null or empty texts have no paragraphs;
rows with a null id are left out; rows that share an id are one document. Places are code points
of the row's text, the end exclusive. Empty tables give empty tables; extra columns are not
returned. Texts of more than ``BLOCK_BYTES`` are worked on in pieces, cut where a line or a long
sentence ends (at white space if there is neither); words are numbered through all pieces of a row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parityflow.llm.graph import Forest, components
from parityflow.llm.shingles import BLOCK_BYTES, WORDS, _PLACE, _SPACE, _hash_block, mix
from parityflow.session import materialised

LONG_SENTENCE = 8
MIN_WORDS = 30
PHRASE, GAP = 12, 8
BANDS, ROWS = 4, 2
THRESHOLD = 0.75
FILTER_BITS = 1 << 25
CHUNK_ROWS = 512  #: sets of a bucket that are compared at a time
BIN_ROWS = 10_000
_SEEDS = np.random.default_rng(11).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_IN_PHRASE = np.random.default_rng(13).integers(1, 1 << 63, PHRASE, dtype=np.uint64) | np.uint64(1)
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True
_SENTENCE_END = re.compile(rb"[.!?](?=[\x09-\x0D\x20])")


def _phrases(words: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of the phrases of rows of words."""
    n = len(words) - PHRASE + 1
    m = n - GAP + 1
    if m <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(PHRASE):
        total += words[i : i + n] * _IN_PHRASE[i]
    total = mix(total)
    least = total[:m].copy()
    for i in range(1, GAP):
        np.minimum(least, total[i : i + m], out=least)
    inside, chosen = row[:m] == row[len(row) - m :], np.zeros(n, bool)
    for i in range(GAP):
        chosen[i : i + m] |= inside & (total[i : i + m] == least)
    first = np.flatnonzero(chosen)
    return first, total[first]


class Paragraphs:
    """The long enough paragraphs of a block of texts and its words, as arrays."""

    def __init__(self, block: bytes, text_starts: np.ndarray):
        letters = np.frombuffer(block, np.uint8)
        words, start = _hash_block(block.lower())
        self.text = self.node = np.empty(0, np.int64)
        self.shingles, self.first = np.empty(0, np.uint64), np.empty(0, np.int64)
        text = np.searchsorted(text_starts, start, side="right") - 1
        self.in_text = np.bincount(text, minlength=len(text_starts))
        space = np.concatenate([_SPACE[letters], [True]])
        ends_at = np.flatnonzero(space[1:] & ~space[:-1]) + 1
        end = ends_at[np.searchsorted(ends_at, start, side="right")]
        points = np.concatenate([[0], np.cumsum((letters & 0xC0) != 0x80)])
        base = points[text_starts[text]]
        self.hashes, self.of, self.opens_at, self.closes_at = words, text, points[start] - base, points[end] - base
        n = len(words) - WORDS + 1
        if n <= 0:
            return
        lines = np.concatenate([[0], np.cumsum(letters == 10)])
        last = np.append((lines[end[:-1]] != lines[start[1:]]) | (text[1:] != text[:-1]), True)
        stop = _STOP[letters[end - 1]] | last
        sentence = np.cumsum(np.concatenate([[0], stop[:-1]]))
        length = np.bincount(sentence)
        cut = stop & (last | (length[sentence] >= LONG_SENTENCE))
        closes = np.flatnonzero(cut) + 1  # words before the end of each paragraph
        opens = np.append(0, closes[:-1])
        # short ones, each with those behind it, as far as no long one or other text follows
        short = closes - opens < LONG_SENTENCE
        ends_run = np.append(~short[1:] | (text[opens[1:]] != text[opens[:-1]]), True)
        begin = np.flatnonzero(short)
        run_end = np.flatnonzero(ends_run)
        group_end = closes[np.minimum(np.searchsorted(closes, opens[begin] + MIN_WORDS), run_end[np.searchsorted(run_end, begin)])]
        opens, closes = np.concatenate([opens[~short], opens[begin]]), np.concatenate([closes[~short], group_end])
        enough = closes - opens >= LONG_SENTENCE
        opens, closes = opens[enough], closes[enough]
        if not len(opens):
            return
        total = np.zeros(n, np.uint64)
        for i in range(WORDS):
            total += words[i : i + n] * _PLACE[i]
        sizes = closes - opens - WORDS + 1
        self.first = np.cumsum(sizes) - sizes
        self.shingles = mix(total)[np.arange(sizes.sum()) + np.repeat(opens - self.first, sizes)]
        self.text = text[opens]
        self.start, self.end = self.opens_at[opens], self.closes_at[closes - 1]
        self.at, self.words = opens - np.searchsorted(text, self.text), closes - opens
        self.node = mix(np.add.reduceat(mix(self.shingles), self.first) + self.words.astype(np.uint64)).view(np.int64)

    def signatures(self) -> np.ndarray:
        """One signature per paragraph and band."""
        bands = []
        for b in range(BANDS):
            sig = np.full(len(self.first), b + 1, np.uint64)
            for seed in _SEEDS[b * ROWS : (b + 1) * ROWS]:
                sig = mix(sig * np.uint64(31) + np.minimum.reduceat(mix(self.shingles ^ seed), self.first))
            bands.append(sig)
        return np.stack(bands, axis=1).view(np.int64)

    def sets(self) -> list[bytes]:
        return [np.unique(s).tobytes() for s in np.split(self.shingles, self.first[1:])] if len(self.first) else []


def _piece_end(data: bytes, at: int) -> int:
    """Where the piece that begins at ``at`` ends: at a place that ends a paragraph anyway, if there is one."""
    end = at + BLOCK_BYTES
    if end >= len(data):
        return len(data)
    line = data.rfind(b"\n", at + BLOCK_BYTES // 2, end)
    if line > 0:
        return line + 1
    stops = [m.end() for m in _SENTENCE_END.finditer(data, at + BLOCK_BYTES // 2, end)]
    for before, stop in zip(stops[-2::-1], stops[:0:-1]):
        if len(data[before:stop].split()) >= LONG_SENTENCE:
            return stop
    while end < len(data) and not _SPACE[data[end]]:
        end += 1
    return end


class Block:
    """Pieces of texts: their paragraphs, and for each piece the row's id and key and what of the row stands before it."""

    def __init__(self, pieces: list[tuple[bytes, int, int, int, bool]], seen: int, tail: np.ndarray):
        raw, ids, keys, points, more = zip(*pieces)
        self.paragraphs = Paragraphs(b"\n".join(raw), np.cumsum([0] + [len(r) + 1 for r in raw[:-1]]))
        self.ids, self.keys, self.points = (np.array(x, np.int64) for x in (ids, keys, points))
        self.words = np.zeros(len(raw), np.int64)
        for k, n in enumerate(self.paragraphs.in_text.tolist()):
            self.words[k] = seen if more[k] else 0
            seen = int(self.words[k]) + n
        self.seen = seen  # words of the last row up to here
        p = self.paragraphs
        row = np.cumsum(~np.array(more))
        at = np.arange(len(p.of)) - np.searchsorted(p.of, p.of) + self.words[p.of]
        lines = np.stack([p.hashes.view(np.int64), row[p.of], p.of, at, p.opens_at + self.points[p.of], p.closes_at + self.points[p.of]])
        if more[0]:  # phrases reach over from the piece before
            tail[1:3] = [[row[0]], [0]]
            lines = np.concatenate([tail, lines], axis=1)
        self.lines = lines
        self.tail = lines[:, lines[1] == row[-1]][:, -(PHRASE + GAP - 2) :].copy()

    def phrases(self) -> list[np.ndarray] | None:
        """Piece, number of the first word, words, start, finish and hash of the phrases."""
        hashes, row, of, at, start, finish = self.lines
        first, f = _phrases(hashes.view(np.uint64), row)
        last = first + PHRASE - 1
        return [of[first], at[first], np.full(len(first), PHRASE), start[first], finish[last], f.view(np.int64)] if len(first) else None


def _blocks(rows: Iterator[tuple[int, str | None, int]]) -> Iterator[Block]:
    """Blocks of about ``BLOCK_BYTES`` from rows of id, text and key."""
    held, size, seen, tail = [], 0, 0, None
    for i, t, key in rows:
        data, at, points = (t or "").encode(), 0, 0
        while at < len(data):
            end = _piece_end(data, at)
            piece = data[at:end]
            if held and size + len(piece) > BLOCK_BYTES:
                yield (block := Block(held, seen, tail))
                held, size, seen, tail = [], 0, block.seen, block.tail
            held.append((piece, i, key, points, at > 0))
            size += len(piece)
            at, points = end, points + len(piece.decode(errors="replace"))
    if held:
        yield Block(held, seen, tail)


def _columns(batches) -> Iterator[Block]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1_024):
            step = batch.slice(at, 1_024)
            yield from _blocks(zip(*(step.column(c).to_pylist() for c in ("id", "text", "key"))))


def _occurrences(batches):
    """``id, key, at, words, start, finish, f``."""
    for block in _columns(batches):
        p = block.paragraphs
        of = p.text
        paragraphs = [of, p.at + block.words[of], p.words, p.start + block.points[of], p.end + block.points[of], p.node] if len(p.node) else None
        parts = [x for x in (paragraphs, block.phrases()) if x is not None]
        if parts:
            of, *columns = (np.concatenate(c) for c in zip(*parts))
            columns = [block.ids[of], block.keys[of], *columns]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["id", "key", "at", "words", "start", "finish", "f"])


SIGN_ROWS = 200_000


def _sign(batches):
    """``sig, f`` of every distinct paragraph of a task, about."""
    held, count = [], 0

    def rows():
        sig, f = np.concatenate(held).T
        order = np.lexsort((f, sig))
        sig, f = sig[order], f[order]
        new = np.append(True, (sig[1:] != sig[:-1]) | (f[1:] != f[:-1]))
        yield from pa.table([pa.array(sig[new]), pa.array(f[new])], ["sig", "f"]).to_batches(max_chunksize=65_536)

    for p in (block.paragraphs for block in _columns(batches)):
        if not len(p.node):
            continue
        held.append(np.stack([p.signatures().reshape(-1), np.repeat(p.node, BANDS)], axis=1))
        count += len(held[-1])
        if count >= SIGN_ROWS:
            yield from rows()
            held, count = [], 0
    if held:
        yield from rows()


def _verify(batches):
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both >= THRESHOLD * (len(x) + len(y) - both))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _join_apart(table: pa.Table) -> pa.Table:
    """Links between different components within the cells of a bin, enough to join what is similar."""
    cells = table.column("cell").to_numpy()
    order = np.argsort(cells, kind="stable")
    starts = np.flatnonzero(np.diff(cells[order], prepend=cells[order][0] - 1))
    f, component, mine = (table.column(c).to_numpy() for c in ("f", "component", "mine"))
    sets = [np.frombuffer(v, np.uint64) for v in table.column("body").to_pylist()]
    forest, found = Forest(), []
    for start, end in zip(starts, [*starts[1:], len(order)]):
        here = order[start:end]
        right = here[mine[here] > 0]
        known = np.unique(np.concatenate([sets[j] for j in here.tolist()]))
        sizes = np.array([len(sets[j]) for j in right.tolist()])
        if not len(right):
            continue
        places = np.searchsorted(known, np.concatenate([sets[j] for j in right.tolist()]))
        first, has = np.cumsum(sizes) - sizes, np.zeros(len(known), np.int64)
        for i in here[mine[here] < 2].tolist():
            at = np.searchsorted(known, sets[i])
            has[at] = 1
            both = np.add.reduceat(has[places], first)
            has[at] = 0
            fit = both >= THRESHOLD * (sizes + len(sets[i]) - both)
            for j in right[fit & (component[right] != component[i])].tolist():
                if forest.root(int(component[i])) != forest.root(int(component[j])):
                    forest.join(int(component[i]), int(component[j]))
                    found.append((int(f[i]), int(f[j])))
    a, b = zip(*found) if found else ((), ())
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _filter_of(nodes: DataFrame) -> np.ndarray:
    """A filter of fixed size that ``f`` of the nodes passes; what else passes it goes with the join that follows."""
    place = F.pmod(F.col("f"), F.lit(FILTER_BITS)) + 1
    maps = nodes.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    bits = np.zeros((FILTER_BITS // 32_768 + 1, 4_096), np.uint8)
    for row in maps.collect():  # at most FILTER_BITS / 8 bytes
        bits[row.bucket - 1] = np.frombuffer(row.bits, np.uint8)
    return bits.reshape(-1)


def _passes(f: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = np.mod(f, FILTER_BITS)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def paragraph_clusters(docs: DataFrame) -> DataFrame:
    """``node, component`` of the paragraphs that have a similar one, from rows ``id, text, key``."""
    spark = docs.sparkSession
    signed = docs.mapInArrow(_sign, "sig long, f long")
    # the first set of a group stands for it; minima are combined in the tasks, so no group is collected
    heads = signed.groupBy("sig").agg(F.min("f").alias("a"), F.max("f").alias("z")).filter("a <> z")
    members = materialised(signed.join(heads, "sig").select("sig", "f", "a").distinct())
    pairs = materialised(members.filter("f <> a").select("a", F.col("f").alias("b")).distinct())
    nodes = pairs.select(F.col("a").alias("f")).union(pairs.select("b")).distinct()
    shared = spark.sparkContext.broadcast(_filter_of(nodes))

    def fetch(batches):
        known = shared.value
        for p in (block.paragraphs for block in _columns(batches)):
            if len(p.node):
                keep = _passes(p.node, known)
                rows = pa.RecordBatch.from_arrays([pa.array(p.node), pa.array(p.sets(), pa.binary())], ["f", "body"])
                yield rows.filter(pa.array(keep))

    bodies = docs.mapInArrow(fetch, "f long, body binary").groupBy("f").agg(F.first("body").alias("body")).join(nodes, "f", "left_semi")
    bodies = materialised(bodies)
    left, right = bodies.select(F.col("f").alias("a"), F.col("body").alias("x")), bodies.select(F.col("f").alias("b"), F.col("body").alias("y"))
    links = pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(_verify, "a long, b long")
    links = materialised(links)
    first = materialised(components(links))
    # buckets that one component holds are done, and so are pairs; in the others members are compared across components
    placed = members.join(first, F.col("f") == F.col("node"), "left").select("sig", "f", F.coalesce("component", "f").alias("component"))
    placed = materialised(placed)
    open_ = placed.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size")).filter("low <> high AND size > 2")
    open_ = open_.select("sig", F.ceil(F.col("size") / CHUNK_ROWS).cast("int").alias("chunks"))
    pending = materialised(placed.join(open_, "sig"))
    bins = max(64, (pending.agg(F.sum("chunks")).first()[0] or 0) // BIN_ROWS)
    rows = pending.withColumn("c", F.pmod(F.xxhash64("f"), "chunks").cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.withColumn("cell", F.xxhash64("sig", F.least("c", "o"), F.greatest("c", "o")))
    rows = rows.withColumn("mine", F.when(F.col("c") == F.col("o"), 1).when(F.col("c") < F.col("o"), 0).otherwise(2))
    rows = rows.join(bodies, "f").select("f", "component", "body", "cell", "mine", F.pmod("cell", F.lit(bins)).alias("bin"))
    more = materialised(rows.groupBy("bin").applyInArrow(_join_apart, "a long, b long"))
    return first if more.isEmpty() else components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))


def repeated_passages(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, start, finish, n_words, kept_doc_id, cluster_id``: the passages to remove."""
    spark = documents.sparkSession
    docs = documents.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).filter("id IS NOT NULL")
    docs = docs.withColumn("key", F.xxhash64("text"))  # rows that share an id are told apart by their text
    groups = paragraph_clusters(docs)
    schema = "id long, key long, at long, words long, start long, finish long, f long"
    holders = docs.mapInArrow(_occurrences, schema).groupBy("f").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    placed = holders.join(groups, F.col("f") == F.col("node"), "left").filter("component IS NOT NULL OR low <> high")
    placed = materialised(placed.select("f", "low", "high", "component"))
    clusters = placed.filter("component IS NOT NULL").select("f", F.col("component").alias("cluster"), "low", "high")
    shared_by = clusters.groupBy("cluster").agg(F.min("low").alias("kept"), F.max("high").alias("high")).filter("kept <> high")
    alone = placed.filter("component IS NULL").select("f", F.col("f").alias("cluster"), F.col("low").alias("kept"))
    doubled = materialised(alone.union(clusters.select("f", "cluster").join(shared_by, "cluster").select("f", "cluster", "kept")))
    repeated = spark.sparkContext.broadcast(_filter_of(doubled))

    def held_again(batches):
        for rows in _occurrences(batches):
            yield rows.filter(pa.array(_passes(rows.column("f").to_numpy(), repeated.value)))

    marked = docs.mapInArrow(held_again, schema).join(doubled, "f").filter("id <> kept")
    by_row = Window.partitionBy("id", "key").orderBy("at")
    before = F.max(F.col("at") + F.col("words")).over(by_row.rowsBetween(Window.unboundedPreceding, -1))
    opened = marked.withColumn("opens", F.when(F.col("at") < before + LONG_SENTENCE, 0).otherwise(1))
    runs = opened.withColumn("run", F.sum("opens").over(by_row.rowsBetween(Window.unboundedPreceding, 0))).groupBy("id", "key", "run").agg(
        F.min("start").alias("start"), F.max("finish").alias("finish"), (F.max(F.col("at") + F.col("words")) - F.min("at")).alias("n_words"), F.min("kept").alias("kept_doc_id"), F.min("cluster").alias("cluster_id")
    )
    return runs.filter(F.col("n_words") >= min_words).select(F.col("id").alias("doc_id"), "start", "finish", "n_words", "kept_doc_id", "cluster_id")
