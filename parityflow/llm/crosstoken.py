"""Alignment of two tokenizers over the same text: a byte-level BPE (A) and a piece model (B).

The byte offsets where tokens of both end cut a text into groups. They are found by divide and
conquer: the first shared end at or behind the middle of an interval is located by bisecting
the ends of B and of A in turn; what lies before the middle and what lies behind the shared end
are then searched the same way. An interval without a shared end is part of one group. All
intervals of a level are searched together, so each level is a few array operations.

``align_tokens`` gives the groups themselves. ``linked_counts`` adds how often the linked id
pairs of a document occur in the corpus. Its texts are dealt into blocks; a block holds each of
its pairs once, with the number of its documents that hold it linked, so the corpus-wide sums
and their way back to the documents move pairs of blocks, not of documents. A pair that every
document holds costs one row a block.

Strings of special tokens in a text are plain text. Null and empty texts, and texts whose tokens
do not spell space + text byte for byte, have no tokens: counts are 0, lists and digests empty.
Rows are texts of their own: rows that repeat each count as a document, null ids stay. An empty
table gives an empty table. ``align_tokens`` passes other columns through unless they bear the
name of an output column; ``linked_counts`` reads id and text only.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parityflow.llm.bpe import WORD_PATTERN, byte_letters
from parityflow.session import materialised

BLOCK_CHARS = 4_000_000  #: characters of a block; one longer text is a block of its own
BATCH_CHARS = 500_000  #: characters aligned at a time
WIDE_GROUP = 64  #: links of a group from which its ids are counted before they are paired


class ByteTokens:
    """Ids of space + text by the byte-level vocabulary, special strings being plain text."""

    def __init__(self, content: bytes):
        import tiktoken
        from tokenizers import Tokenizer

        model, byte_of = json.loads(content)["model"], {c: b for b, c in enumerate(byte_letters())}
        added = {t["content"] for t in json.loads(content)["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in added}
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        made = [model["vocab"][a + b] for a, b in pairs]
        self.size = 1 + max(ranks.values())
        self.of = [b""] * self.size
        for raw, i in ranks.items():
            self.of[i] = raw
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_str(content.decode())
        self.library.encode_special_tokens = True
        # ids that rise with the merge ranks are ranks themselves
        fast = made == sorted(set(made)) and 256 + len(made) == len(ranks)
        self.fast = tiktoken.Encoding("ranks", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={}) if fast else None

    def encode(self, texts: list[str]) -> list[list[int]]:
        """``texts`` begin with their space already."""
        out: list = [None] * len(texts)
        rest = []
        for i, t in enumerate(texts):
            # the two libraries agree on letters of these scripts; very long runs of white space are left to the slower one
            if self.fast and (t.isascii() or max(t) < "՘") and not _long_space(t):
                out[i] = self.fast.encode_ordinary(t)
            else:
                rest.append(i)
        for i in rest:
            out[i] = self.library.encode(texts[i], add_special_tokens=False).ids
        return out


_long_space = re.compile(r"\s{1000}").search


class PieceTokens:
    """Ids of a text by the piece model, which adds the space itself."""

    def __init__(self, content: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=content)
        self.size = self.model.get_piece_size()
        self.of = [
            bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(self.model.id_to_piece(list(range(self.size))))
        ]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.model.encode(t) for t in texts]


def shared_ends(a_ends: np.ndarray, b_ends: np.ndarray, a_from: np.ndarray) -> np.ndarray:
    """Places in ``a_ends`` whose offset is in ``b_ends`` too, in order.

    ``a_from`` splits ``a_ends`` into the texts; the last end of each text is shared.
    """
    low, high = a_from[:-1], a_from[1:]
    some = low < high
    low, high, found = low[some], high[some], []
    while len(low):
        middle = (low + high) // 2
        at, hit, open_ = middle.copy(), np.full(len(low), -1), np.arange(len(low))
        while len(open_):
            mine = a_ends[at[open_]]
            other = b_ends[np.searchsorted(b_ends, mine)]
            same = other == mine
            hit[open_[same]] = at[open_[same]]
            open_, other = open_[~same], other[~same]
            nearest = np.searchsorted(a_ends, other)
            inside = nearest < high[open_]
            open_ = open_[inside]
            at[open_] = nearest[inside]
        cut = hit >= 0
        found.append(hit[cut])
        # between the middle and the shared end nothing is shared, so that stretch is settled
        low, high = np.concatenate([low, hit[cut] + 1]), np.concatenate([middle, high[cut]])
        some = low < high
        low, high = low[some], high[some]
    return np.sort(np.concatenate(found)) if found else np.empty(0, np.int64)


class Groups:
    """Tokens of a batch of texts, end to end, and the groups that the shared ends cut."""

    def __init__(self, texts: list[str | None], a: ByteTokens, b: PieceTokens):
        whole = [" " + t if t else "" for t in texts]
        some = [i for i, t in enumerate(texts) if t]
        self.a_ids: list[list[int]] = [[] for _ in texts]
        self.b_ids: list[list[int]] = [[] for _ in texts]
        for i, mine, other in zip(some, a.encode([whole[i] for i in some]), b.encode([texts[i] for i in some])):
            raw = whole[i].encode()
            if b"".join(map(a.of.__getitem__, mine)) == raw and b"".join(map(b.of.__getitem__, other)) == raw:
                self.a_ids[i], self.b_ids[i] = mine, other
        self.n_a, self.n_b = (np.array([len(x) for x in ids], np.int64) for ids in (self.a_ids, self.b_ids))
        self.a, self.b = (np.fromiter((i for x in ids for i in x), np.int64) for ids in (self.a_ids, self.b_ids))
        a_ends, b_ends = (np.cumsum(_widths(t)[ids]) for t, ids in ((a, self.a), (b, self.b)))
        self.a_from = np.concatenate([[0], np.cumsum(self.n_a)])
        self.b_from = np.concatenate([[0], np.cumsum(self.n_b)])
        cuts = shared_ends(a_ends, b_ends, self.a_from)
        # of every group: the place behind its last A and B token
        self.a_to = cuts + 1
        self.b_to = np.searchsorted(b_ends, a_ends[cuts]) + 1
        self.group_from = np.searchsorted(self.a_to, self.a_from, side="right")  # groups that end before each text

    def sizes(self) -> tuple[np.ndarray, np.ndarray]:
        """A and B tokens of every group."""
        return np.diff(self.a_to, prepend=0), np.diff(self.b_to, prepend=0)

    def links(self, a_size: int, b_size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, id pair (A << 32 | B) and number of links, each pair once a text, in that order."""
        ka, kb = self.sizes()
        a_at, b_at = self.a_to - ka, self.b_to - kb
        text_of = np.repeat(np.arange(len(self.n_a)), np.diff(self.group_from))
        bits_b, bits_a = int(b_size).bit_length(), int(a_size).bit_length()
        product = ka * kb
        narrow = np.flatnonzero(product <= WIDE_GROUP)
        total = product[narrow]
        group = np.repeat(narrow, total)
        inner = np.arange(len(group)) - np.repeat(np.cumsum(total) - total, total)
        keys = [(text_of[group] << bits_a | self.a[a_at[group] + inner // kb[group]]) << bits_b | self.b[b_at[group] + inner % kb[group]]]
        times = [np.ones(len(group), np.int64)]
        for g in np.flatnonzero(product > WIDE_GROUP):
            x, nx = np.unique(self.a[a_at[g] : a_at[g] + ka[g]], return_counts=True)
            y, ny = np.unique(self.b[b_at[g] : b_at[g] + kb[g]], return_counts=True)
            keys.append((((text_of[g] << bits_a | x) << bits_b)[:, None] | y).ravel())
            times.append(np.outer(nx, ny).ravel())
        key, weight = np.concatenate(keys), np.concatenate(times)
        if len(times) == 1:
            key, weight = np.unique(key, return_counts=True)
        else:
            order = np.argsort(key, kind="stable")
            key, weight = key[order], weight[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            key, weight = key[first], np.add.reduceat(weight, first) if len(first) else weight
        pair = key & ((1 << (bits_a + bits_b)) - 1)
        return key >> (bits_a + bits_b), (pair >> bits_b) << 32 | pair & ((1 << bits_b) - 1), weight

    def spelled(self) -> list[str]:
        """``a1,a2|b1;a3|b2`` of every text: decimal ids, groups in order."""
        ka, kb = self.sizes()
        # every token's place in the written order: A tokens of a group, then its B tokens
        a_place = np.arange(len(self.a)) + np.repeat(self.b_to - kb, ka)
        b_place = np.arange(len(self.b)) + np.repeat(self.a_to, kb)
        code = np.empty(len(self.a) + len(self.b), np.int64)
        code[a_place], code[b_place] = self.a * 3, self.b * 3
        code[a_place[self.a_to - 1]] += 1
        code[b_place[self.b_to - 1]] += 2
        words = _words(int(code.max()) // 3 + 1 if len(code) else 1)
        parts = list(map(words.__getitem__, code.tolist()))
        ends = self.a_from + self.b_from
        return ["".join(parts[x:y])[:-1] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]


@functools.lru_cache(2)
def _words(n: int) -> list[str]:
    return [f"{i}{mark}" for i in range(1 << max(0, n - 1).bit_length()) for mark in ",|;"]


def _widths(tokens: ByteTokens | PieceTokens) -> np.ndarray:
    if not hasattr(tokens, "widths"):
        tokens.widths = np.array([len(raw) for raw in tokens.of], np.int64)
    return tokens.widths


_loaded: dict[str, tuple[ByteTokens, PieceTokens]] = {}


def worker_tokens(vocabulary: bytes, pieces: bytes) -> tuple[ByteTokens, PieceTokens]:
    """The tokenizers of a Python worker, kept for its later tasks."""
    key = hashlib.sha256(vocabulary + pieces).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = ByteTokens(vocabulary), PieceTokens(pieces)
    return _loaded[key]


def _batches(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[str | None], int]]:
    """Slices of about ``BATCH_CHARS`` characters, their texts and characters."""
    for batch in batches:
        start, chars, texts = 0, 0, []
        for i in range(batch.num_rows):
            text = batch.column(column)[i].as_py()
            texts.append(text)
            chars += len(text or "")
            if chars >= BATCH_CHARS or i + 1 == batch.num_rows:
                yield batch.slice(start, i + 1 - start), texts, chars
                start, chars, texts = i + 1, 0, []


def align_tokens(docs: DataFrame, vocabulary: bytes, pieces: bytes, text: str = "text") -> DataFrame:
    """Add ``a_ids``, ``b_ids`` and the groups: ``a_to`` and ``b_to`` count the tokens up to the end of each."""
    names = ("a_ids", "b_ids", "a_to", "b_to")
    kept = [c for c in docs.columns if c.lower() not in names]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(n, T.ArrayType(T.IntegerType())) for n in names])
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = worker_tokens(*shared.value)
        for part, texts, _ in _batches(batches, len(kept)):
            g = Groups(texts, a, b)
            spans = list(zip(g.group_from[:-1], g.group_from[1:]))
            ends = [[(to[x:y] - before[i]).tolist() for i, (x, y) in enumerate(spans)] for to, before in ((g.a_to, g.a_from), (g.b_to, g.b_from))]
            made = [pa.array(x, pa.list_(pa.int32())) for x in (g.a_ids, g.b_ids, *ends)]
            yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *made], [*kept, *names])

    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("__text")).mapInArrow(run, schema)


BLOCKS = (
    "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "steps binary, times binary, pairs array<long>, holders array<int>"
)
COUNTED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class _Block:
    """Texts of a block until it is written: a row a text, and one row of the block's pairs."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.pairs: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, ids: list, g: Groups, a_size: int, b_size: int) -> None:
        ka, kb = g.sizes()
        links = np.concatenate([[0], np.cumsum(ka * kb)])[g.group_from]
        digests = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in g.spelled()]
        self.rows += zip(ids, g.n_a.tolist(), g.n_b.tolist(), np.diff(g.group_from).tolist(), np.diff(links).tolist(), digests)
        text, pair, times = g.links(a_size, b_size)
        bounds = np.searchsorted(text, np.arange(1, len(ids)))
        self.pairs += np.split(pair, bounds)
        self.times += np.split(times, bounds)

    def batch(self, block: int) -> pa.RecordBatch:
        every = np.concatenate(self.pairs)
        known, place, holders = np.unique(every, return_inverse=True, return_counts=True)
        bounds = np.cumsum([len(p) for p in self.pairs])[:-1]
        # a text's places rise, so their steps are small numbers that compress well
        steps = [np.diff(p, prepend=0).astype("<u4").tobytes() for p in np.split(place, bounds)]
        n, columns = len(self.rows), list(zip(*self.rows))
        ints = [pa.array([*c, None], pa.int64()) for c in columns[:5]]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([block] * (n + 1), pa.int64()), *ints, pa.array([*columns[5], None], pa.string()),
                pa.array([*steps, None], pa.binary()), pa.array([*(t.astype("<i8").tobytes() for t in self.times), None], pa.binary()),
                pa.array([None] * n + [known.tolist()], pa.list_(pa.int64())), pa.array([None] * n + [holders.tolist()], pa.list_(pa.int32())),
            ],
            ["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "steps", "times", "pairs", "holders"],
        )


def _counted(docs: pa.Table, looked: pa.Table) -> pa.Table:
    """Sums over the links of each text of a block from the counts of the block's pairs."""
    place = looked.column("place").to_numpy()
    n, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    n[place], best[place] = looked.column("n").to_numpy(), looked.column("best").to_numpy(zero_copy_only=False)
    sums, bests = [], []
    for steps, times in zip(docs.column("steps"), docs.column("times")):
        at, k = np.cumsum(np.frombuffer(steps.as_buffer(), "<u4"), dtype=np.int64), np.frombuffer(times.as_buffer(), "<i8")
        sums.append(int(n[at] @ k))
        bests.append(int(best[at] @ k))
    out = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    out = out.append_column("n_best", pa.array(bests, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))
    return out.append_column("groups_sha256", docs.column("groups_sha256").cast(pa.string()))


def pair_counts(dictionary: DataFrame) -> DataFrame:
    """``pair, n, best``: the documents that hold each pair linked, and whether no pair of its A id has more.

    An A id meets at most as many B ids as that vocabulary holds, which bounds the groups of the window.
    """
    counts = dictionary.groupBy("pair").agg(F.sum("holders").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.shiftright("pair", 32)))
    return counts.select("pair", "n", (F.col("n") == most).cast("int").alias("best"))


def linked_counts(docs: DataFrame, vocabulary: bytes, pieces: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: tokens, groups and links, ``n_best`` and ``count_sum`` over its links, and a digest of its groups."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, pieces))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = worker_tokens(*shared.value)
        number, block, size = TaskContext.get().partitionId() << 32, _Block(), 0
        for part, texts, chars in _batches(batches, 1):
            if block.rows and size + chars > BLOCK_CHARS:
                yield block.batch(number)
                number, block, size = number + 1, _Block(), 0
            block.add(part.column(0).to_pylist(), Groups(texts, a, b), a.size, b.size)
            size += chars
        if block.rows:
            yield block.batch(number)

    made = materialised(docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(blocks, BLOCKS))
    entries = made.filter(F.col("pairs").isNotNull()).select("block", F.posexplode(F.arrays_zip("pairs", "holders")).alias("place", "e"))
    dictionary = entries.select("block", "place", F.col("e.pairs").alias("pair"), F.col("e.holders").alias("holders"))
    looked = dictionary.join(pair_counts(dictionary), "pair").select(F.col("block").alias("of_block"), "place", "n", "best")
    rows = made.filter(F.col("pairs").isNull()).drop("pairs", "holders")
    return rows.groupBy("block").cogroup(looked.groupBy("of_block")).applyInArrow(_counted, COUNTED)


def read_pieces(path: str) -> bytes:
    """The piece model, read by the driver; tasks get its content (about 0.5 MB) by broadcast."""
    with open(path, "rb") as f:
        return f.read()
