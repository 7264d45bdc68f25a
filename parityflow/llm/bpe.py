"""Byte-level BPE encoding and decoding through a minimal acyclic word transducer.

The pre-tokens of all texts are counted, each task in bounded memory, and the most frequent
(a bounded number) are compiled into a minimal acyclic automaton: words that end alike share their
suffix states, and every arc carries how many words precede it, so the path of a word
adds up to its number, under which its token ids are stored. Tasks memory-map that
lexicon. A word outside it is merged by the vocabulary's ranks, so ids never depend on
what the lexicon holds; it only saves merging.

Null text counts as empty and gives no tokens; empty text gives none either. Rows are
encoded one by one: repeated rows repeat, an empty table gives an empty table, and other
columns pass through unless they bear the name of an output column, which then wins.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import re
import tempfile
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parityflow.session import materialised

# The split pattern of byte-level vocabularies of this kind.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

LEXICON_WORDS = 200_000  #: frequent words that are compiled; bounds what is broadcast
LEXICON_WORD_BYTES = 64  #: longer words are merged when they come
CACHE_WORDS = 300_000  #: pieces, and words, a task remembers at most
START_BYTES = 3  #: of a word that are looked up at once; there are few such beginnings
KEEP_WORDS = 100_000  #: a word with more than this part of a task's words is sure to be counted


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b], spare = chr(spare), spare + 1
    return [letters[b] for b in range(256)]


# Letters and numbers that the regex module knows and the tokenizers library does not.
NEWER_LETTERS = (
    "\u0558 \u058b-\u058c \u088f \u0c5c \u0cdc \u208f \u209d-\u209f \ua7ce-\ua7cf \ua7d2 \ua7d4 \ua7dd \ua7e2 \ua7f1 \uab6c-\uab6d "
    "\U000107bb-\U000107bf \U00010940-\U00010959 \U00010ec5-\U00010ec7 \U00010ed9-\U00010eee \U00011b0a \U00011db0-\U00011ddb "
    "\U00011de0-\U00011de9 \U00011df1 \U0001246f \U00012475-\U0001247f \U00012550-\U00012686 \U00016ea0-\U00016eb8 \U00016ebb-\U00016ed3 "
    "\U00016ff2-\U00016ff6 \U000187f8-\U000187ff \U00018cd6-\U00018cda \U00018d09-\U00018d20 \U00018d80-\U00018df2 \U00018e00-\U00019191 "
    "\U000191a0-\U000191d2 \U0001b123-\U0001b128 \U0001b168 \U0001d6a6 \U0001df1f-\U0001df24 \U0001df2b-\U0001df81 \U0001df90-\U0001df96 "
    "\U0001dfcd-\U0001dfff \U0001e6c0-\U0001e6de \U0001e6e0-\U0001e6e2 \U0001e6e4-\U0001e6e5 \U0001e6e7-\U0001e6ed \U0001e6f0-\U0001e6f4 "
    "\U0001e6fe-\U0001e6ff \U0002b73a-\U0002b73f \U0002b81e \U0002cea2-\U0002cead \U000323b0-\U00033479 \U0003d000-\U0003fc3f"
)

_findall = regex.compile(WORD_PATTERN).findall
_swap_newer = re.compile(f"[{NEWER_LETTERS.replace(' ', '')}]").sub
_spaces = [c for c in map(chr, range(0x3001)) if c.isspace()]
_ascii_spaces = [c for c in _spaces if c.isascii()]


def split_words(text: str) -> list[str]:
    """The pre-tokens of ``text``; newer letters count as unassigned characters while it is split."""
    if text.isascii() or max(text) < "\u0558":
        return _findall(text)
    known = _swap_newer("\u0378", text)
    if known == text:
        return _findall(text)
    ends = list(accumulate(map(len, _findall(known))))
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def at_spaces(text: str) -> list[str]:
    """``text`` split at every space, or whole where a space touches other white space.

    A pre-token holds a space only as its first character or within a run of white space. So the
    first piece, and every later piece with its space before it, can be split on their own.
    """
    for c in _ascii_spaces if text.isascii() else _spaces:
        if c in text and (c + " " in text or " " + c in text):
            return [text]
    return text.split(" ")


def piece_words(piece: str) -> list[str]:
    """The pre-tokens of a space and ``piece``, which holds no space."""
    return [" " + piece] if piece.isascii() and piece.isalpha() else split_words(" " + piece)


class Vocabulary:
    """Ids, merge ranks and added tokens of a tokenizer file."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        model, byte_of = spec["model"], {c: b for b, c in enumerate(byte_letters())}
        if model["type"] != "BPE" or spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError("a byte-level BPE vocabulary without prefix space is needed")
        ids = model["vocab"]
        self.pieces = {i: bytes(byte_of[c] for c in token) for token, i in ids.items()}
        self.of_byte = [ids[c] for c in byte_letters()]
        self.rank, self.made = {}, []  # of a pair of ids, packed into one number; what each rank makes
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[ids[a] << 32 | ids[b]] = rank
            self.made.append(ids[a + b])
        none = len(self.made)
        # ranks of pairs of single bytes, by both bytes in one number; for each id, a look-up of ranks by the id behind it
        self.byte_rank = [self.rank.get(a << 32 | b, none) for a in self.of_byte for b in self.of_byte]
        behind: list[dict[int, int]] = [{}] * (max(ids.values()) + 1)
        for pair, rank in self.rank.items():
            if not behind[pair >> 32]:
                behind[pair >> 32] = {}
            behind[pair >> 32][pair & 0xFFFFFFFF] = rank
        self.rank_behind = [held.get for held in behind]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces |= {i: text.encode() for text, i in self.added.items()}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.split_added = regex.compile("|".join(map(regex.escape, longest_first))) if self.added else None

    def merge(self, word: bytes) -> list[int]:
        """Merge the best ranked pair, leftmost first, until none is left."""
        ids = [*map(self.of_byte.__getitem__, word)]
        return self._merge_short(word, ids) if len(ids) <= 48 else self._merge_long(ids)

    def _merge_short(self, word: bytes, ids: list[int]) -> list[int]:
        behind, made, none, byte_rank = self.rank_behind, self.made, len(self.made), self.byte_rank
        ranks = [byte_rank[a << 8 | b] for a, b in zip(word, word[1:])]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            ids[i] = new = made[best]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = behind[ids[i - 1]](new, none)
            if i < len(ranks):
                ranks[i] = behind[new](ids[i + 1], none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        get, n = self.rank.get, len(ids)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            rank, i, a, b = heapq.heappop(queue)
            j = right[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two was merged meanwhile
            ids[i], ids[j], right[i] = self.made[rank], -1, right[j]
            if right[i] < n:
                left[right[i]] = i
            for k in (left[i], i):
                if k >= 0 and right[k] < n and (r := get(ids[k] << 32 | ids[right[k]])) is not None:
                    heapq.heappush(queue, (r, k, ids[k], ids[right[k]]))
        return [i for i in ids if i >= 0]


class Lexicon:
    """A minimal acyclic automaton over sorted words; ``find`` gives a word's number or -1.

    Stored as one byte string so that tasks map it: a header of five counts, then arc
    offsets, arc targets, words before each arc, id offsets, ids, final marks, arc labels.
    """

    def __init__(self, data):
        self.raw = data
        view = memoryview(data)
        states, arcs, words, ids, _ = view[:20].cast("I")
        at, parts = 20, []
        for size in (states + 1, arcs, arcs, words + 1, ids):
            parts.append(view[at : at + 4 * size].cast("I"))
            at += 4 * size
        self.first, self.target, self.before, self.id_from, _ = parts
        self.ids_at = at - 4 * ids
        self.final_at, self.label_at = at, at + states
        # what the first bytes of longer words lead to
        reached = {b"": (states - 1, 0)}
        for _ in range(START_BYTES):
            reached = {start + label: place for start, (state, number) in reached.items() for label, place in self._arcs(state, number)}
        self.start = reached

    def _arcs(self, state: int, number: int) -> Iterator[tuple[bytes, tuple[int, int]]]:
        """Labels out of a state, each with the state it leads to and the words before it."""
        for arc in range(self.first[state], self.first[state + 1]):
            at = self.label_at + arc
            yield bytes(self.raw[at : at + 1]), (self.target[arc], number + self.before[arc])

    @staticmethod
    def build(entries: dict[bytes, list[int]]) -> bytes:
        """Compile ``{word: ids}``."""
        return Lexicon.compiled(sorted(entries.items()))

    @staticmethod
    def compiled(entries: Iterable[tuple[bytes, Iterable[int]]]) -> bytes:
        """Compile words in rising order with their ids, adding them one by one and sharing finished suffixes."""
        # a finished state is its final mark, arc labels and arc targets as one byte string; its number is its place
        states: dict[bytes, int] = {}

        def finished(final: int, labels: bytearray, targets: array) -> int:
            return states.setdefault(bytes((final,)) + bytes(labels) + targets.tobytes(), len(states))

        path, last = [[0, bytearray(), array("I")]], b""
        id_from, ids = array("I", [0]), array("I")
        for word, own in entries:
            ids.extend(own)
            id_from.append(len(ids))
            same = len(os.path.commonprefix([word, last]))
            while len(path) > same + 1:
                number = finished(*path.pop())
                path[-1][2].append(number)
            for b in word[same:]:
                path[-1][1].append(b)
                path.append([0, bytearray(), array("I")])
            path[-1][0] = 1
            last = word
        while len(path) > 1:
            number = finished(*path.pop())
            path[-1][2].append(number)
        finished(*path.pop())
        holds = array("I")  # words from each state on; targets come before their sources
        first, target, before, label, final = array("I", [0]), array("I"), array("I"), bytearray(), bytearray()
        for key in states:
            arcs = (len(key) - 1) // 5
            final.append(key[0])
            label += key[1 : 1 + arcs]
            total = key[0]
            for t in memoryview(key[1 + arcs :]).cast("I"):
                target.append(t)
                before.append(total)
                total += holds[t]
            holds.append(total)
            first.append(len(target))
        header = [len(states), len(target), len(id_from) - 1, len(ids), 0]
        states.clear()
        return b"".join(np.array(x, "<u4").tobytes() for x in (header, first, target, before, id_from, ids)) + bytes(final) + bytes(label)

    def find(self, word: bytes) -> int:
        first, target, before, raw, labels = self.first, self.target, self.before, self.raw, self.label_at
        state, number = len(first) - 2, 0
        if len(word) >= START_BYTES:
            state, number = self.start.get(word[:START_BYTES], (-1, 0))
            if state < 0:
                return -1
            word = word[START_BYTES:]
        for b in word:
            start = first[state]
            arc = raw[labels + start : labels + first[state + 1]].find(b)
            if arc < 0:
                return -1
            number += before[start + arc]
            state = target[start + arc]
        return number if raw[self.final_at + state] else -1

    def size(self, number: int) -> int:
        """How many ids a word has."""
        return self.id_from[number + 1] - self.id_from[number]

    def ids(self, number: int) -> bytes:
        return bytes(self.raw[self.ids_at + 4 * self.id_from[number] : self.ids_at + 4 * self.id_from[number + 1]])


def mapped(data: bytes) -> mmap.mmap:
    """``data`` as a read-only mapping of a temporary file, which goes with the mapping."""
    with tempfile.TemporaryFile() as f:
        f.write(data)
        f.flush()
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)


class Memory:
    """Ids of words, as bytes: those that came twice are kept, those that came once only for a while."""

    def __init__(self):
        self.kept: dict[str, bytes] = {}
        self.new: dict[str, bytes] = {}
        self.get = self.kept.get

    def again(self, word: str) -> bytes | None:
        """The ids of a word that came once before; from now on it is kept."""
        ids = self.new.pop(word, None)
        if ids is not None:
            if len(self.kept) >= 2 * CACHE_WORDS // 3:
                self.kept.clear()
            self.kept[word] = ids
        return ids

    def add(self, word: str, ids: bytes) -> bytes:
        if len(word) <= LEXICON_WORD_BYTES:
            if len(self.new) >= CACHE_WORDS // 3:
                self.new.clear()
            self.new[word] = ids
        return ids


_vocabularies: dict[str, Vocabulary] = {}


def worker_vocabulary(content: bytes) -> Vocabulary:
    """One vocabulary per Python worker."""
    key = hashlib.sha256(content).hexdigest()
    if key not in _vocabularies:
        _vocabularies.clear()
        _vocabularies[key] = Vocabulary(content)
    return _vocabularies[key]


class Codec:
    """Encodes and decodes texts in a task, and remembers the ids of pieces and of words."""

    def __init__(self, vocabulary: bytes, lexicon: bytes):
        self.vocabulary, self.lexicon = worker_vocabulary(vocabulary), Lexicon(mapped(lexicon))
        self.of_word, self.of_piece = Memory(), Memory()
        self.bytes_of = np.full(max(self.vocabulary.pieces) + 1, None, object)
        for i, token in self.vocabulary.pieces.items():
            self.bytes_of[i] = token

    def find(self, word: str) -> bytes:
        """The ids of a word, not remembered."""
        raw = word.encode()
        number = self.lexicon.find(raw)
        return self.lexicon.ids(number) if number >= 0 else array("I", self.vocabulary.merge(raw)).tobytes()

    def word(self, word: str) -> bytes:
        return self.of_word.again(word) or self.of_word.add(word, self.find(word))

    def count(self, word: str) -> int:
        """How many ids a word has, not remembered."""
        raw = word.encode()
        number = self.lexicon.find(raw)
        return self.lexicon.size(number) if number >= 0 else len(self.vocabulary.merge(raw))

    def split(self, text: str) -> bytes:
        known = self.of_word.get
        return b"".join([known(w) or self.word(w) for w in split_words(text)])

    def piece(self, piece: str) -> bytes:
        """The ids of a space and ``piece``."""
        ids = self.of_piece.again(piece)
        if ids:
            return ids
        # letters alone are one word, which need not be remembered twice
        one = piece.isalpha() and (piece.isascii() or max(piece) < "\u0558")
        return self.of_piece.add(piece, self.find(" " + piece) if one else self.split(" " + piece))

    def words(self, text: str) -> list[str]:
        """Pre-tokens and added tokens of ``text``, in order."""
        find = self.vocabulary.split_added
        if find is None or not find.search(text):
            return split_words(text)
        words, at = [], 0
        for m in find.finditer(text):
            words += split_words(text[at : m.start()])
            words.append(m.group())
            at = m.end()
        return words + split_words(text[at:])

    def plain(self, text: str) -> list[bytes]:
        known = self.of_piece.get
        first, *rest = at_spaces(text)
        return [self.split(first), *[known(p) or self.piece(p) for p in rest]]

    def encode(self, text: str | None) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        added, parts, at = self.vocabulary.added, [], 0
        if self.vocabulary.split_added:
            for m in self.vocabulary.split_added.finditer(text):
                parts += self.plain(text[at : m.start()])
                parts.append(added[m.group()].to_bytes(4, "little"))
                at = m.end()
        parts += self.plain(text[at:] if at else text)
        return b"".join(parts)

    def decode(self, ids: bytes) -> str:
        return b"".join(self.bytes_of[np.frombuffer(ids, "<u4")].tolist()).decode(errors="replace")


_codecs: dict[str, Codec] = {}


def worker_codec(vocabulary: bytes, lexicon: bytes) -> Codec:
    """One codec per Python worker and lexicon, so that later tasks find its words remembered."""
    key = hashlib.sha256(vocabulary + lexicon).hexdigest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(vocabulary, lexicon)
    return _codecs[key]


def read_vocabulary(path: str) -> bytes:
    """The tokenizer file, read by the driver; tasks get its content (1 to 2 MB) by broadcast."""
    with open(path, "rb") as f:
        return f.read()


def keep_frequent(counts: Counter, keep: int) -> Counter:
    """Take the same number off all counts so that at most ``keep`` words are left (Misra and Gries).

    It takes off more than ``keep`` times that number in all, so over any number of calls no
    count gets too low by more than the sum of all counts divided by ``keep``.
    """
    if len(counts) <= keep:
        return counts
    cut = int(np.partition(np.fromiter(counts.values(), np.int64, len(counts)), len(counts) - keep - 1)[len(counts) - keep - 1])
    return Counter({w: n - cut for w, n in counts.items() if n > cut})


def word_counts(docs: DataFrame, text: str = "text", keep: int = KEEP_WORDS) -> DataFrame:
    """``word, n`` over all words of all texts, for words that are frequent.

    Every task counts its own words in bounded memory: a word that makes up more than one in
    ``keep`` of them is there, with a count that is too low by at most that part. With no more
    than twice ``keep`` distinct words in a task all its counts are exact.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, words = Counter(), Counter()
        for batch in batches:
            for t in batch.column(0):
                first, *rest = at_spaces(t.as_py() or "")
                words.update(split_words(first))
                seen.update(rest)
                if len(seen) > 2 * keep:
                    seen = keep_frequent(seen, keep)
                if len(words) > 2 * keep:
                    words = keep_frequent(words, keep)
        for piece, n in seen.items():
            for w in piece_words(piece):
                words[w] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["word", "n"])

    return docs.select(F.col(text).alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, vocabulary: bytes, text: str = "text", words: int = LEXICON_WORDS) -> bytes:
    """The compiled lexicon of the most frequent words of the corpus, ``words`` at most; words as rare as the first left out stay out.

    Words are merged where they lie and compiled in one task, which holds a bounded number of
    them; the driver gets the finished lexicon only.
    """
    short = materialised(word_counts(docs, text).filter((F.octet_length("word") <= LEXICON_WORD_BYTES) & (F.col("n") > 1)))
    # the count from which on at most ``words`` words remain, so that no task offers more than its part of them
    left, cut = words, None
    for n, held in sorted(((r.n, r.held) for r in short.groupBy("n").agg(F.count(F.lit(1)).alias("held")).collect()), reverse=True):
        left -= held
        if left < 0:
            break
        cut = n
    if not cut:
        return Lexicon.build({})
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    merged = short.filter(F.col("n") >= cut).select("word").mapInArrow(lambda batches: _merge_words(shared.value, batches), "word binary, ids binary")
    return merged.repartition(1).sortWithinPartitions("word").mapInArrow(_compile_words, "lexicon binary").toArrow().column(0)[0].as_py()


def _merge_words(vocabulary: bytes, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``word, ids`` of ``word``, ids as little-endian unsigned 32-bit integers."""
    merge = worker_vocabulary(vocabulary).merge
    for batch in batches:
        words = batch.column(0).cast(pa.binary())
        ids = [np.array(merge(w.as_py()), "<u4").tobytes() for w in words]
        yield pa.RecordBatch.from_arrays([words, pa.array(ids, pa.binary())], ["word", "ids"])


def _compile_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lexicon of sorted ``word, ids``."""
    entries = ((w.as_py(), np.frombuffer(i.as_py(), "<u4").tolist()) for batch in batches for w, i in zip(batch.column(0), batch.column(1)))
    yield pa.RecordBatch.from_arrays([pa.array([Lexicon.compiled(entries)], pa.binary())], ["lexicon"])


def _codec(spark: SparkSession, vocabulary: bytes, lexicon: bytes):
    shared = spark.sparkContext.broadcast((vocabulary, lexicon))
    return lambda: worker_codec(*shared.value)


def _with(docs: DataFrame, source: str, made: list[T.StructField], rows) -> DataFrame:
    """``docs`` with the columns ``made`` from column ``source`` by ``rows(values)``, batch by batch."""
    names = {f.name.lower() for f in made}
    kept = [c for c in docs.columns if c.lower() not in names]
    schema = T.StructType([docs.schema[c] for c in kept] + made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = rows()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):  # small steps keep what Python holds small
                part = batch.slice(at, 512)
                new = step(part.column(len(kept)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *new], [*kept, *(f.name for f in made)])

    value = F.col(f"`{source}`")
    return docs.select(*[F.col(f"`{c}`") for c in kept], value.alias("__value")).mapInArrow(run, schema)


def encode(docs: DataFrame, vocabulary: bytes, lexicon: bytes, text: str = "text", out: str = "token_ids") -> DataFrame:
    """Add ``out``: the ids of ``text`` as little-endian unsigned 32-bit integers, and ``n_tokens``."""
    codec = _codec(docs.sparkSession, vocabulary, lexicon)

    def start():
        c = codec()

        def step(texts):
            ids = [c.encode(t) for t in texts]
            return pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64())

        return step

    return _with(docs, text, [T.StructField(out, T.BinaryType()), T.StructField("n_tokens", T.LongType())], start)


def decode(docs: DataFrame, vocabulary: bytes, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Add ``out``: the text of the ids; null ids give null."""
    codec = _codec(docs.sparkSession, vocabulary, Lexicon.build({}))

    def start():
        c = codec()
        return lambda values: (pa.array([None if v is None else c.decode(v) for v in values], pa.string()),)

    return _with(docs, ids, [T.StructField(out, T.StringType())], start)


def round_trip(docs: DataFrame, vocabulary: bytes, lexicon: bytes, text: str = "text") -> DataFrame:
    """Encode and decode in one pass: adds ``token_ids``, ``n_tokens`` and ``decoded``."""
    codec = _codec(docs.sparkSession, vocabulary, lexicon)

    def start():
        c = codec()

        def step(texts):
            ids = [c.encode(t) for t in texts]
            return pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(map(c.decode, ids), pa.string())

        return step

    made = [T.StructField("token_ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.StringType())]
    return _with(docs, text, made, start)
