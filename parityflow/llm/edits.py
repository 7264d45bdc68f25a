"""Token counts that follow edits, from a tree over the pre-tokens of each document.

Added tokens of the vocabulary are pre-tokens of their own, also where an edit makes or breaks one.

A document's pre-tokens are grouped into leaves of ``LEAF_WORDS``, counting those between two
spaces as one; a leaf knows its characters and tokens, and the nodes above hold sums. An edit finds its leaves by these sums, re-encodes from a
leaf boundary that the edit cannot move to the first old boundary behind it that the new
pre-tokens meet again, puts the new leaves in place and renews the sums above them. Nothing else
is encoded.

Null text counts as empty. Edits apply in the order of ``seq``, each to the text that the one
before left; places are code points and are cut to the text, null places mean its end, null
replacement means deletion. Edits of unknown documents go unused, rows that share an id are all
edited, and a null id has no edits. Empty tables give empty tables; extra columns pass through
unless they bear the name of an output column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parityflow.llm.bpe import CACHE_WORDS, LEXICON_WORD_BYTES, Codec, Lexicon, at_spaces, piece_words, split_words, worker_codec

LEAF_WORDS = 16
LOOK_AHEAD = 64  #: characters split behind a boundary, so that the end of the cut does not sway it


class TokenTree:
    """Leaves with their characters and tokens under a tree of sums.

    ``units(text)`` gives characters and tokens of a text's units, each one or several whole
    pre-tokens; no added token is longer than ``reach`` characters.
    """

    def __init__(self, text: str, units: Callable[[str], np.ndarray], reach: int = 0):
        self.text, self.units, self.reach = text, units, reach
        self.encoded_chars = 0
        self._set(self._leaves(units(text)))

    def _leaves(self, units: np.ndarray) -> np.ndarray:
        """Characters and tokens of every leaf of ``units``."""
        self.encoded_chars += int(units[:, 0].sum())
        return np.add.reduceat(units, np.arange(0, len(units), LEAF_WORDS)) if len(units) else units

    def _set(self, leaves: np.ndarray) -> None:
        self.n = len(leaves)
        self.size = 1 << max(0, self.n - 1).bit_length()
        self.sums = np.zeros((2 * self.size, 2), np.int64)
        if self.n:
            self.sums[self.size : self.size + self.n] = leaves
        at = self.size
        while at > 1:
            at //= 2
            self.sums[at : 2 * at] = self.sums[2 * at : 4 * at : 2] + self.sums[2 * at + 1 : 4 * at : 2]

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds ``place``, and where it starts."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if place >= start + self.sums[node, 0]:
                start += int(self.sums[node, 0])
                node += 1
        return min(node - self.size, max(0, self.n - 1)), start

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace ``text[start:end]`` by ``new``."""
        old = self.text
        start = min(max(start, 0), len(old))
        end = min(max(end, start), len(old))
        self.text = old[:start] + new + old[end:]
        if not self.n:
            return self._set(self._leaves(self.units(self.text)))
        # a boundary holds if it is looked at from before: no white space run, no "'re" and no added token may reach from it to the edit
        first, low = self.leaf_at(max(0, start - 1 - self.reach))
        while first and not old[low : max(low, start - 2 - self.reach)].strip():
            first -= 1
            low -= int(self.sums[self.size + first, 0])
        last, at = self.leaf_at(min(end, len(old) - 1))
        leaf = last
        shift = len(new) - (end - start)
        while True:
            at += int(self.sums[self.size + leaf, 0])
            leaf += 1
            units, upto = self.units(self.text[low : at + shift + LOOK_AHEAD + self.reach]), at + shift - low
            ends = units[:, 0].cumsum()
            met = int(np.searchsorted(ends, upto))
            # the last units of a cut may differ from those of the text, the boundary must lie before them
            meets = upto == 0 or (met < len(ends) and ends[met] == upto)
            if leaf >= self.n or (meets and self.text[at + shift : at + shift + LOOK_AHEAD - 8].strip()):
                break
        # behind the last leaf the cut reached the end of the text, so its units are all there are
        made = self._leaves(units if leaf >= self.n else units[: met + 1] if upto else units[:0])
        if len(made) == leaf - first:  # the same leaves: renew the sums above them only
            self.sums[self.size + first : self.size + leaf] = made
            low, high = self.size + first, self.size + leaf
            while low > 1:
                low, high = low // 2, (high + 1) // 2
                self.sums[low:high] = self.sums[2 * low : 2 * high : 2] + self.sums[2 * low + 1 : 2 * high : 2]
        else:
            leaves = self.sums[self.size : self.size + self.n]
            self._set(np.concatenate([leaves[:first], made, leaves[leaf:]]))


class TokenCounts(dict):
    """Tokens of words, found by a codec when first asked for; when full, what is not asked for again goes."""

    def __init__(self, codec: Codec, most: int = CACHE_WORDS):
        self.codec, self.most, self.old, self.pieces = codec, most, {}, PieceCounts(self, most)

    def __missing__(self, word: str) -> int:
        n = self.old.get(word)
        if n is None:
            n = self.codec.count(word)
        if len(word) <= LEXICON_WORD_BYTES:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[word] = n
        return n

    def words(self, text: str) -> np.ndarray:
        """Characters and tokens of every pre-token of ``text``, which holds no added token."""
        words = split_words(text)
        return pairs(map(len, words), map(self.__getitem__, words), len(words))

    def plain(self, text: str) -> list[np.ndarray]:
        """The same in parts, with a space and what follows it up to the next one as one unit, unless that is long."""
        first, *rest = at_spaces(text)
        if not rest:
            return [self.words(first)]
        parts, at = [self.words(first)], 0
        units = pairs(map(len, rest), map(self.pieces.__getitem__, rest), len(rest))
        units[:, 0] += 1
        for i in np.flatnonzero(units[:, 0] > LEXICON_WORD_BYTES).tolist():
            parts += [units[at:i], self.words(" " + rest[i])]
            at = i + 1
        return [*parts, units[at:]]

    def units(self, text: str) -> np.ndarray:
        """Characters and tokens of the units of ``text``; an added token is a unit of its own."""
        find, parts, at = self.codec.vocabulary.split_added, [], 0
        for m in find.finditer(text) if find else ():
            parts += [*self.plain(text[at : m.start()]), np.array([[m.end() - m.start(), 1]], np.int64)]
            at = m.end()
        return np.concatenate(parts + self.plain(text[at:]))


class PieceCounts(dict):
    """Tokens of a space and a piece of text behind it; when full, what is not asked for again goes."""

    def __init__(self, counts: TokenCounts, most: int):
        self.counts, self.most, self.old = counts, most, {}

    def __missing__(self, piece: str) -> int:
        n = self.old.get(piece)
        if n is None:
            if len(piece) >= LEXICON_WORD_BYTES:
                return 0  # its words are counted one by one
            n = sum(map(self.counts.__getitem__, piece_words(piece)))
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[piece] = n
        return n


def pairs(chars: Iterable[int], tokens: Iterable[int], n: int) -> np.ndarray:
    made = np.empty((n, 2), np.int64)
    made[:, 0] = np.fromiter(chars, np.int64, n)
    made[:, 1] = np.fromiter(tokens, np.int64, n)
    return made


_counts: list[TokenCounts] = []


def worker_counts(codec: Codec) -> TokenCounts:
    """One table of counts per Python worker and codec."""
    if not _counts or _counts[0].codec is not codec:
        _counts[:] = [TokenCounts(codec)]
    return _counts[0]


def document_tree(text: str, counts: TokenCounts) -> TokenTree:
    return TokenTree(text, counts.units, max(map(len, counts.codec.vocabulary.added), default=0))


def count_edited(
    docs: DataFrame, edits: DataFrame, vocabulary: bytes, lexicon: bytes | None = None, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Add ``n_tokens`` before and ``n_tokens_after`` the edits ``doc_id, seq, start, finish, new``, and the characters encoded for either.

    The edits of a document travel to it as one list.
    """
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, Lexicon.build({}) if lexicon is None else lexicon))

    @F.pandas_udf("n_tokens long, n_tokens_after long, chars_encoded long, chars_reencoded long")
    def counted(texts: pd.Series, changes: pd.Series) -> pd.DataFrame:
        counts, rows = worker_counts(worker_codec(*shared.value)), []
        for t, todo in zip(texts, changes):
            tree = document_tree(t or "", counts)
            before, encoded = tree.tokens, tree.encoded_chars
            for e in sorted(todo if todo is not None else [], key=lambda e: e["seq"]):
                n = len(tree.text)
                start, end = (n if e[k] is None or e[k] != e[k] else int(e[k]) for k in ("start", "finish"))
                tree.edit(start, end, e["new"] or "")
            rows.append((before, tree.tokens, encoded, tree.encoded_chars - encoded))
        return pd.DataFrame(rows, columns=["n_tokens", "n_tokens_after", "chars_encoded", "chars_reencoded"])

    names = ("n_tokens", "n_tokens_after", "chars_encoded", "chars_reencoded")
    kept = [c for c in docs.columns if c.lower() not in names]
    lists = edits.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list(F.struct("seq", "start", "finish", "new")).alias("__edits"))
    joined = docs.join(lists, F.col(f"`{doc_id}`") == F.col("__id"), "left")
    made = joined.withColumn("__made", counted(F.col(f"`{text}`"), F.col("__edits")))
    return made.select(*[F.col(f"`{c}`") for c in kept], "__made.*")
