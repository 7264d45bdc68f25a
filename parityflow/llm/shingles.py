"""Sets of word shingles as 64-bit hashes, worked out with numpy inside tasks.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a shingle is five consecutive words, and a
text with fewer words has them all as its one shingle. No words or no text: an empty set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 5
BLOCK_BYTES = 1 << 18  #: words are hashed in blocks of about this size
_FACTOR = 0x9E3779B97F4A7C15 | 1
_rng = np.random.default_rng(20)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = _rng.integers(1, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _scale(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd factor and of its inverse modulo 2^64."""
    if n > _powers.get("n", 0):
        n = max(n, BLOCK_BYTES + 4096)
        for name, factor in (("up", _FACTOR), ("down", pow(_FACTOR, -1, 1 << 64))):
            p = np.full(n, factor, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
        _powers["n"] = n
    return _powers["up"], _powers["down"]


def _hash_block(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of a block."""
    letters = np.frombuffer(block, np.uint8)
    space = np.concatenate([[True], _SPACE[letters], [True]])
    turns = np.flatnonzero(space[1:] != space[:-1])
    start, end = turns[::2], turns[1::2]
    up, down = _scale(len(block) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[letters] * up[: len(block)], dtype=np.uint64)])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)), start


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words of one lower-cased text, block by block at white space."""
    parts, at = [], 0
    while at < len(text):
        end = at + BLOCK_BYTES
        while end < len(text) and not _SPACE[text[end]]:
            end += 1
        parts.append(_hash_block(text[at:end])[0])
        at = end
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """One hash for each place of a shingle, in order."""
    n = len(words)
    if n < WORDS:
        return mix(np.array([(words * _PLACE[:n]).sum(dtype=np.uint64) + np.uint64(n)], np.uint64)) if n else words
    total = np.zeros(n - WORDS + 1, np.uint64)
    for i in range(WORDS):
        total += words[i : n - WORDS + 1 + i] * _PLACE[i]
    return mix(total)


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text; short texts are hashed together."""
    start = 0
    while start < len(texts):
        raw, size, end = [], 0, start
        while end < len(texts) and (not raw or size + len(texts[end] or "") < BLOCK_BYTES):
            raw.append((texts[end] or "").encode().lower())
            size += len(raw[-1]) + 1
            end += 1
        if len(raw) == 1:
            yield np.unique(shingle_hashes(word_hashes(raw[0])))
        else:
            words, at = _hash_block(b"\n".join(raw))
            bounds = np.searchsorted(at, np.cumsum([0] + [len(r) + 1 for r in raw]))
            for a, b in zip(bounds, bounds[1:]):
                yield np.unique(shingle_hashes(words[a:b]))
        start = end
