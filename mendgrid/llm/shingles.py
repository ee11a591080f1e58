"""Sets of word shingles as sorted 64-bit hashes, for whole batches of texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BATCH = 2 << 20  # bytes of text that are hashed together
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of every word of lower-cased bytes that end with a space."""
    gap = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap]).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return starts, ends, np.empty(0, np.uint64)
    lengths = ends - starts
    powers = np.ones(int(lengths.max()), np.uint64)
    np.multiply.accumulate(np.full(len(powers) - 1, _BASE), out=powers[1:])
    inside = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    terms = (data[~gap].astype(np.uint64) + np.uint64(1)) * powers[inside]
    sums = np.add.reduceat(terms, np.cumsum(lengths) - lengths)
    return starts, ends, mix(sums + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def batches(texts: list[str]) -> Iterator[tuple[int, list[bytes]]]:
    held, size, first = [], 0, 0
    for i, t in enumerate(texts):
        held.append(t.encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size >= BATCH:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The distinct shingles of ``words`` words of each text, as sorted hashes. A-Z is lower-cased, words are
    runs without space, tab, line break. A shorter text is one shingle, a text without words has none."""
    data = _LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    starts, _, hashes = _words(data)
    ends = np.cumsum([len(t) + 1 for t in texts])
    first = np.searchsorted(starts, np.concatenate([[0], ends]))
    n = len(hashes) - words + 1
    grams = np.full(max(0, n), np.uint64(words), np.uint64)
    for j in range(words):
        grams = mix(grams * _BASE + hashes[j : j + len(grams)])
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(grams[a : b - words + 1]))
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for h in hashes[a:b]:
                whole = mix(whole * _BASE + h)
            out.append(whole)
        else:
            out.append(np.empty(0, np.uint64))
    return out
