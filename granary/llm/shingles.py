"""Sets of word shingles as sorted arrays of 64-bit hashes, for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 5
#: Bytes of text that are hashed together, which bounds the arrays in between.
CHUNK = 1 << 20

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = _rng.integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    one = np.ones(1, np.uint64)
    return tuple(np.concatenate([one, np.cumprod(np.full(n, b, np.uint64))]) for b in (_BASE, inverse))


def word_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of a buffer of bytes."""
    solid = ~_SPACE[buf]
    edge = np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(len(buf))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[buf] * up[:-1])])
    return start, mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def shingle_sets(texts: list[str], words: int = WORDS) -> Iterator[np.ndarray]:
    """For each text, in order, its distinct shingles' hashes, sorted.

    Words are runs of characters that are not ASCII white space, A-Z as a-z. A text of fewer words has its whole
    sequence as its only shingle; one without words has none.
    """
    held: list[bytes] = []
    size = 0
    for t in texts:
        b = t.encode("utf-8", "surrogatepass").lower()
        held.append(b)
        size += len(b) + 1
        if size >= CHUNK:
            yield from _sets(held, words)
            held, size = [], 0
    yield from _sets(held, words)


def _sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    if not texts:
        return
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    start, h = word_hashes(buf)
    ends = np.cumsum([len(t) + 1 for t in texts])
    bound = np.concatenate([[0], np.searchsorted(start, ends)])
    n = len(h) - k + 1
    whole = np.zeros(max(n, 0), np.uint64)
    for i in range(k if n > 0 else 0):
        whole += h[i : i + n] * _STEP[i]
    whole = mix(whole)
    for a, b in zip(bound[:-1], bound[1:]):
        if b - a >= k:
            yield np.unique(whole[a : b - k + 1].view(np.int64))
        elif b > a:
            yield mix((h[a:b] * _STEP[: b - a]).sum(keepdims=True) + np.uint64(b - a)).view(np.int64)
        else:
            yield np.zeros(0, np.int64)
