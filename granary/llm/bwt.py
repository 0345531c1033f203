"""Burrows-Wheeler transform of many strings, and the groups of equal substrings of one length by interval expansion."""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Start positions in order of the first `depth` symbols (0 to 256) or more, cyclically, by prefix doubling.

    Only suffixes that share their symbols so far with others are sorted again.
    """
    n = len(symbols)
    key, length = np.zeros(n, np.int64), 7
    for j in range(length):
        key = key * 512 + np.roll(symbols, -j)
    order, rank = np.argsort(key), np.empty(n, np.int64)
    tied, at, key = np.arange(n), order, key[order]
    while True:
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[at] = tied[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]  # the place of the first that ties
        tied = tied[~(new & np.append(new[1:], True))]
        if length >= depth or not len(tied):
            return order
        at = order[tied]
        key = rank[at] * n + rank[(at + length) % n]
        sort = np.argsort(key)
        order[tied] = at = at[sort]
        key = key[sort]
        length *= 2


def boundaries(transform: np.ndarray, depth: int) -> np.ndarray:
    """boundaries[i]: suffixes i - 1 and i, in order, differ within their first `depth` symbols.

    Breadth first: from the interval of all suffixes, an interval of the suffixes that start with w is extended
    backwards by each symbol c that precedes them, which gives that of cw. An interval of strings of length l + 1
    whose right bound is new shows a common prefix of length l there, and only such intervals are extended further.
    Common prefixes so come by increasing value, and expansion stops at the wanted depth. The order need hold for the
    first `depth` + 1 symbols only.
    """
    n = len(transform)
    bits = n.bit_length()  # an interval, a symbol and a place make one number, for n below 2^27
    back = np.empty(n, np.int64)
    back[np.argsort(transform.astype(np.int16), kind="stable")] = np.arange(n)  # where the suffix one symbol longer stands
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    low, high = np.array([0]), np.array([n])
    fresh_end = True  # the last bound belongs to no two suffixes, but its interval is extended all the same
    for _ in range(depth):
        size = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
        pair = np.sort(((np.repeat(np.arange(len(low)), size) * 512 + transform[at]) << bits) + at)
        first = np.flatnonzero(np.concatenate([[True], pair[1:] >> bits != pair[:-1] >> bits]))
        count = np.diff(first, append=len(pair))
        left = back[pair[first] & ((1 << bits) - 1)]
        right = left + count
        new = ~known[right]
        if fresh_end:  # intervals that end at n never show a new bound; follow them until they hold one suffix
            new |= (right == n) & (count > 1)
        known[right] = True
        low, high = left[new], right[new]
        if not len(low):
            break
    return known[:n]


def equal_windows(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, group) of each window of `length` bytes; windows of one group, and no others, are equal."""
    joined = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int64) + 1
    sizes = np.array([len(t) for t in texts])
    begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    joined[begins + sizes] = 0
    order = suffix_order(joined, length + 2)
    group_of_rank = np.cumsum(boundaries(joined[order - 1], length))
    group = np.empty(len(joined), np.int64)
    group[order] = group_of_rank
    many = np.maximum(sizes - length + 1, 0)
    text = np.repeat(np.arange(len(texts)), many)
    start = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    return text, start, group[begins[text] + start]
