"""Suffix order by the difference cover modulo 3, on arrays.

Suffixes at positions 1 and 2 modulo 3 are the sample: their triples are sorted
and named, and the string of names is ordered by recursion. The other suffixes
are sorted by their first character and the rank of the sample suffix behind it,
and merged with the sample. Recursion ends when all names differ: after about
log3 of the longest repeat.
"""

from __future__ import annotations

import numpy as np


def _dense(*columns: np.ndarray) -> np.ndarray:
    """Rank of each row of small non-negative numbers, by the first column, then the next; equal rows share one."""
    packed = columns[0].astype(np.int64)
    for column in columns[1:]:
        most = int(column.max(initial=0)) + 1
        if int(packed.max(initial=0)) >= (1 << 62) // most:
            packed = np.unique(packed, return_inverse=True)[1]
        packed = packed * most + column
    return np.unique(packed, return_inverse=True)[1]


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Positions of ``text`` (numbers of 1 and more) in the order of their suffixes."""
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), dtype=np.int64)
    s = np.concatenate((text.astype(np.int64), np.zeros(3, np.int64)))
    ones, twos = np.arange(1, n, 3), np.arange(2, n, 3)
    sample = np.concatenate((ones, twos))
    names = _dense(s[sample], s[sample + 1], s[sample + 2])
    if int(names.max()) == len(sample) - 1:
        order = np.argsort(names, kind="stable")
    else:
        # A zero between the halves ends the suffixes of the first.
        joined = np.concatenate((names[: len(ones)] + 2, [1], names[len(ones) :] + 2))
        order = suffix_order(joined)
        order = order[order != len(ones)]
        order = order - (order > len(ones))
    by_rank = sample[order]
    rank = np.zeros(n + 3, np.int64)
    rank[by_rank] = np.arange(1, len(sample) + 1)

    wide = len(sample) + 1
    rest = np.arange(0, n, 3)
    by_first = s[rest] * wide + rank[rest + 1]
    rest_order = np.argsort(by_first)
    rest, by_first = rest[rest_order], by_first[rest_order]
    is_first = by_rank % 3 == 1
    first, second = by_rank[is_first], by_rank[~is_first]
    before_first = np.searchsorted(s[first] * wide + rank[first + 1], by_first)
    pairs = _dense(np.concatenate((s[second], s[rest])), np.concatenate((s[second + 1], s[rest + 1])))
    keys = pairs * wide + np.concatenate((rank[second + 2], rank[rest + 2]))
    before_second = np.searchsorted(keys[: len(second)], keys[len(second) :])
    place = np.arange(len(rest)) + before_first + before_second
    merged = np.full(n, -1, np.int64)
    merged[place] = rest
    merged[merged < 0] = by_rank
    return merged
