"""Suffix order by the difference cover {1, 2} mod 3, in numpy, to a chosen depth."""

from __future__ import annotations

import numpy as np


def _names(key: np.ndarray) -> np.ndarray:
    """Dense ranks of the keys, from 1."""
    order = np.argsort(key)
    s = key[order]
    out = np.empty(len(key), np.int64)
    out[order] = np.concatenate(([1], 1 + np.cumsum(s[1:] != s[:-1]))) if len(s) else 0
    return out


def _pack(*columns: np.ndarray) -> np.ndarray:
    """One number for each row, in the order of the rows; neighbours are named first if they don't fit 63 bits."""
    out = columns[0]
    for c in columns[1:]:
        width = int(c.max(initial=0)) + 1
        if int(out.max(initial=0)) + 1 > (1 << 62) // width:
            out = _names(out)
        out = out * width + c
    return out


def suffix_ranks(t: np.ndarray, depth: int) -> np.ndarray:
    """A rank for each suffix of t (positive numbers), of which the first 3**depth symbols are in order.

    Suffixes that agree in so many symbols have neighbouring ranks, in any order. Beyond its end t has zeros.
    """
    n = len(t)
    if n == 0:
        return np.zeros(0, np.int64)
    t = np.concatenate((t.astype(np.int64), np.zeros(4 + (-n) % 3, np.int64)))
    if depth <= 1:
        return _names(_pack(t[:n], t[1 : n + 1], t[2 : n + 2])) - 1
    # sort the sampled triples and recurse on their names, residue 1 before residue 2
    ones, twos = np.arange(1, n + 1, 3), np.arange(2, n + 2, 3)
    at = np.concatenate((ones, twos))
    names = _names(_pack(t[at], t[at + 1], t[at + 2]))
    inner = suffix_ranks(np.concatenate((names[: len(ones)], [0], names[len(ones) :])) + 1, depth - 1)
    r = np.zeros(len(t) + 3, np.int64)
    r[ones], r[twos] = inner[: len(ones)] + 1, inner[len(ones) + 1 :] + 1
    # sort the rest by their first symbol and the sample after it
    zeros = np.arange(0, n, 3)
    # merge: a rank is the number of smaller suffixes in each class
    own = np.sort(r[at])
    wide = int(r.max()) + 1
    single = lambda i: t[i] * wide + r[i + 1]
    both = np.concatenate((zeros, twos))
    pair = _names(_pack(t[both], t[both + 1], r[both + 2]))
    zero_single, zero_pair = np.sort(single(zeros)), np.sort(pair[: len(zeros)])
    out = np.zeros(n + 3, np.int64)
    out[ones] = np.searchsorted(own, r[ones]) + np.searchsorted(zero_single, single(ones))
    out[twos] = np.searchsorted(own, r[twos]) + np.searchsorted(zero_pair, pair[len(zeros) :])
    out[zeros] = np.searchsorted(zero_single, single(zeros)) + np.searchsorted(np.sort(single(ones)), single(zeros)) + np.searchsorted(np.sort(pair[len(zeros) :]), pair[: len(zeros)])
    return out[:n]
