"""Suffix sorting with a difference cover, in numpy.

The cover of the residues modulo 3 is {1, 2}: the suffixes at those places are sorted by triples,
triples that tie are named and the string of names is sorted by recursion, the remaining suffixes
are sorted by their first symbol and the rank behind it, and both orders are merged.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Start places of all suffixes of ``symbols`` (small non-negative integers) in their order."""
    t = np.asarray(symbols, np.int64)
    n = len(t)
    if n < 8:
        s = t.tolist()
        return np.array(sorted(range(n), key=lambda i: s[i:]), np.int64)
    t = t + 1  # 0 stands behind the end
    width = int(t.max()) + 1
    if width > 1 << 20:
        _, t = np.unique(t, return_inverse=True)
        t = t + 1
        width = int(t.max()) + 1
    pad = np.concatenate([t, np.zeros(3, np.int64)])
    n0, n1 = (n + 2) // 3, (n + 1) // 3
    # if n % 3 is 1 an empty place of residue 1 ends the first half, so that names never run over
    ones = np.arange(1, n + (n % 3 == 1), 3)
    twos = np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    pad = np.concatenate([pad, np.zeros(1, np.int64)])
    if width <= 1 << 20:
        key = (pad[sample] * width + pad[sample + 1]) * width + pad[sample + 2]
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    else:  # more than two million different symbols: triples do not fit into one integer
        order = np.lexsort((pad[sample + 2], pad[sample + 1], pad[sample]))
        a = sample[order]
        new = np.concatenate([[True], (pad[a[1:]] != pad[a[:-1]]) | (pad[a[1:] + 1] != pad[a[:-1] + 1]) | (pad[a[1:] + 2] != pad[a[:-1] + 2])])
    names = np.empty(len(sample), np.int64)
    names[order] = np.cumsum(new) - 1
    if not new.all():
        order = suffix_array(names)
    rank = np.zeros(n + 4, np.int64)  # of the sampled suffixes, from 1; 0 behind the end
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    if n % 3 == 1:
        order = order[sample[order] < n]
    sa12 = sample[order]
    zeros = np.arange(0, n, 3)
    big = len(sample) + 2
    sa0 = zeros[np.argsort(pad[zeros] * big + rank[zeros + 1], kind="stable")]
    del n0, n1
    # how many sampled suffixes stand before each of the others
    one = sa12[sa12 % 3 == 1]
    two = sa12[sa12 % 3 == 2]
    before = np.searchsorted(pad[one] * big + rank[one + 1], pad[sa0] * big + rank[sa0 + 1])
    if width * width < (1 << 62) // big:
        mine = (pad[sa0] * width + pad[sa0 + 1]) * big + rank[sa0 + 2]
        before += np.searchsorted((pad[two] * width + pad[two + 1]) * big + rank[two + 2], mine)
    else:
        both = np.lexsort((np.concatenate([rank[two + 2], rank[sa0 + 2]]), np.concatenate([pad[two + 1], pad[sa0 + 1]]), np.concatenate([pad[two], pad[sa0]])))
        is_two = both < len(two)
        count = np.cumsum(is_two)
        more = np.empty(len(sa0), np.int64)
        more[both[~is_two] - len(two)] = count[~is_two]
        before += more
    out = np.empty(n, np.int64)
    place = before + np.arange(len(sa0))
    out[place] = sa0
    rest = np.ones(n, bool)
    rest[place] = False
    out[rest] = sa12
    return out


def equal_windows(text: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """A class for each of ``starts``: the same for equal strings of ``size`` bytes of ``text`` there.

    All suffixes are sorted; of those that begin at ``starts`` neighbours are compared.
    """
    if not len(starts):
        return np.zeros(0, np.int64)
    wanted = np.full(len(text), -1, np.int64)
    wanted[starts] = np.arange(len(starts))
    sa = suffix_array(text)
    sa = sa[wanted[sa] >= 0]
    new = np.ones(len(sa), bool)
    view = np.lib.stride_tricks.sliding_window_view(text, size)
    for s in range(1, len(sa), 1 << 18):
        e = min(len(sa), s + (1 << 18))
        new[s:e] = (view[sa[s:e]] != view[sa[s - 1 : e - 1]]).any(1)
    out = np.empty(len(starts), np.int64)
    out[wanted[sa]] = np.cumsum(new) - 1
    return out
