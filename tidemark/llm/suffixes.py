"""Suffix arrays by induced sorting, with permuted common prefixes, in numpy.

Text is a sequence of bytes made of several strings, each closed by a separator that is smaller than every byte. Suffixes are
classed as smaller or larger than their successor; the leftmost-smaller substrings are sorted by one induction, named, and
the sequence of names is sorted by naming ever longer runs of names; a last induction places all suffixes. An
induction goes through the buckets of first symbols once, in order, and moves whole runs of a bucket at a time.
"""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor; the last symbol counts as smaller."""
    change = np.empty(len(t), bool)
    change[:-1] = t[:-1] != t[1:]
    change[-1] = True
    at = np.flatnonzero(change)
    # The next position from each on where the symbol changes decides.
    nxt = np.repeat(at, np.diff(np.concatenate(([-1], at))))
    smaller = np.empty(len(t), bool)
    smaller[nxt == len(t) - 1] = True
    inner = nxt < len(t) - 1
    smaller[inner] = t[nxt[inner]] < t[nxt[inner] + 1]
    return smaller


def _induce(t: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, symbols: int) -> np.ndarray:
    """All positions in the order that follows from that of ``seeds``, the leftmost-smaller positions."""
    n = len(t)
    seed_of = np.split(seeds, np.searchsorted(t[seeds], np.arange(1, symbols)))
    larger = _pass(t, ~smaller, seed_of, symbols, range(symbols))
    # Larger suffixes stand first in their bucket; smaller ones are induced from the right.
    down = [x[::-1] for x in larger]
    upper = _pass(t, smaller, down, symbols, range(symbols - 1, -1, -1))
    parts = [x for c in range(symbols) for x in (larger[c], upper[c][::-1])]
    out = np.concatenate(parts)
    last = n - 1
    return np.concatenate((np.array([last]), out[out != last]))


def _pass(t: np.ndarray, wanted: np.ndarray, given: list[np.ndarray], symbols: int, order: range) -> list[np.ndarray]:
    """Per bucket, the positions of type ``wanted`` that are induced, in the order of ``order``."""
    queues: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    done = [np.zeros(0, np.int64)] * symbols
    for c in order:
        mine: list[np.ndarray] = []
        # Induced suffixes of a bucket stand before those given (seeds) in scan order.
        wave = np.concatenate(queues[c]) if queues[c] else np.zeros(0, np.int64)
        queues[c] = []
        while len(wave):
            mine.append(wave)
            wave = _send(t, wanted, wave, c, queues)
        if len(given[c]):
            again = _send(t, wanted, given[c], c, queues)
            while len(again):
                mine.append(again)
                again = _send(t, wanted, again, c, queues)
        done[c] = np.concatenate(mine) if mine else np.zeros(0, np.int64)
    return done


def _send(t: np.ndarray, wanted: np.ndarray, found: np.ndarray, c: int, queues: list[list[np.ndarray]]) -> np.ndarray:
    """Deals the predecessors of ``found`` to their buckets; returns those that belong to bucket ``c`` itself."""
    before = found[found > 0] - 1
    before = before[wanted[before]]
    if not len(before):
        return before
    first = t[before]
    order = np.argsort(first, kind="stable")
    before, first = before[order], first[order]
    cuts = np.flatnonzero(np.diff(first)) + 1
    own = before[:0]
    for part in np.split(before, cuts):
        to = int(t[part[0]])
        if to == c:
            own = part
        else:
            queues[to].append(part)
    return own


def _named(t: np.ndarray, smaller: np.ndarray, ordered: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Names of the leftmost-smaller substrings: equal substrings share a name, names follow their order."""
    ends = np.append(places[1:], len(t) - 1)
    length = np.zeros(len(t), np.int64)
    length[places] = ends - places + 1
    a, b = ordered[:-1], ordered[1:]
    same = length[a] == length[b]
    left = np.flatnonzero(same)
    offset = 0
    while len(left):
        x, y = a[left] + offset, b[left] + offset
        equal = (t[x] == t[y]) & (smaller[x] == smaller[y])
        same[left[~equal]] = False
        offset += 1
        left = left[equal & (length[a[left]] > offset)]
    name = np.zeros(len(t), np.int64)
    name[ordered] = np.concatenate(([0], np.cumsum(~same)))
    return name[places]


def _sorted_names(names: np.ndarray) -> np.ndarray:
    """The order of the suffixes of a sequence of names, by names of runs that double in length."""
    rank, run, n = names, 1, len(names)
    while True:
        second = np.zeros(n, np.int64)
        second[: max(0, n - run)] = rank[run:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        new = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if n == 0 or new[-1] == n - 1:
            return order
        run *= 2


def suffix_array(t: np.ndarray, symbols: int) -> np.ndarray:
    """The positions of ``t`` (numbers below ``symbols``) in the order of their suffixes; a prefix comes first."""
    if not len(t):
        return np.zeros(0, np.int64)
    # A last symbol of its own below all others starts every order.
    t, symbols = np.append(t.astype(np.int64) + 1, 0), symbols + 1
    smaller = _types(t)
    places = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    seeds = places[np.argsort(t[places], kind="stable")]
    ordered = _induce(t, smaller, seeds, symbols)
    leftmost = np.zeros(len(t), bool)
    leftmost[places] = True
    names = _named(t, smaller, ordered[leftmost[ordered]], places)
    return _induce(t, smaller, places[_sorted_names(names)], symbols)[1:]


def common_prefixes(text: np.ndarray, sa: np.ndarray, limit: int) -> np.ndarray:
    """By position: the bytes in common with the suffix before it in ``sa``, in steps of eight, up to ``limit`` bytes.

    Only whether a prefix reaches ``limit`` matters to the callers, so equal words of eight bytes are counted, and a last
    word that overlaps the one before.
    """
    padded = np.concatenate((text.astype(np.uint8), np.zeros(limit + 8, np.uint8)))
    words = np.lib.stride_tricks.sliding_window_view(padded, 8).copy().view(np.uint64)[:, 0]
    phi = np.full(len(text), -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    out = np.zeros(len(text), np.int64)
    left = np.flatnonzero(phi >= 0)
    steps = [*range(0, limit - 7, 8)] + ([limit - 8] if limit % 8 else [])
    for step in steps:
        left = left[words[left + step] == words[phi[left] + step]]
        out[left] = min(step + 8, limit)
    return out
