"""Suffix arrays by induced sorting, on numpy.

Suffixes are classified as larger or smaller than the next one; the leftmost-smaller (LMS) substrings are sorted by
induction and named; the string of names is sorted recursively; its order then induces that of all suffixes. An
induction goes bucket by bucket, each taken in waves, so that numpy moves a whole wave at once. That pays while there are
few buckets: a level whose alphabet has more than MAX_BUCKETS letters is sorted by doubling the ranks of its names.
"""

from __future__ import annotations

import numpy as np

MAX_BUCKETS = 1024


def larger_type(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is larger than the one after it (the empty suffix is the smallest)."""
    n = len(text)
    step = np.full(n, -1, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int64) - text[:-1].astype(np.int64))
    decided = np.where(step != 0, np.arange(n), n)
    return step[np.minimum.accumulate(decided[::-1])[::-1]] < 0


class _Buckets:
    def __init__(self, text: np.ndarray, letters: int):
        self.count = np.bincount(text, minlength=letters)
        self.end = np.cumsum(self.count)
        self.start = self.end - self.count
        self.used = np.flatnonzero(self.count)


def _ranks(sorted_letters: np.ndarray) -> np.ndarray:
    """Place of each entry within its run of equal letters."""
    first = np.flatnonzero(np.append(True, sorted_letters[1:] != sorted_letters[:-1]))
    return np.arange(len(sorted_letters)) - np.repeat(first, np.diff(np.append(first, len(sorted_letters))))


def _induce(text: np.ndarray, large: np.ndarray, buckets: _Buckets, seeds: np.ndarray) -> np.ndarray:
    """The suffix array that the LMS suffixes, in the order given, induce."""
    n = len(text)
    order = np.full(n, -1, np.int64)
    letters = text[seeds]
    by = np.argsort(letters, kind="stable")
    seeds, letters = seeds[by], letters[by]
    seed_count = np.bincount(letters, minlength=len(buckets.count))
    order[buckets.end[letters] - seed_count[letters] + _ranks(letters)] = seeds

    head, tail = buckets.start.copy(), buckets.end.copy()

    def put(wave: np.ndarray, want_large: bool) -> None:
        before = wave - 1
        before = before[before >= 0]
        before = before[large[before] == want_large]
        if not len(before):
            return
        c = text[before]
        by = np.argsort(c, kind="stable")
        before, c = before[by], c[by]
        rank, found = _ranks(c), np.bincount(c, minlength=len(head))
        if want_large:
            order[head[c] + rank] = before
            head[:] += found
        else:
            order[tail[c] - 1 - rank] = before
            tail[:] -= found

    order[head[text[n - 1]]] = n - 1
    head[text[n - 1]] += 1
    for c in buckets.used:
        at = buckets.start[c]
        while at < head[c]:
            at, wave = head[c], order[at : head[c]]
            put(wave, True)
        if seed_count[c]:
            put(order[buckets.end[c] - seed_count[c] : buckets.end[c]], True)
    for c in buckets.used[::-1]:
        at = buckets.end[c]
        while tail[c] < at:
            at, wave = tail[c], order[tail[c] : at][::-1]
            put(wave, False)
        put(order[buckets.start[c] : head[c]][::-1], False)
    return order


def _doubling(names: np.ndarray) -> np.ndarray:
    """The order of the suffixes of names by doubling; in each round only those that still share a rank are sorted. A rank is the first place of its group."""
    n, step = len(names), 1
    order = np.argsort(names, kind="stable")
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    places, keys = np.arange(n), names[order]
    while True:
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        size = np.diff(np.append(first, len(keys)))
        rank[order[places]] = np.repeat(places[first], size)
        places = places[np.repeat(size > 1, size)]
        if not len(places):
            return order
        own = order[places]
        keys = rank[own] * (n + 1) + rank[np.minimum(own + step, n)] + 1
        by = np.argsort(keys)
        order[places], keys = own[by], keys[by]
        step *= 2


def suffix_array(text: np.ndarray, letters: int | None = None) -> np.ndarray:
    """Starts of the suffixes of an array of small integers, in order; a suffix is smaller than its continuations."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    letters = int(text.max()) + 1 if letters is None else letters
    if letters > MAX_BUCKETS:
        return _doubling(np.unique(text, return_inverse=True)[1])
    text = text.astype(np.int64) if text.dtype != np.uint16 else text
    large = larger_type(text)
    lms = np.flatnonzero(large[:-1] & ~large[1:]) + 1
    buckets = _Buckets(text, letters)
    if not len(lms):
        return _induce(text, large, buckets, lms)
    order = _induce(text, large, buckets, lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ranked = order[is_lms[order]]
    names = _names(text, lms, ranked)
    place = np.empty(n, np.int64)
    place[lms] = np.arange(len(lms))
    if names[-1] + 1 < len(lms):
        reduced = np.empty(len(lms), np.int64)
        reduced[place[ranked]] = names
        ranked = lms[suffix_array(reduced, int(names[-1]) + 1)]
    return _induce(text, large, buckets, ranked)


def _names(text: np.ndarray, lms: np.ndarray, ranked: np.ndarray) -> np.ndarray:
    """Names of the LMS substrings in their sorted order: equal ones (compared letter by letter) share a name."""
    n = len(text)
    end = np.empty(n, np.int64)
    end[lms[:-1]] = lms[1:]
    end[lms[-1]] = n
    a, b = ranked[:-1], ranked[1:]
    size = end[a] - a
    same = (size == end[b] - b) & (end[a] < n) & (end[b] < n)
    open_pairs, k = np.flatnonzero(same), 0
    while len(open_pairs):
        equal = text[a[open_pairs] + k] == text[b[open_pairs] + k]
        same[open_pairs[~equal]] = False
        open_pairs = open_pairs[equal]
        open_pairs = open_pairs[size[open_pairs] > k]
        k += 1
    return np.append(0, np.cumsum(~same))


def common_prefixes(raw: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Permuted common prefixes, in text order: how many bytes each suffix has in common with the suffix before it in the order, counted up to most."""
    n = len(raw)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    before = np.full(n, n)
    before[order[1:]] = order[:-1]
    padded = np.append(raw, np.zeros(8, np.uint8))
    longs = np.ndarray((n,), "<u8", padded.tobytes(), 0, (1,))
    reach = np.minimum(n - np.maximum(np.arange(n), before), most)  # neither suffix goes on beyond the end
    own, k = np.flatnonzero(reach > 0), 0
    other, left = before[own], reach[own]
    while len(own):
        apart = longs[own + k] ^ longs[other + k]
        differs = apart != 0
        low = apart[differs] & (~apart[differs] + np.uint64(1))  # the lowest bit that differs tells the first byte
        out[own[differs]] = np.minimum(k + np.log2(low.astype(np.float64)).astype(np.int64) // 8, left[differs])
        k += 8
        ended = ~differs & (left <= k)
        out[own[ended]] = left[ended]
        at = ~differs & ~ended
        own, other, left = own[at], other[at], left[at]
    return out
