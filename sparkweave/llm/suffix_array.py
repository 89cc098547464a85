"""Suffix arrays by induced sorting, and permuted common prefixes."""

from __future__ import annotations

import numpy as np

#: Entries that a sweep by stretches looks at first; stretches grow and shrink with what they find.
STRETCH = 256


def suffix_array(text: np.ndarray, alphabet: int | None = None) -> np.ndarray:
    """Suffix array of an integer text whose last symbol is 0 and the only 0.

    Suffixes are S (smaller than the next) or L. Leftmost-S (LMS) suffixes are put at the ends of their buckets, from
    which L suffixes are induced in one sweep upwards, and S suffixes in one downwards. A first such pass sorts the LMS
    substrings; their names, in text order, are a text of at most half the length, which is sorted in the same way where
    names recur; and a second pass sorts all.
    """
    text = np.asarray(text, np.int64)
    n = len(text)
    if n < 3:
        return np.arange(n - 1, -1, -1, dtype=np.int64) if n else np.zeros(0, np.int64)
    alphabet = int(text.max()) + 1 if alphabet is None else alphabet
    rising = np.diff(text.astype(np.int64))
    change = np.flatnonzero(rising)
    # the type of a suffix is decided by the next change of symbol
    later = change[np.searchsorted(change, np.arange(n - 1))]
    small = np.empty(n, bool)
    small[:-1] = rising[later] > 0
    small[-1] = True
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    tails = np.cumsum(np.bincount(text, minlength=alphabet))
    # leftmost-S substrings in order, to the first difference
    sorted_sa = _induce(text, small, lms, tails)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = sorted_sa[is_lms[sorted_sa]]
    number = np.empty(n, np.int64)
    number[lms] = np.arange(len(lms))
    ends = np.append(lms[1:], n - 1)  # a substring runs to the next LMS place, that included
    a, b = order[:-1], order[1:]
    la, lb = ends[number[a]] - a, ends[number[b]] - b
    same = la == lb
    left = np.flatnonzero(same)
    k = 0
    while len(left):
        unlike = text[a[left] + k] != text[b[left] + k]
        same[left[unlike]] = False
        left = left[~unlike]
        k += 1
        left = left[la[left] >= k]
    names = np.empty(len(lms), np.int64)
    names[number[order]] = np.r_[0, np.cumsum(~same)]
    distinct = int(names.max()) + 1
    place = order if distinct == len(lms) else lms[suffix_array(names, distinct)]
    return _induce(text, small, place, tails)


def _induce(text: np.ndarray, small: np.ndarray, lms: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """All suffixes, sorted as far as those of lms are.

    What an entry induces lies further on in the sweep. Where buckets hold many entries, a sweep takes a stretch at once
    and ends it at the first place that falls into the stretch itself; where they hold few, it goes entry by entry. Both
    give the same order.
    """
    n = len(text)
    sa = np.full(n, -1, np.int32)
    symbols = text[lms]
    order = np.argsort(symbols, kind="stable")
    own = symbols[order]
    counts = np.bincount(own, minlength=len(tails))
    group = np.cumsum(counts) - counts
    sa[(tails - counts)[own] + np.arange(len(own)) - group[own]] = lms[order]
    # the symbol before each suffix where that begins an L suffix, else -1; the last, for entries of -1, too
    before = np.full(n + 1, -1, np.int32)
    before[1:n] = np.where(small[:-1], -1, text[:-1])
    # upwards: L suffixes, from the heads of their buckets on
    edge = np.zeros(len(tails), np.int32)
    edge[1:] = tails[:-1]
    many = n >= 64 * len(tails)
    (_stretches if many else _steps)(sa, before, edge, 1)
    # downwards: S suffixes, from the tails of their buckets on, LMS ones anew
    filled = np.flatnonzero(sa >= 0)
    sa[filled[small[sa[filled]]]] = -1
    sa[0] = n - 1
    before[1:n] = np.where(small[:-1], text[:-1], -1)
    edge = (tails - 1).astype(np.int32)
    (_stretches if many else _steps)(sa[::-1], before, edge, -1)
    return sa.astype(np.int64)


def _steps(sa: np.ndarray, before: np.ndarray, edge: np.ndarray, step: int) -> None:
    """A sweep over sa, entry by entry."""
    places, induces, edges = memoryview(sa if step > 0 else sa[::-1]), memoryview(before), memoryview(edge)
    for j in memoryview(sa):
        if j > 0:
            c = induces[j]
            if c >= 0:
                at = edges[c]
                places[at] = j - 1
                edges[c] = at + step


def _stretches(sa: np.ndarray, before: np.ndarray, edge: np.ndarray, step: int) -> None:
    """A sweep over sa by stretches."""
    n, at, size = len(sa), 0, STRETCH
    while at < n:
        until = min(n, at + size)
        batch = sa[at:until]
        symbols = before[batch]
        mine = np.flatnonzero(symbols >= 0)
        if not len(mine):
            at, size = until, 2 * size
            continue
        symbols = symbols[mine]
        order = np.argsort(symbols.astype(np.uint16) if len(edge) < 1 << 16 else symbols, kind="stable")
        grouped = symbols[order]
        new = np.flatnonzero(np.r_[True, grouped[1:] != grouped[:-1]])
        count = np.diff(new, append=len(grouped))
        rank = np.arange(len(grouped)) - np.repeat(new, count)
        places = edge[grouped] + step * rank
        if step < 0:
            places = n - 1 - places
        first = int(places.min())
        if first < until:  # all before it are complete
            done = order < np.searchsorted(mine, first - at)
            places, order, grouped = places[done], order[done], grouped[done]
            until, size = first, max(STRETCH, first - at)
        else:
            size *= 2
        sa[places] = batch[mine[order]] - 1
        np.add.at(edge, grouped, step) if len(grouped) < 64 else np.add(edge, step * np.bincount(grouped, minlength=len(edge)).astype(np.int32), out=edge)
        at = until


def permuted_lcp(text: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of the text, the place before it in the suffix array, and the length of their common prefix.

    A value is one less than that of the place before where both sides go on from there by the same symbol; only the
    others are worked out by comparison, and their lengths sum to no more than n log n.
    """
    n = len(text)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    at = np.arange(n)
    reducible = np.zeros(n, bool)
    ok = (phi > 0) & (at > 0)
    reducible[ok] = text[at[ok] - 1] == text[phi[ok] - 1]
    reducible[1:] &= phi[:-1] >= 0
    own = np.flatnonzero(~reducible & (phi >= 0))
    length = np.zeros(n, np.int64)
    # symbols compared four at a time
    wide = np.concatenate([text.astype("<u2"), np.zeros(8, "<u2")])
    words = np.ndarray((n + 1,), "<u8", wide.data, 0, (2,))
    a, b, left, k = own, phi[own], np.arange(len(own)), 0
    size = np.zeros(len(own), np.int64)
    while len(left):
        inside = np.maximum(a[left], b[left]) + k <= n - 4
        x = words[np.minimum(a[left] + k, n)] ^ words[np.minimum(b[left] + k, n)]
        same = inside & (x == 0)
        stop = left[~same]
        for j in range(4):
            i, m = a[stop] + k + j, b[stop] + k + j
            alive = (i < n) & (m < n)
            alive[alive] = text[i[alive]] == text[m[alive]]
            stop = stop[alive]
            size[stop] += 1
        left = left[same]
        size[left] += 4
        k += 4
    length[own] = size
    source = np.maximum.accumulate(np.where(reducible, 0, at))
    length = np.maximum(length[source] - (at - source), 0)
    length[phi < 0] = 0
    return phi, length


def repeated_starts(strings: list[bytes], width: int) -> list[np.ndarray]:
    """For each string, whether at each of its places a string of width bytes starts that also starts elsewhere in them."""
    total = sum(map(len, strings)) + len(strings)
    text = np.empty(total + 1, np.uint16)
    ends = np.cumsum([len(s) + 1 for s in strings]) - 1
    keep = np.ones(total + 1, bool)
    keep[ends] = False
    keep[-1] = False
    text[keep] = np.frombuffer(b"".join(strings), np.uint8).astype(np.uint16) + 2
    text[ends] = 1
    text[-1] = 0
    sa = suffix_array(text, 258)
    phi, length = permuted_lcp(text, sa)
    far = length >= width
    far[phi[far]] = True
    room = np.zeros(total + 1, bool)
    bounds = np.r_[0, ends + 1]
    for a, b in zip(bounds[:-1].tolist(), ends.tolist()):
        if b - a >= width:
            room[a : b - width + 1] = True
    far &= room
    return [far[a:b] for a, b in zip(bounds[:-1].tolist(), ends.tolist())]
