"""Suffix arrays by induced sorting, and permuted common prefixes, over numpy arrays.

Suffixes are L (larger than the next one) or S (smaller).  A leftmost S suffix (LMS)
follows an L suffix.  Substrings from one LMS to the next are sorted and named, the
string of names is sorted by recursion, and the order of the LMS suffixes induces that of
all others.  Bytes are induced by one scan over the 256 buckets: a bucket's suffixes
induce those before them in the order in which they stand, and a bucket's own runs follow
in waves.  That takes time linear in the text.  Names have too many buckets to scan, so
there a suffix is induced along its chain: L suffixes lead, letter by letter, to the next
LMS, S suffixes to the next L, and ranks double along these chains.

The order is that of plain comparison; a suffix that is a prefix of another comes first.
"""

from __future__ import annotations

import numpy as np


def _smaller_than_next(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next; the empty suffix after the last is the smallest."""
    n = len(t)
    step = np.empty(n, dtype=np.int8)
    step[-1] = -1
    step[:-1] = (t[:-1] < t[1:]).astype(np.int8) - (t[:-1] > t[1:]).astype(np.int8)
    # Equal letters take the type of what follows them.
    at = np.where(step != 0, np.arange(n, dtype=np.int32), np.int32(n))
    at = np.minimum.accumulate(at[::-1])[::-1]
    return step[at] > 0


def _leftmost(s: np.ndarray) -> np.ndarray:
    """Positions of leftmost S suffixes, in text order."""
    return np.flatnonzero(s[1:] & ~s[:-1]) + 1


def _spread(sa: np.ndarray, edge: np.ndarray, t: np.ndarray, at: np.ndarray, down: bool) -> None:
    """Put suffixes ``at`` behind what their letters' buckets hold so far, in order."""
    letter = t[at]
    order = np.argsort(letter, kind="stable")
    counts = np.bincount(letter, minlength=256)
    begins = np.cumsum(counts) - counts
    letter = letter[order]
    k = np.arange(len(at)) - begins[letter]
    if down:
        sa[edge[letter] - 1 - k] = at[order]
        edge -= counts
    else:
        sa[edge[letter] + k] = at[order]
        edge += counts


def _induce_bytes(t: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes of the bytes ``t``, induced from LMS suffixes in the order of ``lms``."""
    n = len(t)
    counts = np.bincount(t, minlength=256)
    ends = np.cumsum(counts)
    begins = ends - counts
    by_letter = np.argsort(t[lms], kind="stable")
    grouped = lms[by_letter]
    marks = np.searchsorted(t[grouped], np.arange(257))
    sa = np.empty(n, dtype=np.int32)
    letters = np.flatnonzero(counts)
    head = begins.copy()
    last = t[n - 1]
    sa[head[last]] = n - 1
    head[last] += 1
    for c in letters:
        lo = begins[c]
        done = lo
        while done < head[c]:
            # The letter's own run grows by a wave.
            wave = sa[done : head[c]]
            done = head[c]
            wave = wave[wave > 0] - 1
            wave = wave[t[wave] == c]
            sa[done : done + len(wave)] = wave
            head[c] += len(wave)
        here = np.concatenate([sa[lo:done], grouped[marks[c] : marks[c + 1]]])
        here = here[here > 0] - 1
        here = here[t[here] > c]
        if len(here):
            _spread(sa, head, t, here, False)
    tail = ends.copy()
    for c in letters[::-1]:
        hi = ends[c]
        done = hi
        while done > tail[c]:
            wave = sa[tail[c] : done][::-1]
            done = tail[c]
            wave = wave[wave > 0] - 1
            wave = wave[t[wave] == c]
            sa[done - len(wave) : done] = wave[::-1]
            tail[c] -= len(wave)
        here = np.concatenate([sa[done:hi][::-1], sa[begins[c] : head[c]][::-1]])
        here = here[here > 0] - 1
        here = here[t[here] < c]
        if len(here):
            _spread(sa, tail, t, here, True)
    return sa


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first, size): the order by ``key``, and for each place in it where its group of equals begins and its size."""
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(key)))
    return order, np.repeat(first, size), np.repeat(size, size)


def _along_chains(key: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """For each position, how many others are smaller by their keys and the keys after them up to the next ``stop``.

    ``key`` tells stops from others.  The last position must be a stop.
    """
    n = len(key)
    rank = np.empty(n, dtype=np.int64)
    order, first, size = _groups(key)
    rank[order] = first
    after = np.where(stop, np.arange(n), n)
    after = np.minimum.accumulate(after[::-1])[::-1]
    here = order[size > 1]
    here = here[~stop[here]]
    step = 1
    while len(here):
        # Only suffixes that are alike so far are compared on; where one has met its stop, so have all of its group.
        old = rank[here]
        order, first, size = _groups(old * (n + 1) + rank[np.minimum(here + step, after[here])])
        here, old = here[order], old[order]
        begins = np.ones(len(here), dtype=bool)
        begins[1:] = old[1:] != old[:-1]
        begins = np.maximum.accumulate(np.where(begins, np.arange(len(here)), 0))
        rank[here] = old + first - begins
        step *= 2
        here = here[(size > 1) & (after[here] - here >= step)]
    return rank


def _induce_names(t: np.ndarray, s: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Ranks of all suffixes of ``t``, which ends in a letter smaller than all others, from ranks ``order`` of ``lms``; equal ranks stay equal."""
    n = len(t)
    is_lms = np.zeros(n, dtype=bool)
    is_lms[lms] = True
    wide = np.int64(len(lms) + 1)
    # L suffixes come before S suffixes of the same first letter.
    key = t.astype(np.int64) * 2 * wide
    key[lms] += wide + order
    upper = ~s | is_lms
    at = np.flatnonzero(upper)
    # An L suffix is followed by an L suffix or by an LMS, so the chain has no gaps.
    ranks = np.empty(n, dtype=np.int64)
    ranks[at] = _along_chains(key[at], is_lms[at])
    lower = ~s
    lower[n - 1] = True
    wide = np.int64(len(at) + 1)
    key = t.astype(np.int64) * 2 * wide
    key[s] += wide
    key[lower] += ranks[lower]
    return _along_chains(key, lower)


def _sorted_names(t: np.ndarray) -> np.ndarray:
    """Ranks of the suffixes of a string of names; its last letter is smaller than all others."""
    n = len(t)
    if int(t.max()) + 1 == n:
        return t.astype(np.int64)
    s = _smaller_than_next(t)
    s[n - 1] = True
    lms = _leftmost(s)
    if len(lms) < 2:
        order = np.zeros(len(lms), dtype=np.int64)
    else:
        # Substrings first: LMS suffixes count by their first letter alone.
        ranks, first, size = _groups(_induce_names(t, s, lms, np.zeros(len(lms), dtype=np.int64))[lms])
        names = np.empty(len(lms), dtype=np.int64)
        names[ranks] = np.cumsum(first == np.arange(len(lms))) - 1
        order = _sorted_names(names)
    return _induce_names(t, s, lms, order)


def _same_bytes(t: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether ``size`` bytes from ``a`` and from ``b`` are the same."""
    padded = np.concatenate([t, np.zeros(8, dtype=np.uint8)])
    eights = np.ndarray(len(t) + 1, dtype="<u8", buffer=padded, strides=(1,))
    same = np.ones(len(a), dtype=bool)
    left = size.copy()
    who = np.arange(len(a))
    while len(who):
        shift = (8 * (8 - np.minimum(left, 8))).astype(np.uint64)
        equal = ((eights[a] ^ eights[b]) << shift) == 0
        same[who[~equal]] = False
        more = equal & (left > 8)
        a, b, left, who = a[more] + 8, b[more] + 8, left[more] - 8, who[more]
    return same


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of the bytes ``t`` in their order."""
    n = len(t)
    if n == 0:
        return np.empty(0, dtype=np.int32)
    s = _smaller_than_next(t)
    lms = _leftmost(s).astype(np.int32)
    if len(lms) < 2:
        return _induce_bytes(t, lms)
    is_lms = np.zeros(n, dtype=bool)
    is_lms[lms] = True
    order = _induce_bytes(t, lms)
    order = order[is_lms[order]]
    number = np.empty(n, dtype=np.int32)
    number[lms] = np.arange(len(lms), dtype=np.int32)
    # A substring ends with the next LMS; the last one ends with the text, which no other does.
    size = np.append(np.diff(lms) + 1, n + 1)[number[order]]
    a, b = order[:-1].astype(np.int64), order[1:].astype(np.int64)
    alike = size[:-1] == size[1:]
    alike[alike] = _same_bytes(t, a[alike], b[alike], size[:-1][alike].astype(np.int64))
    names = np.empty(len(lms) + 1, dtype=np.int64)
    names[number[order]] = np.append(0, np.cumsum(~alike)) + 1
    names[-1] = 0
    ranks = _sorted_names(names)[:-1] - 1
    in_order = np.empty(len(lms), dtype=np.int32)
    in_order[ranks] = lms
    return _induce_bytes(t, in_order)


def common_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each position of ``t``, the length that its suffix shares with the one before it in ``sa`` (0 for the first).

    In text order a value falls by one where the letters before both suffixes are the
    same; the others are found by comparison, which is n log n letters in all.
    """
    n = len(t)
    if n == 0:
        return np.empty(0, dtype=np.int32)
    before = np.full(n, -1, dtype=np.int32)
    before[sa[1:]] = sa[:-1]
    apart = np.ones(n, dtype=bool)
    inner = np.flatnonzero((before[1:] > 0) & (before[:-1] >= 0)) + 1
    apart[inner] = t[inner - 1] != t[before[inner] - 1]
    starts = np.flatnonzero(apart)
    shared = np.zeros(len(starts), dtype=np.int32)
    who = np.flatnonzero(before[starts] >= 0)
    a, b = starts[who], before[starts[who]].astype(np.int64)
    padded = np.concatenate([t, np.zeros(16, dtype=np.uint8)])
    eights = np.ndarray(n + 9, dtype="<u8", buffer=padded, strides=(1,))
    while len(who):
        differ = eights[a] ^ eights[b]
        room = n - np.maximum(a, b)
        # The lowest byte that differs.
        low = differ & (~differ + np.uint64(1))
        same = np.where(differ == 0, 8, (np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64)) >> 3)
        same = np.minimum(same, room)
        shared[who] += same.astype(np.int32)
        more = (same == 8) & (room > 8)
        a, b, who = a[more] + 8, b[more] + 8, who[more]
    origin = np.where(apart, np.arange(n, dtype=np.int32), 0)
    origin = np.maximum.accumulate(origin)
    filled = np.zeros(n, dtype=np.int32)
    filled[starts] = shared
    return np.maximum(filled[origin] - (np.arange(n, dtype=np.int32) - origin), 0)
