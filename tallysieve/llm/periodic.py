"""Periodic runs of words, found by a suffix automaton with merged end positions.

A run is a stretch of consecutive words with smallest period q, at least ``least`` words
and ``times`` periods long, that can't grow on either side and keep its period.

The automaton's states stand for the substrings of a stretch of words; each has a longest
length and an ordered set of the places where it ends.  Sets are merged from long states
to short ones along suffix links, the smaller into the larger.  Two places that become
neighbours in a state whose length is not less than their distance d end a square of
period d: the state's length is what both have in common to their left, so the run starts
where that starts, and words are compared to the right only.  Every run has such a pair of
neighbours, since a place between the two would give a shorter period.

Before that, texts are looked through for stretches that may hold a run at all.  In a run
of period q every ``GRAM`` words that follow the first q stand q words earlier too, so an
equal gram is near, and there are many in a row.  Stretches that hold no such row hold no
run; for those that do, the automaton gets all words that a run there could touch and one
more on each side.  Nothing else is left out.

Defined results: words are runs without blanks (0x20, 0x09-0x0D), compared byte by byte; a
null, empty or blank text has no words, no runs and collapses to the empty text; a text of
any length is looked at whole, where the automaton takes about one kilobyte for each word of
a stretch that may hold a run; repeated rows are rows of their own; null ids are kept; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallysieve.llm.textkit import mix64, raw_texts, spans_of_rows, text_or_empty

LEAST, TIMES = 24, 3
#: Words that are compared at once in the search for stretches.
GRAM = 8


def squares(words: list[int]) -> Iterator[tuple[int, int, int]]:
    """(start, place, period): from ``start`` to ``place + period``, words are the same as ``period`` words on; start can't be less."""
    length, link, ways = [0], [-1], [{}]
    last = 0
    own = [-1]
    for at, w in enumerate(words):
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        ways.append({})
        own.append(at)
        p, last = last, new
        while p >= 0 and w not in ways[p]:
            ways[p][w] = new
            p = link[p]
        if p < 0:
            continue
        q = ways[p][w]
        if length[q] == length[p] + 1:
            link[new] = q
            continue
        copy = len(length)
        length.append(length[p] + 1)
        link.append(link[q])
        ways.append(ways[q].copy())
        own.append(-1)
        while p >= 0 and ways[p].get(w) == q:
            ways[p][w] = copy
            p = link[p]
        link[q] = link[new] = copy
    del ways
    ends: list[list[int] | None] = [[at] if at >= 0 else [] for at in own]
    for v in np.argsort(np.array(length), kind="stable")[:0:-1].tolist():
        up = link[v]
        mine, ends[v] = ends[v], None
        if up == 0:
            # The empty substring's neighbours share nothing.
            continue
        large = ends[up]
        if len(mine) > len(large):
            mine, large = large, mine
        size = length[up]
        for x in mine:
            k = bisect_left(large, x)
            if k and x - large[k - 1] <= size:
                yield large[k - 1] - size + 1, large[k - 1], x - large[k - 1]
            if k < len(large) and large[k] - x <= size:
                yield x - size + 1, x, large[k] - x
        if len(mine) > 8:
            large = large + mine
            large.sort()
        else:
            for x in mine:
                large.insert(bisect_left(large, x), x)
        ends[up] = large


def runs_in(words: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, in order."""
    n = len(words)
    seen: set[tuple[int, int]] = set()
    found: dict[tuple[int, int], int] = {}
    for start, place, period in squares(words):
        if (start, period) in seen:
            continue
        seen.add((start, period))
        end = place + period + 1
        while end < n and words[end] == words[end - period]:
            end += 1
        size = end - start
        if size >= least and size >= times * period:
            # A multiple of the smallest period shows the same stretch.
            found[start, size] = min(period, found.get((start, size), period))
    return sorted((start, size, period) for (start, size), period in found.items())


def stretches(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int]]:
    """Ranges of words outside of which no run can lie; a range holds a run whole, with a word on each side."""
    n = len(ids)
    gram = min(GRAM, least // times)
    if n < least or gram < 1:
        return [(0, n)] if n >= least else []
    h = np.zeros(n - gram + 1, dtype=np.uint64)
    for k in range(gram):
        h = mix64(h * np.uint64(31) + ids[k : n - gram + 1 + k])
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return []
    ahead = np.full(len(h), n, dtype=np.int64)
    ahead[order[1:][same]] = (order[1:] - order[:-1])[same]
    seen = ahead < n
    edges = np.flatnonzero(np.diff(np.concatenate([[False], seen, [False]]).astype(np.int8)))
    out: list[tuple[int, int]] = []
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        # A run of period q has size - q - gram + 1 such places at least; so q is at most:
        most = (b - a + gram - 1) // (times - 1)
        if b - a + most + gram - 1 < least or int(ahead[a:b].min()) > most:
            continue
        lo, hi = max(0, a - most - 1), min(n, b + gram)
        while out and lo <= out[-1][1]:
            before = out.pop()
            lo, hi = min(lo, before[0]), max(hi, before[1])
        out.append((lo, hi))
    return out


def text_runs(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text's words, given as numbers; in order of start, then period."""
    out = []
    for a, b in stretches(ids, least, times):
        out += [(a + start, size, period) for start, size, period in runs_in(ids[a:b].tolist(), least, times)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds beyond its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    stay = np.zeros(len(words) + 1, dtype=np.int64)
    for start, size, period in runs:
        stay[start + period] += 1
        stay[start + size] -= 1
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(stay[:-1]) == 0).tolist()])


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of most periods, exactly; of equals the one that starts first, then that of the smallest period."""
    if len(runs) < 2:
        return runs[0] if runs else None
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _named(r: tuple[int, int, int] | None) -> dict[str, int] | None:
    return r and {"start": r[0], "length": r[1], "period": r[2]}


def collapse_runs(docs: DataFrame, *, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n_words, runs (start, length and period of each, by start, then period), best (the strongest) and collapsed of every row."""
    if times < 2 or least < times:
        raise ValueError("a run has two periods at least, and a word for each")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw_texts(batch.column(1))
            for a, b in spans_of_rows(offsets, 2 << 20):
                counts, found, best, texts = [], [], [], []
                for lo, hi in zip(offsets[a:b], offsets[a + 1 : b + 1]):
                    words = data[lo:hi].tobytes().split()
                    numbers: dict[bytes, int] = {}
                    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.uint64)
                    runs = text_runs(ids, least, times)
                    counts.append(len(words))
                    found.append([_named(r) for r in runs])
                    best.append(_named(strongest(runs)))
                    texts.append(collapsed(words, runs).decode("utf-8", "replace"))
                columns = [pa.array(counts, type=pa.int64()), pa.array(found, type=pa.list_(_RUN)), pa.array(best, type=_RUN), pa.array(texts, type=pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], names=["doc_id", "n_words", "runs", "best", "collapsed"])

    rows = docs.select("doc_id", text_or_empty().alias("text"))
    one = "struct<start:long,length:long,period:long>"
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, runs array<{one}>, best {one}, collapsed string")
