"""Presence features of whole texts, a bounded labelled sample and feature screening.

A feature is a 64-bit hash: of a word, of a pair of neighbouring character
classes at a rate level, or of a text statistic at a level.  Fitting takes a
sample of labelled rows whose size is a parameter; scoring takes every row.  The
sample's features stay in the shared folder: their counts are summed by Spark, and only
the features that pass the screen, at most ``MOST_FEATURES``, and their places in the
sampled rows come to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallysieve.llm.textkit import Words, mix64, raw_texts, saved, shingle_hashes, spans_of_rows, stored, text_or_empty, word_chunks

SAMPLE_ROWS, MOST_FEATURES = 20_000, 1 << 18
SLICE_BYTES = 1 << 21
_GRAIN = 1 << 30

#: Character classes: each ASCII sign for itself, letters by case, digits, blanks, the rest.
_CLASS = np.full(256, 63, dtype=np.int64)
_CLASS[:128] = [0] * 33 + list(range(1, 16)) + [16] * 10 + list(range(17, 24)) + [24] * 26 + list(range(25, 31)) + [31] * 26 + list(range(32, 36)) + [36]


def word_features(words: Words, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) for each distinct word of each text."""
    return distinct_pairs(words.doc, words.hashes())


def style_features(words: Words, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, character-class pairs by rate, and how often words repeat."""
    docs = len(words.counts)
    hashes = words.hashes()
    who, what = distinct_pairs(words.doc, hashes)
    kinds = np.bincount(who, minlength=docs)
    ratio = np.where(words.counts > 0, 8 * kinds // np.maximum(words.counts, 1), 9)
    sizes = np.diff(words.offsets)
    classes = _CLASS[raw]
    doc = np.repeat(np.arange(docs), sizes)
    inner = doc[1:] == doc[:-1] if len(doc) else np.empty(0, dtype=bool)
    cell = (doc[:-1] * 4096 + classes[:-1] * 64 + classes[1:])[inner] if len(doc) else np.empty(0, dtype=np.int64)
    counts = np.bincount(cell, minlength=docs * 4096).reshape(docs, 4096)
    rows, codes = np.nonzero(counts)
    level = np.log2(1 + 1000 * counts[rows, codes] / np.maximum(sizes[rows], 1)).astype(np.int64)
    pairs = mix64(((codes << 8) + level + (1 << 40)).astype(np.uint64))
    size_level = np.log2(1 + words.counts).astype(np.int64)
    repeats = mix64(((size_level << 8) + ratio + (1 << 41)).astype(np.uint64))
    return (
        np.concatenate([who, rows, np.arange(docs)]),
        np.concatenate([what, pairs, repeats]),
    )


def distinct_pairs(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(h):
        return doc, h
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


Extract = Callable[[Words, np.ndarray], tuple[np.ndarray, np.ndarray]]


def chunk_features(column: pa.Array, extract: Extract) -> Iterator[tuple[int, int, Words, np.ndarray, np.ndarray]]:
    data, offsets = raw_texts(column)
    for a, b, words in word_chunks(column):
        who, what = extract(words, data[offsets[a] : offsets[b]])
        yield a, b, words, who, what


@dataclass
class Sample:
    """Sampled rows: the table (row, y, f, swapped) of features, and the rows that count with their labels."""

    table: DataFrame
    rows: np.ndarray
    y: np.ndarray


def sample(docs: DataFrame, labels: DataFrame, value: Column, trains: Column, rows: int, extract: Extract, swaps: dict[int, int] | None = None) -> Sample:
    """About ``rows`` labelled documents, chosen by hashes of their id and text.

    ``value`` is the label, null where there is none; an id that is labelled more
    than once takes its largest.  ``trains`` tells which ids may be learned from.
    Copies and most near copies count once: of the texts that share one of two
    minimum shingle hashes only one is kept, whichever its hash puts first.  ``swaps``
    maps word hashes to those of their counterparts; texts with such words also come
    in swapped form.
    """
    known = labels.select("doc_id", value.cast("double").alias("y")).where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & trains)
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    total = known.count()
    if total > rows:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(_GRAIN)) < int(_GRAIN * rows / total))
    chosen = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(known), "doc_id").withColumn("tie", F.xxhash64("text", "doc_id"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words, who, what in chunk_features(batch.column("text"), extract):
                order = np.argsort(who, kind="stable")
                who, what = who[order], what[order]
                ends = np.searchsorted(who, np.arange(b - a + 1))
                s, d = shingle_hashes(words.hashes(), words.counts, 5)
                lows = [np.full(b - a, np.iinfo(np.int64).max) for _ in range(2)]
                for k, low in enumerate(lows):
                    np.minimum.at(low, d, (mix64(s + np.uint64(k)) >> np.uint64(1)).astype(np.int64))
                own = [what[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]
                other = [swapped_form(x, swaps) if swaps else None for x in own]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [part.column("y"), part.column("tie"), *map(pa.array, lows), pa.array([x.tobytes() for x in own], pa.binary()), pa.array([None if x is None else x.tobytes() for x in other], pa.binary())],
                    names=["y", "tie", "m1", "m2", "f", "swapped"],
                )

    table = chosen.select("text", "y", "tie").mapInArrow(gather, "y double, tie long, m1 long, m2 long, f binary, swapped binary")
    table = stored(table.withColumn("row", F.monotonically_increasing_id()), "sample")
    first = table.groupBy("m1", "m2").agg(F.min(F.struct("tie", "row", "y")).alias("one")).select("m1", "m2", "one.*")
    count = first.count()
    if count > 2 * rows:  # one id can have many texts
        first = first.where(F.pmod(F.xxhash64("tie"), F.lit(_GRAIN)) < int(_GRAIN * rows / count))
    got = first.toArrow()
    m1, m2, tie, row, y = (got.column(n).to_numpy() for n in ("m1", "m2", "tie", "row", "y"))
    seen: tuple[set[int], set[int]] = (set(), set())
    kept = []
    for k in np.lexsort((tie, m2, m1)).tolist():
        if m1[k] not in seen[0] and m2[k] not in seen[1]:
            kept.append(k)
            seen[0].add(m1[k])
            seen[1].add(m2[k])
    kept = np.array(sorted(kept, key=lambda k: row[k]), dtype=np.int64)
    return Sample(table, row[kept], y[kept])


def _views(column: pa.Array) -> list[np.ndarray | None]:
    return [np.frombuffer(x.as_buffer(), dtype=np.uint64) if x.is_valid else None for x in column]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most about ``SLICE_BYTES`` of features; a longer row is a part of its own."""
    for batch in batches:
        _, offsets = raw_texts(batch.column("f"))
        for a, b in spans_of_rows(offsets, SLICE_BYTES):
            yield batch.slice(a, b - a)


def screened(part: Sample, targets: list[np.ndarray], least: int = 3) -> np.ndarray:
    """``screen`` of a sample for each target (0 or 1 by row), together; counts are summed by Spark."""
    targets = [t for t in targets if 0 < t.sum() < len(t)]
    if not targets:
        return np.empty(0, dtype=np.uint64)
    rows = part.rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            at, hit = _located(batch.column("row").to_numpy(), rows)
            feats = _views(batch.column("f").filter(pa.array(hit)))
            flat = np.concatenate([*feats, np.empty(0, dtype=np.uint64)])
            ids, inverse, df = np.unique(flat, return_inverse=True, return_counts=True)
            who = np.repeat(at, [len(x) for x in feats])
            ups = [np.bincount(inverse, weights=t[who], minlength=len(ids)) for t in targets]
            yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(df.astype(np.int64)), *map(pa.array, ups)], names=["id", "df", *(f"up{k}" for k in range(len(ups)))])

    names = [f"up{k}" for k in range(len(targets))]
    counts = part.table.select("row", "f").mapInArrow(count, "id long, df long, " + ", ".join(f"{n} double" for n in names))
    counts = saved(counts.groupBy("id").agg(*(F.sum(c).alias(c) for c in ("df", *names))).where(F.col("df") >= least))
    tested, n = counts.count(), len(rows)
    df, scores = F.col("df"), []
    for name, t in zip(names, targets, strict=True):
        p = float(t.mean())
        scores.append(F.abs((F.col(name) - df * p) / F.sqrt(F.greatest(df * (1 - df / (n + 1)) * (p * (1 - p)), F.lit(1e-9)))))
    strength = F.greatest(*scores) if len(scores) > 1 else scores[0]
    best = counts.select("id", strength.alias("z")).where(F.col("z") > float(np.sqrt(2 * np.log(max(2, tested))))).orderBy(F.desc("z"), "id").limit(MOST_FEATURES)
    return np.sort(best.toArrow().column("id").to_numpy().view(np.uint64))


def _located(row: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in the ascending ``rows`` of those that are there, which are)."""
    at = np.minimum(np.searchsorted(rows, row), max(0, len(rows) - 1))
    hit = rows[at] == row if len(rows) else np.zeros(len(row), dtype=bool)
    return at[hit], hit


def places(part: Sample, chosen: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray], int]:
    """(row, column) of each chosen feature in the sampled rows and in their swapped forms, and how many rows have one."""
    rows = part.rows

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            at, hit = _located(batch.column("row").to_numpy(), rows)
            plain, swapped = (_views(batch.column(n).filter(pa.array(hit))) for n in ("f", "swapped"))
            for form, feats in ((0, plain), (1, [p if s is None else s for p, s in zip(plain, swapped, strict=True)])):
                r, c = matrix(feats, chosen)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), form, dtype=np.int32)), pa.array(at[r].astype(np.int32)), pa.array(c.astype(np.int32))], names=["form", "r", "c"])
            changed = sum(s is not None for s in swapped)
            yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([changed], pa.int32()), pa.array([0], pa.int32())], names=["form", "r", "c"])

    got = part.table.select("row", "f", "swapped").mapInArrow(find, "form int, r int, c int").toArrow()
    form, r, c = (got.column(n).to_numpy().astype(np.int64) for n in ("form", "r", "c"))
    order = np.lexsort((c, r))
    form, r, c = form[order], r[order], c[order]
    return (r[form == 0], c[form == 0]), (r[form == 1], c[form == 1]), int(r[form == 2].sum())


def swapped_form(own: np.ndarray, swaps: dict[int, int]) -> np.ndarray | None:
    """The features with each identity term replaced by its counterpart; None where there is none."""
    keys = np.fromiter(swaps, dtype=np.uint64, count=len(swaps))
    hit = np.isin(own, keys)
    if not hit.any():
        return None
    return np.unique(np.concatenate([own[~hit], np.array([swaps[int(h)] for h in own[hit]], dtype=np.uint64)]))


def screen(feats: list[np.ndarray], y: np.ndarray, least: int = 3) -> np.ndarray:
    """Sorted features whose presence goes with ``y`` (0 or 1) beyond chance.

    A feature stays if it is in ``least`` texts and its standard score exceeds
    what the largest of so many unrelated features would reach.
    """
    if not feats or len(set(y.tolist())) < 2:
        return np.empty(0, dtype=np.uint64)
    rows = np.repeat(np.arange(len(feats)), [len(f) for f in feats])
    ids, inverse, df = np.unique(np.concatenate(feats), return_inverse=True, return_counts=True)
    up = np.bincount(inverse, weights=y[rows], minlength=len(ids))
    ids, df, up = ids[df >= least], df[df >= least], up[df >= least]
    p, n = y.mean(), len(y)
    z = (up - df * p) / np.sqrt(np.maximum(df * (1 - df / (n + 1)) * p * (1 - p), 1e-9))
    return np.sort(ids[np.abs(z) > np.sqrt(2 * np.log(max(2, len(ids))))])


def matrix(feats: list[np.ndarray], chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each chosen feature that is present."""
    rows = np.repeat(np.arange(len(feats)), [len(f) for f in feats])
    return located(rows, np.concatenate(feats) if feats else np.empty(0, dtype=np.uint64), chosen)


def located(rows: np.ndarray, what: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(chosen) or not len(what):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    at = np.minimum(np.searchsorted(chosen, what), len(chosen) - 1)
    hit = chosen[at] == what
    return rows[hit], at[hit]


def linear(rows: np.ndarray, cols: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights=weights[cols], minlength=n)[:n]


def descend(gradient: Callable[[np.ndarray], np.ndarray], start: np.ndarray, rounds: int = 400, rate: float = 0.1) -> np.ndarray:
    """Adam over the full sample; ``rate`` falls to zero."""
    x, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, rounds + 1):
        g = gradient(x)
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        x -= rate * (1 - (t - 1) / rounds) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return x


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))
