"""Removal of byte strings that stand more than once in a corpus, by suffix arrays.

A *window* is a string of ``length`` bytes.  Equal windows hold the same smallest hash of
their ``GRAM``-byte strings, their *key*; so windows are split by key, and no two equal
windows are apart.  Consecutive windows of one key in a text are a *fragment*, the bytes
that they cover.  Keys that one window alone has can't repeat and go at once; of the
fragments of the others each different one is kept with its number of copies.  Shards of
whole keys, of about ``SHARD_BYTES``, are then each sorted into a suffix array
(``suffixes``: induced sorting, permuted common prefixes).  Windows that are equal are
neighbours there with a common prefix of ``length`` or more; where such a stretch of the
array stands for two or more copies, its windows are repeats.

A key with very many different fragments (a passage that a third of all texts hold, each
with another text around it) is no shard: its windows are counted by two 64-bit hashes, so
that any number of tasks can share them, with partial sums before the shuffle.  They are
counted in bins of neighbours first, so that rows are made for single windows only near the
ends of what fragments share, not for each byte.

Texts are stored once, compressed, in the shared folder; all else that moves is narrow,
but for the fragments.  Two different fragments or windows of one key are taken as the
same where another 64-bit hash of theirs collides too.

Defined results: a null or empty text, or one shorter than ``length``, loses nothing; a
text of any length is handled in pieces of ``MOST_WINDOWS`` windows; texts that are alike,
rows that are alike and a text with itself repeat each other; null ids are kept as they are
and repeated ids are rows of their own; other columns are ignored, so their names can't
clash; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallysieve.llm.suffixes import common_prefixes, suffix_array
from tallysieve.llm.textkit import mix64, raw_texts, spans_of_rows, stored, text_or_empty

LENGTH = 400
#: Bytes of the strings whose smallest hash is a window's key.
GRAM = 32
#: A fragment has at most this many windows.
MOST_WINDOWS = 4096
#: A shard's bytes, about; a key of more than ``HOT_BYTES`` is counted instead.
SHARD_BYTES, HOT_BYTES = 1 << 20, 2 << 20
#: Windows in a bin of a key that is counted; bins that are not settled are split to the next width.
BINS = (64, 16, 4, 1)
#: Ends a fragment in a shard, before its number.
_END = np.frombuffer(b"\xff", dtype=np.uint8)

_PIECE = np.uint64(0xD6E8FEB86659FD93)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_RUNS = pa.list_(pa.struct([("key", pa.int64()), ("print", pa.int64()), ("lo", pa.int32()), ("n", pa.int32()), ("twice", pa.bool_())]))

_NONE = tuple(np.empty(0, dtype=f.type.to_pandas_dtype()) for f in _RUNS.value_type)


def gram_hashes(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A 64-bit hash of every string of ``size`` bytes, a multiple of eight."""
    eights = np.ndarray(len(data) - 7, dtype="<u8", buffer=np.ascontiguousarray(data), strides=(1,))
    n = len(data) - size + 1
    acc = np.zeros(n, dtype=np.uint64)
    for k in range(0, size, 8):
        acc = (acc ^ eights[k : k + n]) * _PIECE
        acc ^= acc >> np.uint64(32)
    return mix64(acc)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values."""
    n = len(x) - width + 1
    rows = -(-len(x) // width)
    padded = np.full(rows * width, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[: len(x)] = x
    block = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


class Prints:
    """64-bit hashes of any substrings of some bytes: a polynomial over scrambled strings of eight, by prefix sums."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
        eights = np.ndarray(len(data), dtype="<u8", buffer=padded, strides=(1,))
        # Strings that hang over a substring's end are left out by ``of``.
        power = np.cumprod(np.full(len(data), _ODD, dtype=np.uint64))
        self.sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix64(eights) * power, dtype=np.uint64)])

    def of(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Hashes of ``size`` bytes, eight at least, from each start."""
        return mix64((self.sums[start + size - 7] - self.sums[start]) * _back(start))


def _back(start: np.ndarray) -> np.ndarray:
    """Powers of the inverse of ``_ODD``."""
    out = np.ones(len(start), dtype=np.uint64)
    base, left = _ODD_BACK, start.astype(np.int64)
    with np.errstate(over="ignore"):
        while left.any():
            odd = (left & 1).astype(bool)
            out[odd] *= base
            base, left = base * base, left >> 1
    return out


def fragments(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, print, first window, windows, whether its key's string stands in it twice) of a text's fragments."""
    grams = gram_hashes(data)
    keys = sliding_least(grams, length - GRAM + 1)
    lo = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    n = np.diff(np.append(lo, len(keys)))
    parts = -(-n // MOST_WINDOWS)
    if (parts > 1).any():
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        lo, rest = np.repeat(lo, parts) + nth * MOST_WINDOWS, np.repeat(n, parts) - nth * MOST_WINDOWS
        n = np.minimum(rest, MOST_WINDOWS)
    key = keys[lo]
    # Places of strings that may be keys, then those that are, by key and place.
    maybe = np.zeros(1 << 16, dtype=bool)
    maybe[key >> np.uint64(48)] = True
    at = np.flatnonzero(maybe[grams >> np.uint64(48)])
    distinct = np.unique(key)
    nth = np.minimum(np.searchsorted(distinct, grams[at]), len(distinct) - 1)
    true = distinct[nth] == grams[at]
    places = np.sort(nth[true] * len(data) + at[true])
    mine = np.searchsorted(distinct, key) * len(data) + lo
    twice = np.searchsorted(places, mine + n + length - GRAM) - np.searchsorted(places, mine) > 1
    return key.view(np.int64), Prints(data).of(lo, n + length - 1).view(np.int64), lo, n, twice


def _store(docs: DataFrame, length: int) -> DataFrame:
    """row, doc_id, z (the compressed text) and the runs of windows of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            data, offsets = raw_texts(batch.column(2))
            for a, b in spans_of_rows(offsets, 4 << 20):
                packed, sizes, parts = [], [0], []
                for lo, hi in zip(offsets[a:b], offsets[a + 1 : b + 1]):
                    text = data[lo:hi]
                    packed.append(pack.compress(text.tobytes()))
                    parts.append(fragments(text, length) if len(text) >= length else _NONE)
                    sizes.append(sizes[-1] + len(parts[-1][0]))
                joined = [pa.array(np.concatenate([p[k] for p in parts]).astype(f.type.to_pandas_dtype())) for k, f in enumerate(_RUNS.value_type)]
                runs = pa.ListArray.from_arrays(pa.array(sizes, type=pa.int32()), pa.StructArray.from_arrays(joined, fields=list(_RUNS.value_type)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(packed, type=pa.binary()), runs], names=["row", "doc_id", "z", "runs"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text_or_empty().alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return stored(rows.mapInArrow(run, f"row long, doc_id {kind}, z binary, runs array<struct<key:long,print:long,lo:int,n:int,twice:boolean>>"), "texts")


def _together(held: list[pa.StructArray], cut: list[bytes], names: list[str]) -> pa.RecordBatch:
    pieces = pa.concat_arrays(held)
    return pa.RecordBatch.from_arrays([*(pieces.field(name) for name in names), pa.array(cut, type=pa.binary())], names=[*names, "cut"])


def _cut(texts: DataFrame, length: int) -> DataFrame:
    """The bytes of the fragments that stand in ``pieces`` (key, print, n, lo, copies, hot) of every text."""

    names = ["key", "print", "n", "copies", "hot"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        held, cut, size = [], [], 0
        for batch in batches:
            for z, pieces in zip(batch.column(0), batch.column(1)):
                text, pieces = unpack.decompress(z.as_py()), pieces.values
                lo, n = pieces.field("lo").to_numpy(), pieces.field("n").to_numpy()
                for a, b in spans_of_rows(np.append(0, np.cumsum(n + length - 1)), 1 << 20):
                    held.append(pieces.slice(a, b - a))
                    cut.extend(text[i : i + m + length - 1] for i, m in zip(lo[a:b].tolist(), n[a:b].tolist()))
                    size += int(n[a:b].sum()) + (b - a) * length
                    if size >= 4 << 20:
                        yield _together(held, cut, names)
                        held, cut, size = [], [], 0
        if cut:
            yield _together(held, cut, names)

    return texts.mapInArrow(run, "key long, print long, n int, copies long, hot boolean, cut binary")


def repeated_windows(cuts: list[bytes], copies: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(fragment, window) of all windows of the fragments ``cuts`` that stand more than once among all their copies."""
    numbers = np.arange(len(cuts), dtype="<u4").view(np.uint8).reshape(-1, 4)
    sizes = np.array([len(c) for c in cuts], dtype=np.int64)
    begins = np.cumsum(sizes + 5) - sizes - 5
    t = np.empty(int((sizes + 5).sum()), dtype=np.uint8)
    for k, cut in enumerate(cuts):
        at = begins[k]
        t[at : at + sizes[k]] = np.frombuffer(cut, dtype=np.uint8)
        t[at + sizes[k]] = _END[0]
        t[at + sizes[k] + 1 : at + sizes[k] + 5] = numbers[k]
    sa = suffix_array(t)
    shared = common_prefixes(t, sa)
    of = np.repeat(np.arange(len(cuts), dtype=np.int32), sizes + 5)
    # Windows that end with their fragment at the latest.
    inside = np.arange(len(t)) - begins[of] + length <= sizes[of]
    stretch = np.cumsum(shared[sa] < length)
    whole = inside[sa]
    weight = np.bincount(stretch[whole], weights=copies[of[sa[whole]]].astype(np.float64), minlength=int(stretch[-1]) + 1)
    at = np.sort(sa[whole & (weight[stretch] >= 2)])
    return of[at], at - begins[of[at]]


def as_ranges(which: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which, first, last) of stretches of consecutive numbers, which are sorted in each ``which``."""
    if not len(at):
        return which, at, at
    new = np.append(True, (which[1:] != which[:-1]) | (at[1:] != at[:-1] + 1))
    first = np.flatnonzero(new)
    return which[first], at[first], at[np.append(first[1:], len(at)) - 1]


_RANGES = "array<struct<a:int,b:int>>"
_STRING = "struct<whole:long,tail:long,size:int>"
_MARKS = f"key long, print long, n int, marks {_RANGES}"


def _ranges_of(sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.ListArray:
    ranges = pa.StructArray.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=["a", "b"])
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), ranges)


def _marked(names: pa.Table, which: np.ndarray, window: np.ndarray) -> pa.Table:
    """One row for each fragment ``names`` with repeated windows: its names and the stretches a..b of those windows, sorted."""
    which, a, b = as_ranges(which, window)
    first = np.flatnonzero(np.append(True, which[1:] != which[:-1])) if len(which) else which
    return names.take(pa.array(which[first])).append_column("marks", _ranges_of(np.diff(np.append(first, len(which))), a, b))


def _sorted_shards(cut: DataFrame, length: int, shards: int) -> DataFrame:
    """Repeated windows of the fragments, by the suffix arrays of shards of whole keys."""

    def run(table: pa.Table) -> pa.Table:
        cuts = table.column("cut").to_pylist()
        return _marked(table.select(["key", "print", "n"]), *repeated_windows(cuts, table.column("copies").to_numpy(), length))

    return cut.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).groupBy("shard").applyInArrow(run, _MARKS)


def binned(text: np.ndarray, key: int, windows: np.ndarray, length: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, start of the core) of the bins of some ``windows`` of a fragment, which are sorted.

    A bin has windows whose first string of hash ``key`` is the same and as far from their start, but for less than
    ``width``; a window without that string is one bin.  A bin's core are the ``length`` - ``width`` + 1 bytes that all
    windows of a whole bin share.  Where they stand follows from any of its windows, so equal windows have equal cores.
    """
    anchors = np.append(np.flatnonzero(gram_hashes(text).view(np.int64) == key), len(text))
    anchor = anchors[np.searchsorted(anchors, windows)]
    anchor = np.where(anchor > windows + length - GRAM, windows, anchor)
    core = anchor - (anchor - windows) // width * width
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (core[1:] != core[:-1]) | (windows[1:] != windows[:-1] + 1))
    first = np.flatnonzero(new)
    return windows[first], windows[np.append(first[1:], len(windows)) - 1], core[first]


def _bins(pieces: DataFrame, length: int, width: int) -> DataFrame:
    """One row for each different bin of the fragments (key, print, n, copies, cut) in their windows ``ranges`` and ``known``, with all its places there.

    Bins of ``known`` count once, others as often as their fragment has copies.
    """

    def rows(batch: pa.RecordBatch, found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        a, b, *same = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((a, *same))
        a, b, *same = (x[order] for x in (a, b, *same))
        first = np.flatnonzero(np.append(True, np.any([x[1:] != x[:-1] for x in same], axis=0)))
        places = np.diff(np.append(first, len(a)))
        known, *strings, of = (x[first] for x in same)
        copies = np.where(known, 1, batch.column(3).to_numpy()[of]) * places
        core, hull = (pa.StructArray.from_arrays([pa.array(x) for x in strings[k : k + 3]], names=["whole", "tail", "size"]) for k in (0, 3))
        names = [column.take(pa.array(of)) for column in batch.columns[:3]]
        return pa.RecordBatch.from_arrays([*names, pa.array(copies), _ranges_of(places, a, b), pa.array(known), core, hull], names=["key", "print", "n", "copies", "ranges", "known", "core", "hull"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, held = [], 0
            for k, (key, cut, *ranges) in enumerate(zip(batch.column(0), *batch.columns[4:])):
                text = np.frombuffer(cut.as_py(), dtype=np.uint8)
                tails, prints = gram_hashes(text).view(np.int64), Prints(text)
                for known, part in enumerate(ranges):
                    if not (part := part.as_py()):
                        continue
                    a, b, core = binned(text, key.as_py(), np.concatenate([np.arange(r["a"], r["b"] + 1) for r in part]), length, width)
                    strings = []
                    for start, size in ((core, np.full(len(a), length - width + 1)), (a, b - a + length)):
                        strings += [prints.of(start, size).view(np.int64), tails[start + size - GRAM], size.astype(np.int32)]
                    found.append((a, b, np.full(len(a), bool(known)), *strings, np.full(len(a), k)))
                    held += len(a)
                if held >= 1 << 16:
                    yield rows(batch, found)
                    found, held = [], 0
            if found:
                yield rows(batch, found)

    made = f"key long, print long, n int, copies long, ranges {_RANGES}, known boolean, core {_STRING}, hull {_STRING}"
    return pieces.select("key", "print", "n", "copies", "cut", "ranges", "known").mapInArrow(run, made)


def _settled(pieces: DataFrame, length: int, width: int) -> DataFrame:
    """key, print, n, ranges, known of the bins whose core repeats, ``many``: whether all of their windows do, and ``more``: whether they are to be split."""
    bins = stored(_bins(pieces, length, width), "bins")
    at = F.struct("print", "n", F.col("ranges")[0].a.alias("a"))
    strings = bins.select("key", "hull.*", "copies", at.alias("at"))
    if width > 1:
        strings = strings.union(bins.select("key", "core.*", "copies", at.alias("at")))
    # A core is shorter than any hull, so they aren't counted as the same.  Stored, so that joins can split a string that very many fragments hold.
    twice = stored(strings.groupBy("key", "whole", "tail", "size").agg(F.sum("copies").alias("all"), F.min("at").alias("at")).where("all > 1"), "twice")
    hulls = twice.select("key", F.struct("whole", "tail", "size").alias("hull"), "all", "at")
    if width == 1:
        found = bins.join(hulls, ["key", "hull"]).withColumns({"many": F.lit(True), "more": F.lit(False)})
    else:
        cores = hulls.select("key", F.col("hull").alias("core"), F.col("all").alias("alike"))
        found = bins.join(cores, ["key", "core"]).join(hulls, ["key", "hull"], "left").withColumn("many", F.col("at").isNotNull())
        # The first bin of a hull stands for all of them where other bins have its core.
        found = found.withColumn("more", ~F.col("many") | ((F.col("at") == at) & (F.col("alike") > F.col("all"))))
    return stored(found.select("key", "print", "n", "ranges", "known", "many", "more"), "settled")


def _by_fragment(bins: DataFrame, **ranges: Column) -> DataFrame:
    """Ranges of bins, by fragment and sorted; those for which a condition holds under its name."""
    lists = [F.sort_array(F.flatten(F.collect_list(F.when(held, F.col("ranges"))))).alias(name) for name, held in ranges.items()]
    return bins.groupBy("key", "print", "n").agg(*lists)


def _counted(cut: DataFrame, length: int) -> DataFrame:
    """Repeated windows of the fragments, by counting bins of windows.

    Where a bin's core stands once, none of its windows repeats; where its hull, the bytes of all its windows there,
    stands twice, all do.  The bins between, at the ends of what fragments share, are split and counted again, with
    one bin of each hull that is known to repeat, as their windows may be equal to windows of that.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges = batch.column(3)
            which = np.repeat(np.arange(len(batch)), ranges.value_lengths().to_numpy())
            a, b = (ranges.flatten().field(k).to_numpy() for k in ("a", "b"))
            # Ranges of a fragment are sorted and don't overlap.
            first = np.flatnonzero(np.append(True, (which[1:] != which[:-1]) | (a[1:] != b[:-1] + 1)))
            marks = _ranges_of(np.bincount(which[first], minlength=len(batch)), a[first], b[np.append(first[1:], len(a)) - 1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], marks], names=["key", "print", "n", "marks"])

    cut, found = cut.select("key", "print", "n", "copies", "cut"), []
    pieces = cut.select("*", F.expr(f"CAST(array(named_struct('a', 0, 'b', n - 1)) AS {_RANGES}) AS ranges"), F.expr(f"CAST(array() AS {_RANGES}) AS known"))
    for width in (w for w in BINS if w <= length - GRAM + 1):
        settled = _settled(pieces, length, width)
        found.append(settled.where("many AND NOT known"))
        left = settled.where("more").select("key", "print", "n", F.expr("IF(many, slice(ranges, 1, 1), ranges) AS ranges"), F.expr("known OR many AS known"))
        pieces = cut.join(_by_fragment(left, ranges=~F.col("known"), known=F.col("known")), ["key", "print", "n"])
    # A fragment's windows, of which there are ``MOST_WINDOWS`` at most, meet as stretches: one row goes to each of its copies.
    return _by_fragment(reduce(DataFrame.union, found), ranges=F.lit(True)).mapInArrow(mark, _MARKS)


def _spans(found: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of a text's repeated windows, from its fragments (lo, marks), by start; they may overlap."""
    marks = found.field("marks")
    lo = np.repeat(found.field("lo").to_numpy(), marks.value_lengths().to_numpy()).astype(np.int64)
    ranges = marks.flatten()
    start, end = lo + ranges.field("a").to_numpy(), lo + ranges.field("b").to_numpy() + length
    order = np.argsort(start, kind="stable")
    return start[order], end[order]


def _kept(texts: DataFrame, doc_type: str, length: int) -> DataFrame:
    """Each text without its repeated windows; these come by fragment (lo, marks), in any order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for part in (batch.slice(k, 256) for k in range(0, len(batch), 256)):
                sizes, spans, kept = [], [], []
                for z, found in zip(part.column(1), part.column(2)):
                    text = unpack.decompress(z.as_py())
                    sizes.append(len(text))
                    mine, left, at = [], [], 0
                    if found.is_valid:
                        start, end = _spans(found.values, length)
                        end = np.maximum.accumulate(end)
                        first = np.flatnonzero(np.append(True, start[1:] > end[:-1]))
                        for lo, hi in zip(start[first].tolist(), end[np.append(first[1:], len(end)) - 1].tolist()):
                            mine.append({"start": lo, "end": hi})
                            left.append(text[at:lo])
                            at = hi
                    kept.append(b"".join([*left, text[at:]]) if at else text)
                    spans.append(mine)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, type=pa.int64()), pa.array(spans, type=pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, type=pa.binary())],
                    names=["doc_id", "n_bytes", "spans", "kept"],
                )

    return texts.mapInArrow(run, f"doc_id {doc_type}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, shard_bytes: int = SHARD_BYTES, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """doc_id, n_bytes, spans (byte start and end of each maximal removed run) and kept (the other bytes) of every row.

    ``length`` is ``GRAM`` bytes at least.
    """
    if length < GRAM:
        raise ValueError(f"length must be {GRAM} at least")
    texts = _store(docs, length)
    runs = texts.select("row", F.inline("runs"))
    # Equal windows are in two fragments of a key, or their key's string stands twice in one.
    keys = runs.groupBy("key").agg(F.count("*").alias("all"), F.max("twice").alias("twice")).where("all > 1 OR twice").select("key")
    runs = stored(runs.join(keys, "key"), "runs")
    different = runs.groupBy("key", "print", "n").agg(F.count("*").alias("copies"), F.min(F.struct("row", "lo")).alias("at"))
    sizes = different.groupBy("key").agg(F.sum(F.col("n") + length - 1).alias("bytes"))
    different = stored(different.join(sizes, "key").withColumn("hot", F.col("bytes") > hot_bytes).select("key", "print", "n", "copies", "hot", "at.row", "at.lo"), "fragments")
    total = different.where("NOT hot").agg(F.sum(F.col("n") + length - 1).alias("bytes")).first().bytes or 0
    pieces = different.groupBy("row").agg(F.collect_list(F.struct("key", "print", "n", "copies", "hot", "lo")).alias("pieces"))
    cut = _cut(texts.select("row", "z").join(pieces, "row").select("z", "pieces"), length)
    if different.where("hot").isEmpty():
        marks = _sorted_shards(cut, length, max(1, -(-total // shard_bytes)))
    else:
        cut = stored(cut, "cut")
        marks = _sorted_shards(cut.where("NOT hot"), length, max(1, -(-total // shard_bytes))).union(_counted(cut.where("hot"), length))
    # Marks are one row for each different fragment, so that a fragment meets one row, however many stretches and copies there are.
    found = runs.join(marks, ["key", "print", "n"]).groupBy("row").agg(F.collect_list(F.struct("lo", "marks")).alias("found"))
    rows = texts.select("row", "doc_id", "z").join(found, "row", "left").select("doc_id", "z", "found")
    return _kept(rows, texts.schema["doc_id"].dataType.simpleString(), length)
