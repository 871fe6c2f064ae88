"""Benchmark decontamination on a stored, document-sharded positional inverted index.

A shard is a run of documents of at most ``SHARD_BYTES`` bytes (a longer text is a shard of
its own).  Its postings, stored as a row in the shared folder, hold for every term the
sorted positions in the shard; texts are set apart by gaps, so no phrase crosses from one to
the next.  A phrase starts from the posting list of its rarest term in the shard, moved by
the term's offset in the phrase; its other terms, from rare to common, are intersected with
their own moved lists by binary search.  A proximity match is a text in which the rarest
terms of an item, by the number of items that have them and then by their bytes, all lie within a span of words.

The benchmark goes out in blocks of at most about ``BLOCK_WORDS`` words, one at a time, so
neither the driver nor a task ever holds more of it; each block is one search of the stored
index and leaves only the texts that it matches.  How the benchmark is cut changes no result.

Defined results: null has no words; an item without words matches nothing; repeated
benchmark rows of one item_id are one item; an item without an id hits words but is
not listed; repeated documents are judged alike; very long texts are indexed whole; other
columns are ignored, and ``__node__`` is reserved in ``drop_contaminated``; without documents
there are no rows, without items nothing is hit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallysieve.llm.textkit import raw_texts, saved, shingle_hashes, spans_of_rows, stored, text_or_empty, word_chunks, words_of

WINDOW = 13
NEAR_TERMS, NEAR_SPAN = 4, 40
SHARE = 20
BLOCK_WORDS = 1_000_000
SHARD_BYTES = 1 << 18
#: Words between two texts of a shard: no window and no span reaches across.
GAP = 64
#: Windows, and postings of their rarest terms, that a search takes at a time; a longer list is a step of its own.
STEP_WINDOWS, STEP_POSTINGS = 1 << 16, 1 << 20
BROADCAST_NODES = 500_000


@dataclass
class Phrases:
    """Windows of some items: window w is the terms ``sequence[start[w] : start[w] + size[w]]`` of item ``names[item[w]]``.

    Terms are numbers in the sorted ``vocabulary``; ``near`` has each item's terms for proximity, rarest first, or none.
    """

    vocabulary: np.ndarray
    sequence: np.ndarray
    start: np.ndarray
    size: np.ndarray
    item: np.ndarray
    names: list[str | None]
    near: list[np.ndarray] = field(default_factory=list)


def phrases(items: list[tuple[str | None, str]], window: int = WINDOW, near: dict[str, list[int]] | None = None) -> Phrases:
    """Windows of (name, text) rows; equal windows of one item come once. ``near`` maps names to term hashes, rarest first."""
    names = sorted({n for n, _ in items}, key=lambda n: (n is not None, n or ""))
    number = {n: k for k, n in enumerate(names)}
    hashes, counts = [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.int64)]
    for _, _, words in word_chunks(pa.array([t for _, t in items], pa.large_string())):
        hashes.append(words.hashes())
        counts.append(words.counts)
    flat, sizes = np.concatenate(hashes), np.concatenate(counts)
    chosen = [np.array((near or {}).get(n, []), dtype=np.int64).view(np.uint64) for n in names]
    vocabulary = np.unique(np.concatenate([flat, *chosen]))
    whole, row = shingle_hashes(flat, sizes, window)
    owner = np.array([number[n] for n, _ in items], dtype=np.int64)[row]
    begin = (np.cumsum(sizes) - sizes)[row]
    start = begin + np.arange(len(row)) - np.searchsorted(row, row)
    order = np.lexsort((start, whole, owner))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (owner[order][1:] != owner[order][:-1]) | (whole[order][1:] != whole[order][:-1])
    kept = np.sort(order[new])
    return Phrases(
        vocabulary,
        np.searchsorted(vocabulary, flat).astype(np.int32),
        start[kept],
        np.minimum(window, sizes[row])[kept],
        owner[kept],
        names,
        [np.searchsorted(vocabulary, t) for t in chosen],
    )


@dataclass
class Shard:
    """Postings of one shard: positions ``at[cut[t] : cut[t + 1]]`` of the searched terms t, ascending; first position and words of each text.

    ``keys`` is (term, position) as one ascending number, for the intersections.
    """

    at: np.ndarray
    cut: np.ndarray
    first: np.ndarray
    counts: np.ndarray

    def __post_init__(self) -> None:
        self.stride = int(self.first[-1] + self.counts[-1]) + GAP if len(self.first) else GAP
        self.keys = np.repeat(np.arange(len(self.cut) - 1), np.diff(self.cut)) * self.stride + self.at

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Whether each term's list has the position, by binary search."""
        if not len(self.keys):
            return np.zeros(len(term), dtype=bool)
        wanted = term * self.stride + position
        found = self.keys[np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)] == wanted
        return found & (position >= 0) & (position < self.stride)


def index_shards(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """The index to store: shard, doc_ids and counts (words) of its texts in order, and the postings.

    ``terms`` has the shard's distinct word hashes in order, ``cuts`` where each one's
    positions begin in ``positions``; a text's positions begin ``GAP`` behind the one before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw_texts(batch.column("text"))
            for a, b in spans_of_rows(offsets, limit):
                words = words_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                h = words.hashes()
                order = np.argsort(h, kind="stable")
                terms, cuts = np.unique(h[order], return_index=True)
                positions = (np.arange(len(h)) + words.doc * GAP)[order]
                ids = batch.column("doc_id").slice(a, b - a)
                one = np.array([0, b - a], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.ListArray.from_arrays(pa.array(one), ids), pa.ListArray.from_arrays(pa.array(one), pa.array(words.counts.astype(np.int64))),
                        pa.array([terms.tobytes()], pa.binary()), pa.array([np.append(cuts, len(h)).astype(np.int64).tobytes()], pa.binary()), pa.array([positions.astype(np.int32).tobytes()], pa.binary()),
                    ],
                    names=["doc_ids", "counts", "terms", "cuts", "positions"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    made = docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_ids array<{kind}>, counts array<long>, terms binary, cuts binary, positions binary")
    return made.withColumn("shard", F.monotonically_increasing_id())


def shards_of(batch: pa.RecordBatch, vocabulary: np.ndarray) -> Iterator[tuple[int, Shard]]:
    """(row, shard) of stored rows, with the posting lists of the vocabulary's terms."""
    for r in range(batch.num_rows):
        read = lambda name, kind, r=r: np.frombuffer(batch.column(name)[r].as_buffer(), dtype=kind)
        terms, cuts, positions = read("terms", np.uint64), read("cuts", np.int64), read("positions", np.int32)
        counts = batch.column("counts")[r].values.to_numpy()
        k = np.minimum(np.searchsorted(terms, vocabulary), max(0, len(terms) - 1))
        here = terms[k] == vocabulary if len(terms) else np.zeros(len(vocabulary), dtype=bool)
        n = np.where(here, cuts[k + 1] - cuts[k], 0) if len(terms) else np.zeros(len(vocabulary), dtype=np.int64)
        cut = np.append(0, np.cumsum(n))
        at = positions[np.repeat(cuts[k] - cut[:-1], n) + np.arange(cut[-1])].astype(np.int64) if cut[-1] else np.empty(0, dtype=np.int64)
        yield r, Shard(at, cut, np.cumsum(counts) - counts + GAP * np.arange(len(counts)), counts)


def exact_matches(shard: Shard, find: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(window, start position) of every occurrence."""
    df = np.diff(shard.cut)
    none = np.empty(0, dtype=np.int64)
    if not len(find.start) or not len(shard.at):
        return none, none
    widest = int(find.size.max())
    last = len(find.sequence) - 1
    # Only windows all of whose terms the shard has can occur in it.
    alive = np.arange(len(find.start))
    for k in range(widest):
        there = find.start[alive] + np.minimum(k, find.size[alive] - 1)
        alive = alive[df[find.sequence[there]] > 0]
    offsets = np.arange(widest)
    out: list[tuple[np.ndarray, np.ndarray]] = [(none, none)]
    for lo in range(0, len(alive), STEP_WINDOWS):
        some = alive[lo : lo + STEP_WINDOWS]
        terms = find.sequence[np.minimum(find.start[some][:, None] + offsets, last)].astype(np.int64)
        lengths = np.where(offsets < find.size[some][:, None], df[terms], np.iinfo(np.int64).max)
        ranked = np.argsort(lengths, axis=1, kind="stable")
        n = np.take_along_axis(lengths, ranked[:, :1], axis=1)[:, 0]
        step = np.cumsum(n) // STEP_POSTINGS
        for part in np.split(np.arange(len(some)), np.flatnonzero(np.diff(step)) + 1):
            rare, m = ranked[part, 0], n[part]
            window = np.repeat(part, m)
            start = shard.at[np.repeat(shard.cut[terms[part, rare]] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))] - np.repeat(rare, m)
            for k in range(1, widest):
                offset = ranked[window, k]
                keep = (offset >= find.size[some[window]]) | shard.has(terms[window, offset], start + offset)
                window, start = window[keep & (start >= 0)], start[keep & (start >= 0)]
            out.append((some[window], start))
    window, start = (np.concatenate(x) for x in zip(*out, strict=True))
    return window[start >= 0], start[start >= 0]


def near_matches(shard: Shard, find: Phrases, span: int) -> np.ndarray:
    """(text, item) pairs, as rows, where the item's terms for proximity all lie within ``span`` words around the rarest."""
    df, out = np.diff(shard.cut), []
    if not len(shard.at):
        return np.empty((0, 2), dtype=np.int64)
    for k, own in enumerate(find.near):
        if not len(own) or not df[own].all():
            continue
        lists = [shard.at[shard.cut[t] : shard.cut[t + 1]] for t in own]
        text = np.searchsorted(shard.first, lists[0], side="right") - 1
        here = np.ones(len(text), dtype=bool)
        low = np.maximum(lists[0] - span // 2, shard.first[text])
        high = np.minimum(lists[0] + span // 2, shard.first[text] + shard.counts[text] - 1)
        for other in lists[1:]:
            here &= np.searchsorted(other, low) < np.searchsorted(other, high, side="right")
        out += [(d, k) for d in np.unique(text[here])]
    return np.array(out, dtype=np.int64).reshape(-1, 2)


def item_terms(benchmark: DataFrame, terms: int) -> DataFrame:
    """(name, near): the ``terms`` words of every named item that the fewest items have, rarest first and then by their bytes, as hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in word_chunks(batch.column("text")):
                h = words.hashes()
                order = np.lexsort((h, words.doc))
                new = np.ones(len(h), dtype=bool)
                new[1:] = (h[order][1:] != h[order][:-1]) | (words.doc[order][1:] != words.doc[order][:-1])
                at = order[new]
                names = batch.column("name").slice(a, b - a).take(pa.array(words.doc[at]))
                yield pa.RecordBatch.from_arrays([names, pa.array([words.text(k) for k in at.tolist()], pa.string()), pa.array(h[at].view(np.int64))], names=["name", "word", "term"])

    each = _items(benchmark).mapInArrow(run, "name string, word string, term long").distinct()
    df = each.groupBy("word").agg(F.count("*").alias("df"))
    ranked = each.where("name IS NOT NULL").join(df, "word").withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy("df", "word"))).where(F.col("k") <= terms)
    return ranked.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "term"))), lambda x: x["term"]).alias("near"))


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("name"), text_or_empty().alias("text"))


def blocks(benchmark: DataFrame, limit: int, near: int = 0) -> Iterator[Phrases]:
    """The benchmark in blocks of at most about ``limit`` words, each made when it is asked for; a longer row is a block of its own."""
    rows = _items(benchmark)
    rows = rows.join(item_terms(benchmark, near), "name", "left") if near else rows.withColumn("near", F.lit(None).cast("array<long>"))
    part: list[tuple[str | None, str]] = []
    close: dict[str, list[int]] = {}
    held = 0
    for row in rows.toLocalIterator(prefetchPartitions=False):
        size = len(row.text) // 4 + 1
        if part and held + size > limit:
            yield phrases(part, near=close)
            part, close, held = [], {}, 0
        part.append((row.name, row.text))
        if row.near and row.name is not None:
            close[row.name] = row.near
        held += size
    if part:
        yield phrases(part, near=close)


def _ranges(shard: Shard, start: np.ndarray, size: np.ndarray) -> dict[int, list[dict]]:
    """By text: the merged ranges of word numbers, ends exclusive, that the occurrences cover."""
    out: dict[int, list[dict]] = {}
    end = 0
    for i, j in sorted(zip(start.tolist(), (start + size).tolist(), strict=True)):
        text = int(np.searchsorted(shard.first, i, side="right")) - 1
        i, j = i - int(shard.first[text]), j - int(shard.first[text])
        mine = out.setdefault(text, [])
        end = mine[-1]["end"] if mine else -1
        if i <= end:
            mine[-1]["end"] = max(end, j)
        else:
            mine.append({"begin": i, "end": j})
    return out


def hits(index: DataFrame, find: Phrases, near_span: int | None = None) -> DataFrame:
    """shard, ordinal, hit (ranges of word numbers, end exclusive), items and near_items of the indexed texts that match."""
    ranges_of = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for r, shard in shards_of(batch, find.vocabulary):
                window, start = exact_matches(shard, find)
                ranges = _ranges(shard, start, find.size[window])
                text = np.searchsorted(shard.first, start, side="right") - 1
                lists: tuple[dict, dict] = ({}, {})
                near = near_matches(shard, find, near_span) if near_span else np.empty((0, 2), dtype=np.int64)
                for named, pairs in zip(lists, (np.stack([text, find.item[window]], axis=1), near), strict=True):
                    for d, k in np.unique(pairs, axis=0).tolist():
                        if find.names[k] is not None:
                            named.setdefault(d, []).append(find.names[k])
                for d in sorted({*ranges, *lists[1]}):
                    for column, x in zip(out, (batch.column("shard")[r].as_py(), d, ranges.get(d, []), lists[0].get(d, []), lists[1].get(d, [])), strict=True):
                        column.append(x)
            strings = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int32(), ranges_of, strings, strings), strict=True)], names=["shard", "ordinal", "hit", "items", "near_items"])

    columns = index.select("shard", "counts", "terms", "cuts", "positions")
    return columns.mapInArrow(run, "shard long, ordinal int, hit array<struct<begin:long,end:long>>, items array<string>, near_items array<string>")


def search(index: DataFrame, find: Phrases) -> DataFrame:
    """(doc_id, item, start) of every phrase occurrence in the indexed texts, by word number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, shard in shards_of(batch, find.vocabulary):
                window, start = exact_matches(shard, find)
                text = np.searchsorted(shard.first, start, side="right") - 1
                names = pa.array([find.names[k] for k in find.item[window].tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("doc_ids")[r].values.take(pa.array(text)), names, pa.array(start - shard.first[text])], names=["doc_id", "item", "start"])

    kind = dict(index.dtypes)["doc_ids"][len("array<") : -1]
    return index.select("shard", "doc_ids", "counts", "terms", "cuts", "positions").mapInArrow(run, f"doc_id {kind}, item string, start long").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, near: tuple[int, int] | None = (NEAR_TERMS, NEAR_SPAN), block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, hit, items, near_items and contaminated of every row.

    A word is hit if it lies in any occurrence of a window; a text is contaminated
    if at least one word in ``SHARE`` is hit.
    """
    index = stored(index_shards(docs), "postings")
    lists = ("hit", "items", "near_items")
    found = None
    for part in blocks(benchmark, block_words, near[0] if near else 0):
        some = saved(hits(index, part, near[1] if near else None))
        found = some if found is None else found.union(some)
    every = index.select("shard", F.posexplode(F.arrays_zip(F.col("doc_ids").alias("doc_id"), F.col("counts").alias("n_words"))).alias("ordinal", "text"))
    every = every.select("shard", "ordinal", "text.doc_id", "text.n_words")
    if found is None:
        empty = {"hit": "array<struct<begin:long,end:long>>", "items": "array<string>", "near_items": "array<string>"}
        joined = every.select("*", *(F.array().cast(kind).alias(c) for c, kind in empty.items()))
    else:
        found = found.groupBy("shard", "ordinal").agg(*(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in lists))
        joined = every.join(found, ["shard", "ordinal"], "left")
        joined = joined.select("doc_id", "n_words", *(F.coalesce(c, F.array()).alias(c) for c in lists))
    nothing = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(
        "hit",
        nothing,
        lambda acc, x: F.struct(F.greatest(acc["end"], x["end"]).alias("end"), (acc["n"] + F.greatest(x["end"] - F.greatest(x["begin"], acc["end"]), F.lit(0))).alias("n")),
    )["n"]
    judged = joined.withColumn("n_hit", covered)
    return judged.select("doc_id", "n_words", "n_hit", *lists, ((F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without the contaminated rows; all columns stay.

    Contaminated texts are named by a 64-bit hash; their list is broadcast up to ``BROADCAST_NODES``.
    """
    node = F.xxhash64(text_or_empty())
    bad = decontaminate(docs.select(node.alias("doc_id"), "text"), benchmark, None, block_words)
    bad = saved(bad.where("contaminated").select(F.col("doc_id").alias("__node__")).distinct())
    few = bad.count() <= BROADCAST_NODES
    return docs.withColumn("__node__", node).join(F.broadcast(bad) if few else bad, "__node__", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
