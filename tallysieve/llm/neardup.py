"""Near duplicates by ProbMinHash: probability Jaccard of weighted word shingles.

Every distinct shingle of a text emits a Poisson process of arrivals whose rate is
its weight; each arrival falls on a random register, and a register keeps the
shingle that arrived first.  A shingle stops once its next arrival is later than
every register's first, so most shingles make one or two arrivals.  The share of
equal registers of two texts estimates their probability Jaccard; with equal
weights that is the Jaccard similarity.  A shingle that a text repeats weighs up to
``1 + REPEATS`` times one that it has once; so little that texts whose shingle sets are
similar, but not their counts, still share registers.

Registers are cut into bands; texts that agree on a whole band are candidates, and
each candidate pair is verified on all its shingles: a pair is a link if the Jaccard
similarity of its shingle sets is at least the one asked for.

Copies are collapsed before banding, so the banding sees each text once.  Buckets of
up to ``PAIRS_UP_TO`` texts pair all their members; in a larger bucket every member
is paired with the one that meets the most texts over all bands, as a rule the
original of the bucket's copies.  Members of buckets that then still hold several
components go through an exact search: texts of similarity s share one of their
rarest shingles (a 1 - s share of them), and the place of the first shared one bounds
the similarity, so pairs are made only between components and only where s can be
reached.  So classes are whole; the links of the components with such members are
then counted by comparing all their texts, blocks of ``BLOCK`` against each other.

Counts and extremes of a bucket or class are aggregates with partial sums, and where a
key can be hot the other side of its join is unique by it, so that adaptive execution
splits the key.

Defined results: null counts as the empty text; texts without words are linked only
to equal texts; texts of fewer than five words have one shingle of all their words;
repeated rows are copies; a null id takes part and is listed with its class, whose id it
is only if all ids are null; very long texts are compared whole; of rows that tie in id
and text ``keep_one`` keeps that with the least hash of its columns (``__text__``, ``__node__``
and ``__id__`` are reserved there); an empty table gives no rows.  Two of n different texts
share a 64-bit identity with a chance of n * n / 2 ** 65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallysieve.llm.components import components
from tallysieve.llm.textkit import mix64, saved, shingle_hashes, text_or_empty, word_chunks

SHINGLE = 5
SIMILARITY = 0.8
REPEATS = 0.25
BANDS, BAND_ROWS = 32, 6
PAIRS_UP_TO = 32
BLOCK = 256
_COLUMNS = 1 << 13

_ODD = np.uint64(0x9E3779B97F4A7C15)


def weighted(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, text, weight) of distinct shingles; the weight grows with the count from 1 to 1 + ``REPEATS``."""
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(h)))
    return h[at], d[at], 1.0 + REPEATS * (1 - 1 / counts)


def signatures(shingles: np.ndarray, doc: np.ndarray, weights: np.ndarray, docs: int, registers: int) -> np.ndarray:
    """docs x registers: the shingle that arrived first; 0 where a text has no shingle."""
    first = np.full(docs * registers, np.inf)
    winner = np.zeros(docs * registers, dtype=np.uint64)
    h, d, w = shingles, doc, weights
    time, turn = np.zeros(len(h)), 0
    while len(h):
        turn += 1
        draw = mix64(h + np.uint64(turn * int(_ODD) & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / w
        cell = d * registers + (mix64(draw ^ _ODD) % np.uint64(registers)).astype(np.int64)
        sooner = time < first[cell]
        c, t = cell[sooner], time[sooner]
        np.minimum.at(first, c, t)
        won = first[c] == t
        winner[c[won]] = h[sooner][won]
        latest = first.reshape(docs, registers).max(axis=1)
        alive = time < latest[d]
        h, d, w, time = h[alive], d[alive], w[alive], time[alive]
    return winner.reshape(docs, registers)


def band_keys(winners: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """docs x bands hashes of the bands' registers."""
    acc = np.zeros((len(winners), bands), dtype=np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * _ODD
    cut = winners.reshape(len(winners), bands, rows)
    for k in range(rows):
        acc = mix64(acc + cut[:, :, k] * _ODD + np.uint64(k))
    return acc.view(np.int64)


def probability_jaccard(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard of two weighted sets, each as (sorted ids, weights): what registers estimate."""
    ids, at, here = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    if not len(ids):
        return 0.0
    xs, ys = x[1][at], y[1][here]
    only_x, only_y = x[1].sum() - xs.sum(), y[1].sum() - ys.sum()
    order = np.argsort(ys / xs, kind="stable")
    xs, ys = xs[order], ys[order]
    ratio = ys / xs
    last = np.searchsorted(ratio, ratio, side="right")
    below = np.append(0, np.cumsum(xs))[last] + only_x
    above = ys.sum() - np.append(0, np.cumsum(ys))[last] + only_y
    return float((1 / (below / xs + above / ys)).sum())


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of two sets of distinct ids."""
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared / max(1, len(x) + len(y) - shared)


def sketch(docs: DataFrame, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """doc_id, node (the text's identity) and band keys (null without words) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, has = [np.empty((0, bands), dtype=np.int64)], [np.empty(0, dtype=bool)]
            for a, b, words in word_chunks(batch.column("text")):
                s, d = shingle_hashes(words.hashes(), words.counts, SHINGLE)
                s, d, w = weighted(s, d)
                keys.append(band_keys(signatures(s, d, w, b - a, bands * rows), bands, rows))
                has.append(words.counts > 0)
            flat, empty = np.concatenate(keys).ravel(), ~np.concatenate(has)
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * bands, mask=np.append(empty, False))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("node"), pa.ListArray.from_arrays(offsets, pa.array(flat))], names=["doc_id", "node", "keys"])

    kind = dict(docs.dtypes)["doc_id"]
    whole = docs.select("doc_id", text_or_empty().alias("text")).withColumn("node", F.xxhash64("text"))
    return whole.mapInArrow(run, f"doc_id {kind}, node long, keys array<long>")


def candidates(keys: DataFrame, up_to: int = PAIRS_UP_TO) -> tuple[DataFrame, DataFrame]:
    """Pairs (a < b) of nodes, and the members of buckets beyond ``up_to`` as (key, node)."""
    placed = keys.select("node", F.explode("keys").alias("key"))
    shared = placed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    placed = saved(placed.join(shared, "key"))
    small = placed.where(F.col("n") <= up_to).groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("m"))
    i = F.posexplode("m").alias("i", "a")
    small = small.select(i, "m").select("a", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("b"))
    large = placed.where(F.col("n") > up_to)
    weight = placed.groupBy("node").agg(F.sum("n").alias("met"))
    hub = large.join(weight, "node").groupBy("key").agg(F.max_by("node", F.struct("met", "node")).alias("hub"))
    star = large.join(hub, "key").where("node != hub").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b"))
    return small.union(star).distinct(), large.select("key", "node")


def shingled(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    out = []
    for a, b, words in word_chunks(column):
        s, d, _ = weighted(*shingle_hashes(words.hashes(), words.counts, SHINGLE))
        cut = np.searchsorted(d, np.arange(b - a + 1))
        out += [s[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True)]
    return out


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose whole texts are similar enough; ``texts`` is (node, text), unique by node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                left = batch.column("text_a").dictionary_encode()
                seen, right = shingled(left.dictionary), shingled(batch.column("text_b"))
                keep = [jaccard(seen[k], y) >= similarity for k, y in zip(left.indices.to_pylist(), right, strict=True)]
                kept = batch.filter(pa.array(keep, pa.bool_()))
                yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], names=["a", "b"])

    lefts, rights = (texts.select(F.col("node").alias(s), F.col("text").alias(f"text_{s}")) for s in "ab")
    return pairs.join(lefts, "a").join(rights, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def rare_pairs(members: DataFrame, texts: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
    """Pairs of members of large buckets that are in different components and share a rare shingle.

    ``labels`` is (node, comp); unlabelled nodes are components of their own.
    Shingles are ranked by how many of these members have them.
    """
    comp = members.join(labels, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    mixed = comp.groupBy("key").agg((F.min("comp") != F.max("comp")).alias("mixed")).where("mixed").select("key")
    nodes = comp.join(mixed, "key", "left_semi").select("node", "comp").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in word_chunks(batch.column("text")):
                s, d, _ = weighted(*shingle_hashes(words.hashes(), words.counts, SHINGLE))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("node").take(pa.array(d)), part.column("comp").take(pa.array(d)), pa.array(s.view(np.int64))], names=["node", "comp", "shingle"])

    each = saved(nodes.join(texts, "node").select("node", "comp", "text").mapInArrow(run, "node long, comp long, shingle long"))
    df = each.groupBy("shingle").agg(F.count("*").alias("df"), (F.min("comp") != F.max("comp")).alias("mixed"))
    of_node = Window.partitionBy("node")
    ranked = each.join(df, "shingle").withColumn("rank", F.row_number().over(of_node.orderBy("df", "shingle"))).withColumn("size", F.count("*").over(of_node))
    prefix = ranked.where(F.col("mixed") & (F.col("rank") <= F.col("size") - F.ceil(F.col("size") * similarity) + 1)).select("shingle", "node", "comp", "rank", "size")
    left, right = (prefix.select("shingle", *(F.col(n).alias(f"{n}_{s}") for n in ("node", "comp", "rank", "size"))) for s in "ab")
    # No more than what stands from the first shared shingle on is shared.
    most = F.least(F.expr("size_a - rank_a"), F.expr("size_b - rank_b")) + 1
    able = most * (1 + similarity) >= F.expr("size_a + size_b") * similarity - 1e-9
    met = left.join(right, (left["shingle"] == right["shingle"]) & F.expr("node_a < node_b AND comp_a != comp_b") & able)
    return met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """left x right: how many shingles two texts share, by products of incidence matrices of some columns at a time."""
    join = lambda side: np.concatenate([*side, np.empty(0, dtype=np.uint64)])
    common = np.intersect1d(join(left), join(right))
    out = np.zeros((len(left), len(right)))
    for at in range(0, len(common), _COLUMNS):
        columns = common[at : at + _COLUMNS]
        x, y = (np.array([np.isin(columns, own, assume_unique=True) for own in side], dtype=np.float32) for side in (left, right))
        out += x @ y.T
    return out


def exact_links(members: DataFrame, texts: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
    """(node, n_links) of all nodes of the components (node, comp) that have members of large buckets."""
    big = members.select("node").join(labels, "node").select("comp").distinct()
    nodes = labels.join(big, "comp", "left_semi")
    sizes = nodes.groupBy("comp").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("parts"))
    nodes = nodes.join(sizes, "comp").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts"))).join(texts, "node")
    met = nodes.select("comp", "node", "own", "text", F.explode(F.expr("sequence(0L, parts - 1)")).alias("other"))
    met = met.select("comp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "text")

    def count(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        node, own, sets = group.column("node").to_numpy(), group.column("own").to_numpy(), shingled(group.column("text").chunk(0))
        sizes = np.array([len(x) for x in sets])
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        shared = overlaps([sets[k] for k in left], [sets[k] for k in right])
        links = shared / np.maximum(1, sizes[left][:, None] + sizes[right] - shared) >= similarity
        links &= node[left][:, None] != node[right]
        ends = [(left, links.sum(axis=1))] + ([(right, links.sum(axis=0))] if i != j else [])
        return pa.table({"node": np.concatenate([node[k] for k, _ in ends]), "n_links": np.concatenate([n for _, n in ends]).astype(np.int64)})

    found = met.groupBy("comp", "i", "j").applyInArrow(count, "node long, n_links long")
    return found.groupBy("node").agg(F.sum("n_links").alias("n_links"))


def near_duplicates(docs: DataFrame, *, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """doc_id, node, class_node, class_id (smallest id of the class), class_size and n_links of every row.

    ``n_links`` counts the links of the row's text to other texts.
    """
    rows_of = saved(sketch(docs, bands, rows))
    texts_of = rows_of.groupBy("node").agg(F.first("keys").alias("keys"))
    pairs, members = candidates(texts_of.where(F.col("keys").isNotNull()))
    pairs = saved(pairs)
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    whole = docs.select(text_or_empty().alias("text")).withColumn("node", F.xxhash64("text"))
    texts = saved(whole.groupBy("node").agg(F.first("text").alias("text")).join(wanted, "node", "left_semi"))  # copies go before the shuffle
    links = saved(verified(pairs, texts, similarity))
    labels = components(links)
    large = not members.isEmpty()
    if large:
        more = saved(verified(rare_pairs(members, texts, labels, similarity), texts, similarity))
        if not more.isEmpty():
            links = saved(links.union(more).distinct())
            labels = components(links)
    ends = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node")))
    counts = ends.groupBy("node").agg(F.count("*").alias("n_links"))
    if large:
        exact = saved(exact_links(members, texts, labels, similarity))
        counts = counts.join(exact, "node", "left_anti").union(exact)
    found = labels.withColumnRenamed("comp", "class_node").join(counts, "node", "left")
    listed = rows_of.select("doc_id", "node").join(found, "node", "left")
    listed = listed.select("doc_id", "node", F.coalesce("class_node", "node").alias("class_node"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    classes = listed.groupBy("class_node").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return listed.join(classes, "class_node").select("doc_id", "node", "class_node", "class_id", "class_size", "n_links")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One row of ``docs`` for each class: that of the smallest id (null last), then of the smallest text identity.

    All columns stay.  Of repeated rows one stays.
    """
    found = near_duplicates(docs, **options)
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "node")
    first = found.groupBy("class_node").agg(F.min(order).alias("one")).select(F.col("one.doc_id").alias("__id__"), F.col("one.node").alias("__node__"))
    named = docs.withColumn("__text__", F.xxhash64(text_or_empty()))
    kept = named.join(first, named["doc_id"].eqNullSafe(first["__id__"]) & (named["__text__"] == first["__node__"]), "left_semi")
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    return kept.groupBy("doc_id", "__text__").agg(F.min_by(whole, F.xxhash64(*plain)).alias("__row__")).select(*(F.col("__row__").getField(c).alias(c) for c in docs.columns))
