"""Periodic runs, repeated byte strings and whitening against brute force, on odd rows and on whole test tables."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallysieve.llm import periodic, queries, repeats, suffixes, whitening

RNG = random.Random(11)
SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def letters(n, alphabet="ab"):
    return "".join(RNG.choices(alphabet, k=n))


def rows_of(spark, texts, parts=3):
    """Rows with columns that clash with the operators' own."""
    rows = [(i, t, "q", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, row string, key int").repartition(parts)


# Suffix arrays ------------------------------------------------------------------------------------------------------


def plain_suffixes(data):
    order = sorted(range(len(data)), key=lambda i: data[i:])
    shared = [0] * len(data)
    for x, y in zip(order, order[1:]):
        k = 0
        while max(x, y) + k < len(data) and data[x + k] == data[y + k]:
            k += 1
        shared[y] = k
    return order, shared


@pytest.mark.parametrize("alphabet", ["a", "ab", "abc", "abcdefghij"])
def test_suffix_arrays_are_exact(alphabet):
    texts = [letters(n, alphabet) for n in range(60)] + [letters(RNG.randint(1, 7), alphabet) * RNG.randint(2, 60) + letters(RNG.randint(0, 9), alphabet) for _ in range(60)]
    for text in texts:
        t = np.frombuffer(text.encode(), dtype=np.uint8)
        order = suffixes.suffix_array(t)
        assert (order.tolist(), suffixes.common_prefixes(t, order).tolist()) == plain_suffixes(text.encode())


def test_suffix_arrays_of_any_bytes():
    data = bytes(RNG.choices(range(256), k=900)) * 2 + b"\xff\x00"
    t = np.frombuffer(data, dtype=np.uint8)
    order = suffixes.suffix_array(t)
    assert (order.tolist(), suffixes.common_prefixes(t, order).tolist()) == plain_suffixes(data)


# 12: repeated byte strings ------------------------------------------------------------------------------------------


def plain_repeats(texts, length):
    blobs = [(t or "").encode() for t in texts]
    counts = Counter(b[i : i + length] for b in blobs for i in range(len(b) - length + 1))
    out = []
    for b in blobs:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if counts[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans, i = [], 0
        while i < len(b):
            j = i
            while j < len(b) and gone[j]:
                j += 1
            if j > i:
                spans.append((i, j))
            i = max(j, i + 1)
        out.append((len(b), spans, bytes(x for x, y in zip(b, gone) if not y)))
    return out


def test_repeats_are_those_of_all_windows(spark):
    shared = [letters(300, "abé \n") for _ in range(5)]
    texts = [None, "", " ", "x" * 63, "x" * 64, "y" * 9000 + letters(40), "ab" * 3000, (letters(777) * 9)[:6000]]
    texts += [letters(RNG.randint(0, 900), "abé ") + RNG.choice(shared) + letters(RNG.randint(0, 50)) + RNG.choice(shared) + letters(RNG.randint(0, 700), "abé ") for _ in range(60)]
    texts += [texts[10]] * 7 + [texts[11][:500]] * 3
    for length, settings in ((400, {}), (64, {}), (64, {"shard_bytes": 2000, "hot_bytes": 3000}), (100, {"hot_bytes": 0})):
        found = repeats.remove_repeats(rows_of(spark, texts), length=length, **settings).collect()
        got = {r.doc_id: (r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in found}
        assert [got[k] for k in range(len(texts))] == plain_repeats(texts, length)


def test_repeats_of_odd_rows(spark):
    none = repeats.remove_repeats(rows_of(spark, ["a"]).where("false"))
    assert none.collect() == [] and none.columns == ["doc_id", "n_bytes", "spans", "kept"]
    rows = spark.createDataFrame([(None, "z" * 400), (None, "z" * 400), (1, "u" * 399), (1, None)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_bytes, len(r.kept)) for r in repeats.remove_repeats(rows).collect()) == [("1", 0, 0), ("1", 399, 399), ("None", 400, 0), ("None", 400, 0)]
    with pytest.raises(ValueError):
        repeats.remove_repeats(rows, length=8)


def test_a_passage_that_most_texts_hold_is_counted_by_windows(spark):
    passage = letters(900, "abcdefgh ")
    texts = [letters(RNG.randint(0, 300), "abcdefgh ") + passage + letters(RNG.randint(0, 300), "abcdefgh ") for _ in range(80)]
    for hot in (10_000, repeats.HOT_BYTES):
        found = repeats.remove_repeats(rows_of(spark, texts), hot_bytes=hot).collect()
        got = {r.doc_id: (r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in found}
        assert [got[k] for k in range(len(texts))] == plain_repeats(texts, 400)


def test_a_fragment_has_one_row_of_marks_however_many_windows_repeat(spark):
    """What meets the copies of a fragment is one row, so copies times windows never become rows."""
    passage = letters(900, "abcdefgh ")
    cuts = [(7, k, len(c) - 399, 1, False, c.encode()) for k, c in enumerate([letters(30) + passage, passage + letters(40), letters(500, "cd"), (passage[:500] + letters(9)) * 2])]
    cut = spark.createDataFrame(cuts, "key long, print long, n int, copies long, hot boolean, cut binary")
    gone = [spans for _, spans, _ in plain_repeats([c[5].decode() for c in cuts], 400)]
    for marks in (repeats._sorted_shards(cut, 400, 1), repeats._counted(cut, 400)):
        rows = marks.collect()
        assert sorted((r.key, r.print, r.n) for r in rows) == [c[:3] for c, spans in zip(cuts, gone) if spans]
        got = {r.print: [(m.a, m.b + 400) for m in r.marks] for r in rows}
        covered = {k: {x for a, b in got.get(k, []) for x in range(a, b)} for k in range(4)}
        assert covered == {k: {x for a, b in spans for x in range(a, b)} for k, spans in enumerate(gone)}


def test_counting_makes_rows_for_bins_of_windows(spark, monkeypatch):
    """A passage with another text around it each time has a few dozen rows for each of them, not one for each byte."""
    passage = letters(520, "abcdefgh ")
    cuts = [letters(RNG.randint(100, 250), "abcdefgh ") + passage + letters(RNG.randint(100, 250), "abcdefgh ") for _ in range(60)]
    where = passage.encode()[240:272]
    key = int(repeats.gram_hashes(np.frombuffer(where, dtype=np.uint8)).view(np.int64)[0])
    cuts = [c.encode() for c in cuts]
    cuts = [c[max(c.index(where) - 368, 0) :][:768] for c in cuts]
    cut = spark.createDataFrame([(key, k, len(c) - 399, 1 + k % 2, True, c) for k, c in enumerate(cuts)], "key long, print long, n int, copies long, hot boolean, cut binary")
    made, plain = spark.sparkContext.accumulator(0), type(cut).mapInArrow

    def counted(self, run, *args, **more):
        def count(batches):
            for batch in run(batches):
                made.add(len(batch))
                yield batch

        return plain(self, count, *args, **more)

    monkeypatch.setattr(type(cut), "mapInArrow", counted)
    got = {r.print: [(m.a, m.b + 400) for m in r.marks] for r in repeats._counted(cut, 400).collect()}
    covered = {k: {x for a, b in v for x in range(a, b)} for k, v in got.items()}
    want = [spans for _, spans, _ in plain_repeats([c.decode() for c in cuts for _ in range(2)], 400)]
    alone = [spans for _, spans, _ in plain_repeats([c.decode() for c in cuts], 400)]
    want = [want[2 * k] if k % 2 else alone[k] for k in range(60)]
    assert covered == {k: {x for a, b in spans for x in range(a, b)} for k, spans in enumerate(want)}
    assert made.value <= 60 * 60 < sum(len(c) - 399 for c in cuts) // 5


@pytest.mark.parametrize("length", [32, 47, 95, 160])
def test_bins_settle_what_windows_do(spark, length):
    """Ends within bins, cut bins, periods, near copies, copies and windows that only a settled bin equals."""
    base = letters(5 * length, "abcdef ")
    texts = [letters(RNG.randint(0, 90)) + base[RNG.randint(0, 3 * length) :][: RNG.randint(1, 3 * length)] + letters(RNG.randint(0, 90)) for _ in range(50)]
    for _ in range(25):
        near = list(base[RNG.randint(0, length) :])
        near[RNG.randrange(len(near))] = "#"
        texts.append("".join(near))
    texts += [letters(5) * RNG.randint(1, length) + letters(9, "cd") for _ in range(6)] + ["ab" * 3 * length, "x" * 300, "x" * 500 + "y"] + texts[:3] * 2
    found = repeats.remove_repeats(rows_of(spark, texts), length=length, hot_bytes=0).collect()
    got = {r.doc_id: (r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in found}
    assert [got[k] for k in range(len(texts))] == plain_repeats(texts, length)


def test_passages_of_over_50_words_are_taken_from_400_bytes_on(spark):
    """``n_removed`` tells them; ``n_bytes`` is the length of the input, whatever repeats."""
    word = lambda n: letters(n, "abcdefghijklmnop")
    long, short = (" ".join(word(n) for _ in range(55)) for n in (7, 5))
    own = lambda: " ".join(word(6) for _ in range(RNG.randint(20, 200)))
    texts = [f"{own()} {p} {own()}" for p in [long] * 20 + [short] * 20] + [own() for _ in range(40)]
    assert len(long) >= 400 > len(short) + 2
    found = {r.doc_id: r for r in repeats.remove_repeats(rows_of(spark, texts)).collect()}
    removed = [found[k].n_bytes - len(found[k].kept) for k in range(80)]
    assert min(removed[:20]) >= len(long) and max(removed[20:]) == 0
    assert [found[k].n_bytes for k in range(80)] == [len(t) for t in texts]


@tables
def test_suffix_dedup_query_on_a_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {d.doc_id: (n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest()) for d, (n, spans, kept) in zip(docs, plain_repeats([d.text for d in docs], 400))}
    got = queries.op12_suffix_dedup(spark, SF).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want and len(got) == len(docs)


# 11: periodic runs --------------------------------------------------------------------------------------------------


def plain_runs(words, least, times):
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def some_words(letters_used):
    out = []
    for _ in range(RNG.randint(0, 5)):
        out += [RNG.randint(0, letters_used) for _ in range(RNG.randint(1, 30))] * RNG.randint(1, 7)
        out += [RNG.randint(0, letters_used) for _ in range(RNG.randint(0, 9))]
    return out


@pytest.mark.parametrize("least, times", [(24, 3), (4, 2), (6, 3), (50, 5)])
def test_runs_are_those_of_all_periods(least, times):
    for k in range(400):
        words = some_words((1, 2, 3, 50)[k % 4])
        assert periodic.text_runs(np.array(words, dtype=np.uint64), least, times) == plain_runs(words, least, times)
        assert periodic.runs_in(words, least, times) == [tuple(r) for r in sorted(plain_runs(words, least, times))]


def test_the_strongest_run_is_chosen_exactly():
    assert periodic.strongest([]) is None
    assert periodic.strongest([(5, 30, 10), (0, 33, 11), (9, 61, 20)]) == (9, 61, 20)
    assert periodic.strongest([(5, 30, 10), (0, 33, 11), (0, 30, 10)]) == (0, 30, 10)


def test_collapsed_texts_and_odd_rows(spark):
    line = "one two three four five six seven eight nine"
    texts = [None, "", " \t\n", " ".join([line] * 4), "intro " + " ".join([line] * 3) + " outro", "a " * 23, "a " * 24, "É é " * 30, "w" * 200_000]
    got = {r.doc_id: r for r in periodic.collapse_runs(rows_of(spark, texts)).collect()}
    assert [got[k].collapsed for k in range(9)] == ["", "", "", line, f"intro {line} outro", " ".join("a" * 23), "a", "É é", "w" * 200_000]
    assert got[4].runs[0].asDict() == {"start": 1, "length": 27, "period": 9} == got[4].best.asDict() and got[0].best is None
    assert [got[k].n_words for k in (0, 2, 3, 5)] == [0, 0, 36, 23]
    again = spark.createDataFrame([(None, "a " * 30), (None, "a " * 30)], "doc_id long, text string")
    assert [(r.doc_id, r.collapsed) for r in periodic.collapse_runs(again).collect()] == [(None, "a")] * 2
    assert periodic.collapse_runs(again.where("false")).collect() == []


def rewritten(words, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


@tables
def test_periodic_query_on_a_whole_table(spark):
    want = {}
    for d in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        words = rewritten((d.text or "").encode().split(), d.doc_id)
        runs = plain_runs(words, 24, 3)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        left = b" ".join(w for i, w in enumerate(words) if i not in gone)
        milli = 1000 * best[1] // best[2] if runs else None
        want[d.doc_id] = (len(runs), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left).hexdigest())
    got = queries.op11_periodic_runs(spark, SF).collect()
    assert {r.doc_id: (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in got} == want
    assert sum(w[0] > 0 for w in want.values()) > 5


# 13: whitening ------------------------------------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame([(k, v, 0) for k, v in enumerate(rows)], "vec_id long, embedding array<float>, component int").repartition(3)


def held_to_brute_force(found, rows, most=32):
    """``rows``: id and vector of the fit list."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in rows]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    exact = [[Fraction(n * sum(r[i] * r[j] for r in x) - sums[i] * sums[j], n * n) for j in range(d)] for i in range(d)]
    v = np.array([[float(c) for c in r] for r in exact])
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    got = {}
    for r in found:
        got.setdefault(r.vec_id, {})[r.component] = r
    assert sorted(got) == sorted(k for k, _ in rows)
    used = len(next(iter(got.values())))
    centred = {k: np.array([float(Fraction(n * r[j] - sums[j], n)) for j in range(d)]) for (k, _), r in zip(rows, x)}
    white = np.array([[got[k][c + 1].whitened for c in range(used)] for k, _ in rows])
    want = np.array([[centred[k] @ q[:, c] / math.sqrt(e[c]) for c in range(used)] for k, _ in rows])
    signs = np.sign((white * want).sum(axis=0))
    assert np.allclose(white, want * signs, rtol=1e-6, atol=1e-8) and used == min(most, int((e > e[0] * d * 1e-15).sum()))
    worst = np.abs(white.T @ white / n - np.outer(white.mean(axis=0), white.mean(axis=0)) - np.eye(used)).max()
    for (k, _), r in zip(rows, x):
        one = got[k][1]
        assert (one.n, int(one.deviation)) == (n, sum((n * c - s) ** 2 for c, s in zip(r, sums)))
        assert abs(one.identity_error - worst) < 1e-9 and one.identity_error <= 1e-4
        assert all(abs(got[k][c + 1].explained / (e[c] / np.trace(v)) - 1) < 1e-4 for c in range(used))


def test_whitening_is_that_of_exact_sums(spark):
    rng = np.random.default_rng(2)
    rows = (rng.normal(size=(60, 7)) * [9, 5, 3, 2, 1, 0.5, 0.3]).astype(np.float32).tolist()
    bad = [None, [], [float("nan")] * 7, [1.0] * 6 + [None], [float("inf")] + [0.0] * 6, [0.0] * 5]
    found = whitening.whiten(vectors(spark, rows + bad)).collect()
    held_to_brute_force(found, list(enumerate(rows)))


def test_whitening_far_from_zero(spark):
    """Values whose squares have more digits than a float or a long."""
    rng = np.random.default_rng(3)
    rows = (2.0**30 + rng.normal(size=(50, 3)) * [4e6, 2e5, 9e3]).astype(np.float32).tolist()
    held_to_brute_force(whitening.whiten(vectors(spark, rows)).collect(), list(enumerate(rows)))


def test_exact_products_of_any_integers():
    rng = random.Random(8)
    for bits in (3, 19, 20, 21, 40, 62):
        x = np.array([[rng.randint(-(2**bits), 2**bits) for _ in range(4)] for _ in range(30)], dtype=np.int64)
        want = [[sum(int(r[i]) * int(r[j]) for r in x) for j in range(4)] for i in range(4)]
        assert whitening.exact_products(x).tolist() == want
    edge = np.full((whitening.ROWS, 2), -(2**20), dtype=np.int64)
    assert whitening.exact_products(edge).tolist() == [[whitening.ROWS * 2**40] * 2] * 2


def test_whitening_of_odd_rows(spark):
    columns = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([], [[1.0, 2.0]], [[1.0, 2.0]] * 4, [None, [float("nan")]]):
        found = whitening.whiten(vectors(spark, rows))
        assert found.collect() == [] and found.columns == columns
    # A direction without variance is left out; repeated rows count each.
    flat = [[float(k), 5.0] for k in (1, 1, 2, 7)]
    held_to_brute_force(whitening.whiten(vectors(spark, flat)).collect(), list(enumerate(flat)))
    huge = whitening.whiten(vectors(spark, [[3e38, 0.0], [-3e38, 1.0], [0.0, 2.0]])).collect()
    assert {r.component for r in huge} == {1} and all(math.isfinite(r.whitened) for r in huge)


@tables
def test_whitening_query_on_a_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    some = spark.createDataFrame(rows[:80], "vec_id long, embedding array<float>")
    held_to_brute_force(whitening.whiten(some).collect(), [(r.vec_id, r.embedding) for r in rows[:80]])
    found = queries.op13_whitening(spark, SF)
    assert dict(found.dtypes)["deviation"] == "bigint"
    first = found.groupBy("component").agg(F.count("*").alias("n"), F.avg("whitened").alias("mean"), F.avg(F.pow("whitened", F.lit(2))).alias("square")).collect()
    assert len(first) == 32 and all(r.n == len(rows) and abs(r["mean"]) < 1e-9 and abs(r.square - 1) < 1e-6 for r in first)
