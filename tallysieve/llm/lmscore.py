"""Language-model scores of whole documents from a gated recurrent network.

Corpus counts cover every training document.  The commonest words are entries of the
network's vocabulary, in classes by frequency rank; all others share the entries of the
first class by their last three bytes and are told apart by their corpus counts.  The
network (a GRU) is trained in numpy by truncated backpropagation on every training
document, once each, in ``ROUNDS`` rounds.  A round deals its documents to replicas by a
hash of id and text, each replica starts from the shared network and state of the
optimiser and learns its documents in the order of their hash, and the replicas are
averaged by the tokens that they saw.  How many replicas there are follows from the number
of tokens, so neither files nor partitions change the scores by more than rounding.
A replica's tokens stand in ``STREAMS`` equal rows whose states carry over from window to
window; a row may start within a document.  Scoring reads each document from its first
token to its last with the state carried through; the output is factored into class and
word.

Texts are read twice, for the counts and for the numbers of their tokens; those are stored
in the shared folder, and training and scoring read them there.

A word's count is looked up in two ways: words with at least one in ``2 ** 21`` of
all tokens, of which there can't be more than ``2 ** 21``, are sent to all tasks;
the rest meet the counts in a join, where by that bound no key is hot.

Defined results: null counts as the empty text, whose only token is the end;
repeated rows are scored alike; without training documents no word is known, every
count is 0 and the network is as it starts; a null id is held out or not by the crc32 of
the empty text; very long texts are scored whole, their tokens one after another; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallysieve.llm.textkit import Words, keep_freed, saved, single_threaded, stored, text_or_empty, word_chunks

HIDDEN, CLASSES, PER_CLASS = 24, 32, 64
WINDOW, STREAMS, RATE = 16, 256, 0.15
ROUNDS, REPLICA_TOKENS, MOST_REPLICAS = 4, 1 << 20, 4096
FREQUENT_SHARE = 1 << 21
GROUP_TOKENS, FLUSH_TOKENS, COUNT_TOKENS = 1 << 22, 1 << 16, 1 << 22
_SUMMERS = 8
END = 0


@dataclass
class Counts:
    """Corpus statistics: all training tokens, distinct ones, training documents, the frequent words with counts and endings, and the tokens and words of each ending."""

    tokens: int
    distinct: int
    documents: int
    words: np.ndarray
    counts: np.ndarray
    endings: np.ndarray
    ending_tokens: np.ndarray
    ending_words: np.ndarray


def _sigmoid(v: np.ndarray) -> np.ndarray:
    """In place, of the negated argument ``-v``: 1 / (1 + exp(v))."""
    with np.errstate(over="ignore"):
        np.exp(v, out=v)
    v += 1
    return np.reciprocal(v, out=v)


def _scaled_softmax(logits: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """In place: softmax of each row times its scale. Logits beyond 80, which no trained network has, count as 80."""
    np.minimum(logits, np.float32(80), out=logits)
    np.exp(logits, out=logits)
    logits *= (scale / (logits @ np.ones(logits.shape[1], dtype=logits.dtype)))[:, None]
    return logits


def _log_share(logits: np.ndarray, chosen: np.ndarray, cap: bool) -> np.ndarray:
    """Log softmax of each row at its chosen column; with ``cap``, logits may be beyond 80 and count as 80."""
    if cap:
        np.minimum(logits, np.float32(80), out=logits)
    picked = logits.ravel().take(np.arange(len(chosen)) * logits.shape[1] + chosen)
    np.exp(logits, out=logits)
    return picked - np.log(logits @ np.ones(logits.shape[1], dtype=logits.dtype))


def _rows(table: np.ndarray, at: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """``table[at]`` for numbers that are all in range."""
    return np.take(table, at, axis=0, out=out, mode="clip")


class Network:
    """A GRU over word numbers with a class-factored softmax; all parameters are float32 arrays.

    The state starts afresh after an end. ``squares`` are the optimiser's sums of squared gradients.
    """

    NAMES = ("x", "uzr", "un", "wc", "bc", "o", "bo")

    def __init__(self, frequencies: np.ndarray, seed: int = 1):
        rng = np.random.default_rng(seed)
        small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        h, c, k = HIDDEN, len(frequencies) // PER_CLASS, PER_CLASS
        p = (frequencies + 0.5).reshape(c, k)
        self.x, self.uzr, self.un = small(c * k, 3 * h), small(h, 2 * h), small(h, h)
        self.wc, self.bc = small(h, c), np.log(p.sum(axis=1) / p.sum()).astype(np.float32)
        self.o, self.bo = small(c, k, h), np.log(p / p.sum(axis=1, keepdims=True)).astype(np.float32)
        self.squares = [np.full_like(p, 1e-6) for p in self.parameters()]

    def parameters(self) -> list[np.ndarray]:
        return [getattr(self, n) for n in self.NAMES]

    def packed(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in (*self.parameters(), *self.squares)])

    def unpack(self, flat: np.ndarray) -> Network:
        at, new = 0, []
        for p in (*self.parameters(), *self.squares):
            new.append(flat[at : at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size
        for n, p in zip(self.NAMES, new, strict=False):
            setattr(self, n, p)
        self.squares = new[len(self.NAMES) :]
        return self

    def negated(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``x`` for the gates and for the new state, ``uzr`` and ``un``, the gates' times -1 and the new state's times -2, as ``_sigmoid`` wants them."""
        return -self.x[:, : 2 * HIDDEN], -2 * self.x[:, 2 * HIDDEN :], -self.uzr, -2 * self.un

    def most(self) -> float:
        """No logit is larger, since no entry of a state is beyond 1."""
        return max(float((np.abs(w).sum(axis=k) + b).max()) for w, k, b in ((self.wc, 0, self.bc), (self.o, 2, self.bo)))

    def log_p(self, h: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Natural log probabilities of the words after the states ``h``."""
        kind, place, cap = word // PER_CLASS, word % PER_CLASS, not self.most() < 79
        out = _log_share(h @ self.wc + self.bc, kind, cap)
        order = np.argsort(kind.astype(np.int16), kind="stable")
        cut = np.searchsorted(kind[order], np.arange(len(self.o) + 1))
        for c in np.flatnonzero(np.diff(cut)):
            who = order[cut[c] : cut[c + 1]]
            out[who] += _log_share(_rows(h, who) @ self.o[c].T + self.bo[c], place[who], cap)
        return out

    def train_window(self, words: np.ndarray, weight: np.ndarray, before: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], list[np.ndarray]]:
        """The state after a window (time x streams), and the gradients of its weighted negative log probability.

        The first gradient, of ``x``, comes as (rows, their gradients).
        """
        steps, size = len(words), HIDDEN
        read = np.concatenate([before[None], words[:-1]])
        live = (read != END).astype(np.float32)[:, :, None]
        xg, xn, uzr, un = self.negated()
        xg, xn = _rows(xg, read), _rows(xn, read)
        was, gates, new, reset, states = (np.empty((steps, len(h), k), dtype=np.float32) for k in (size, 2 * size, size, size, size))
        for t in range(steps):
            w = np.multiply(h, live[t], out=was[t])
            h = _advance(xg[t], xn[t], uzr, un, w, gates[t], reset[t], new[t], states[t])
        # The output: rows sorted by class, so that each class's are a slice.
        rows, flat = np.arange(words.size), words.ravel()
        order = np.argsort((flat // PER_CLASS).astype(np.int16), kind="stable")
        kind, place, share = flat[order] // PER_CLASS, flat[order] % PER_CLASS, weight.ravel()[order]
        hs, one = _rows(states.reshape(-1, size), order), np.ones(words.size, dtype=np.float32)
        dc = _scaled_softmax(hs @ self.wc + self.bc, share)
        dc[rows, kind] -= share
        out, go, gbo = dc @ self.wc.T, np.zeros_like(self.o), np.zeros_like(self.bo)
        cut = np.searchsorted(kind, np.arange(len(self.o) + 1))
        for c in np.flatnonzero(np.diff(cut)):
            i, j = cut[c], cut[c + 1]
            d = _scaled_softmax(hs[i:j] @ self.o[c].T + self.bo[c], share[i:j])
            d[rows[: j - i], place[i:j]] -= share[i:j]
            go[c], gbo[c] = d.T @ hs[i:j], one[: j - i] @ d
            out[i:j] += d @ self.o[c]
        back = np.empty_like(out)
        back[order] = out
        back = back.reshape(states.shape)
        # The states, from the last step to the first.
        z, r = gates[:, :, :size].copy(), gates[:, :, size:].copy()
        rest = 1 - z
        of_n, of_z, of_r = rest * (1 - new * new), (was - new) * z * rest, was * r * (1 - r)
        dg, dn, un, uzr = np.empty_like(gates), np.empty_like(new), self.un.T.copy(), self.uzr.T.copy()
        dh = np.zeros_like(h)
        for t in range(steps - 1, -1, -1):
            dh += back[t]
            d = dg[t]
            inner = np.multiply(dh, of_n[t], out=dn[t]) @ un
            np.multiply(dh, of_z[t], out=d[:, :size])
            np.multiply(inner, of_r[t], out=d[:, size:])
            dh *= z[t]
            inner *= r[t]
            dh += inner
            dh += d @ uzr
            dh *= live[t]
        dg, dn = dg.reshape(-1, 2 * size), dn.reshape(-1, size)
        guzr, gun = was.reshape(-1, size).T @ dg, reset.reshape(-1, size).T @ dn
        order = np.argsort(read.ravel().astype(np.int16), kind="stable")
        sorted_words = read.ravel()[order]
        first = np.flatnonzero(np.diff(sorted_words, prepend=-1))
        gx = np.concatenate([np.add.reduceat(_rows(d, order), first) for d in (dg, dn)], axis=1)
        return h, (sorted_words[first], gx), [guzr, gun, hs.T @ dc, one @ dc, go, gbo]

    def learn(self, tokens: np.ndarray) -> int:
        """Truncated backpropagation over documents' numbers on end, each with its end; gives the tokens seen."""
        n = len(tokens)
        streams = min(STREAMS, max(1, n // (4 * WINDOW)))
        length = -(-(-(-n // streams)) // WINDOW) * WINDOW
        words = np.full(streams * length, END, dtype=np.int64)
        words[:n] = tokens
        mask = (np.arange(streams * length) < n).astype(np.float32).reshape(streams, length).T
        words = np.ascontiguousarray(words.reshape(streams, length).T)
        h, last = np.zeros((streams, HIDDEN), dtype=np.float32), np.full(streams, END)
        for t in range(0, length, WINDOW):
            part, weight = words[t : t + WINDOW], mask[t : t + WINDOW]
            h, (at, gx), grads = self.train_window(part, weight / max(1.0, float(weight.sum())), last, h)
            last = part[-1]
            norm = math.sqrt(float((gx * gx).sum()) + sum(float((g * g).sum()) for g in grads))
            scale, rate = np.float32(min(1.0, 1.0 / (1e-9 + norm))), np.float32(RATE)
            gx *= scale
            self.squares[0][at] += gx * gx
            self.x[at] -= rate * gx / np.sqrt(self.squares[0][at])
            for p, g, s in zip(self.parameters()[1:], grads, self.squares[1:], strict=True):
                g *= scale
                s += g * g
                p -= rate * g / np.sqrt(s)
        return n


def _advance(xg: np.ndarray, xn: np.ndarray, uzr: np.ndarray, un: np.ndarray, was: np.ndarray, gates: np.ndarray, reset: np.ndarray, new: np.ndarray, out: np.ndarray) -> np.ndarray:
    """One step of the GRU from the states ``was``; fills the gates, the reset states, the new states and ``out``, all given."""
    size = was.shape[1]
    np.matmul(was, uzr, out=gates)
    gates += xg
    _sigmoid(gates)
    np.matmul(np.multiply(gates[:, size:], was, out=reset), un, out=new)
    new += xn
    _sigmoid(new)
    new *= 2
    new -= 1  # tanh(v) = 2 sigmoid(2 v) - 1
    np.subtract(was, new, out=out)
    out *= gates[:, :size]
    out += new
    return out


def score_documents(network: Network, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Natural log probability of each document; ``flat`` has their word numbers, each with its end."""
    out, first = np.zeros(len(lengths)), np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    groups = np.cumsum(lengths[order]) // GROUP_TOKENS
    xg, xn, uzr, un = network.negated()
    flat = flat.astype(np.int64)
    for group in np.split(order, np.flatnonzero(np.diff(groups)) + 1) if len(order) else ():
        n, at = lengths[group], first[group]
        h, word = np.zeros((len(group), HIDDEN), dtype=np.float32), np.full(len(group), END)
        gates, reset, new, of_gates, of_new = (np.empty((len(group), k), dtype=np.float32) for k in (2 * HIDDEN, HIDDEN, HIDDEN, 2 * HIDDEN, HIDDEN))
        most = FLUSH_TOKENS + len(group)
        states, words, who, held = np.empty((most, HIDDEN), dtype=np.float32), np.empty(most, dtype=np.int64), np.empty(most, dtype=np.int64), 0
        active = len(group)
        for t in range(int(n[0])):
            while n[active - 1] <= t:
                active -= 1
            if len(h) != active:
                h, word, at = h[:active], word[:active], at[:active]
                gates, reset, new, of_gates, of_new = (v[:active] for v in (gates, reset, new, of_gates, of_new))
            here = slice(held, held + active)
            h = _advance(_rows(xg, word, of_gates), _rows(xn, word, of_new), uzr, un, h, gates, reset, new, states[here])
            word = np.take(flat, at, out=words[here], mode="clip")
            who[here] = group[:active]
            at += 1
            held += active
            if held >= FLUSH_TOKENS or t == n[0] - 1:
                out += np.bincount(who[:held], weights=network.log_p(states[:held], words[:held]), minlength=len(out))
                h, word, held = h.copy(), word.copy(), 0
    return out


def endings(words: Words) -> np.ndarray:
    """The shared entry of each word, 1 to ``PER_CLASS`` - 1, by its last three bytes."""
    data, out = words.data, np.zeros(len(words.starts), dtype=np.int64)
    for k in (1, 2, 3):
        at = words.ends - k
        out = out * 257 + np.where(at >= words.starts, data[np.maximum(at, 0)].astype(np.int64) + 1, 0)
    return (out * 0x9E3779B1 >> 13) % (PER_CLASS - 1) + 1


def _tokens(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text_or_empty().alias("text"))


def corpus_counts(docs: DataFrame, trains: Column) -> tuple[DataFrame, Counts]:
    """The table (h, n, e) of all training words with counts and endings, and the corpus statistics."""

    def counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        every, own = (np.concatenate(p) for p in zip(*parts, strict=True))
        # Any row of a word tells its ending, so the sort needn't be stable.
        order = np.argsort(every)
        every = every[order]
        first = np.flatnonzero(np.append(True, every[1:] != every[:-1])[: len(every)])
        h, n, own = every[first], np.diff(np.append(first, len(every))), own[order[first]]
        for lo in range(0, len(h), 1 << 18):
            cut = slice(lo, lo + (1 << 18))
            yield pa.RecordBatch.from_arrays([pa.array(h[cut].view(np.int64)), pa.array(n[cut].astype(np.int64)), pa.array(own[cut].astype(np.int32))], names=["h", "n", "e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        parts, held = [], 0
        for batch in batches:
            for _, _, w in word_chunks(batch.column("text"), graph=True):
                parts.append((w.hashes(), endings(w).astype(np.int8)))
                held += len(w.starts)
                if held >= COUNT_TOKENS:
                    yield from counted(parts)
                    parts, held = [], 0
        if parts:
            yield from counted(parts)

    learned = docs.where(trains)
    each = _tokens(learned).select("text").mapInArrow(run, "h long, n long, e int")
    table = saved(each.groupBy("h").agg(F.sum("n").alias("n"), F.min("e").alias("e")))
    documents = learned.count()
    by_ending = table.groupBy("e").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    tokens, words = np.zeros(PER_CLASS), np.zeros(PER_CLASS)
    for r in by_ending:
        tokens[r.e], words[r.e] = r.n, r.v
    total = int(tokens.sum()) + documents
    frequent = table.where(F.col("n") * FREQUENT_SHARE >= total).toArrow()
    hashes, counts, own = frequent.column("h").to_numpy().view(np.uint64), frequent.column("n").to_numpy(), frequent.column("e").to_numpy()
    order = np.argsort(hashes)
    return table, Counts(total, int(words.sum()) + (documents > 0), documents, hashes[order], counts[order], own[order], tokens, words)


def vocabulary(counts: Counts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each frequent word, -1 where it has none; frequency of each number; distinct words that share it).

    The first class is the end and the endings; words follow by falling count.
    """
    size = CLASSES * PER_CLASS
    best = np.lexsort((counts.words, -counts.counts))[: size - PER_CLASS]
    number = np.full(len(counts.words), -1, dtype=np.int64)
    number[best] = np.arange(PER_CLASS, PER_CLASS + len(best))
    by_ending = lambda w=None: np.bincount(counts.endings[best], weights=w, minlength=PER_CLASS)
    freq, kinds = np.zeros(size), counts.ending_words - by_ending()
    freq[:PER_CLASS] = counts.ending_tokens - by_ending(counts.counts[best])
    freq[END] = counts.documents
    freq[PER_CLASS : PER_CLASS + len(best)] = counts.counts[best]
    return number, freq, kinds


def numbered(docs: DataFrame, held_out: Column, counts: Counts) -> DataFrame:
    """Every row with its tokens' numbers (two bytes each), its counts and logs so far, and its rare words.

    ``base`` sums log10(count + 1) of the frequent words, ``rest`` that of those without
    a number, less log10 of the tokens and words that share each such word's entry.
    """
    number, freq, kinds = vocabulary(counts)
    words, logs = counts.words, np.log10(counts.counts + 1.0)
    shared = np.log10(freq[:PER_CLASS] + kinds + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for a, b, w in word_chunks(batch.column("text"), graph=True):
                h, own, n = w.hashes(), endings(w), b - a
                place = np.minimum(np.searchsorted(words, h), len(words) - 1) if len(words) else np.zeros(len(h), dtype=np.int64)
                here = words[place] == h if len(words) else np.zeros(len(h), dtype=bool)
                named = np.zeros(len(h), dtype=bool)
                named[here] = number[place[here]] >= 0
                own[named] = number[place[named]]
                flat = np.full(len(h) + n, END, dtype=np.int16)
                flat[np.arange(len(h)) + w.doc] = own
                log = np.where(here, logs[place], 0.0) if len(words) else np.zeros(len(h))
                rest = np.where(named, 0.0, log - shared[np.minimum(own, PER_CLASS - 1)])
                by_doc = lambda x, who=w.doc, size=n: np.bincount(who, weights=x, minlength=size)
                for column, x in zip(out, (w.counts + 1, by_doc(here), by_doc(log), by_doc(rest), flat, h[~here], by_doc(~here)), strict=True):
                    column.append(x)
            join = lambda k, kind: np.concatenate([*out[k], np.empty(0)]).astype(kind)  # noqa: B023, E731
            lengths = join(0, np.int64)
            flat = np.concatenate([*out[4], np.empty(0, dtype=np.int16)])
            cut = np.append(0, np.cumsum(2 * lengths)).astype(np.int64)
            ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(cut.tobytes()), pa.py_buffer(flat.tobytes())]).cast(pa.binary())
            rare = np.concatenate([*out[5], np.empty(0, dtype=np.uint64)]).view(np.int64)
            rare = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(join(6, np.int64))).astype(np.int32)), pa.array(rare))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), batch.column("node"), pa.array(lengths), pa.array(join(1, np.int64)), pa.array(join(2, np.float64)), pa.array(join(3, np.float64)), ids, rare],
                names=["doc_id", "held_out", "node", "n_tokens", "known", "base", "rest", "ids", "rare"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", held_out.alias("held_out"), text_or_empty().alias("text")).withColumn("node", F.xxhash64("text", "doc_id"))
    rows = rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, node long, n_tokens long, known long, base double, rest double, ids binary, rare array<long>")
    part = F.when(F.col("held_out"), -1).otherwise(F.pmod(F.shiftright("node", 40), F.lit(ROUNDS))).cast("int")
    return rows.withColumn("row", F.monotonically_increasing_id()).withColumn("round", part)


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a binary column's rows on end, and each row's count."""
    sizes = np.diff(np.frombuffer(column.buffers()[1], dtype=np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1])
    data = column.buffers()[2]
    begin = int(np.frombuffer(column.buffers()[1], dtype=np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset]) if len(column) else 0
    flat = np.frombuffer(data, dtype=np.int16, offset=begin, count=int(sizes.sum()) // 2) if data is not None else np.empty(0, dtype=np.int16)
    return flat, sizes.astype(np.int64) // 2


def fit(rows: DataFrame, counts: Counts) -> Network:
    """The network after all rounds over the training rows of ``numbered``."""
    _, freq, _ = vocabulary(counts)
    replicas = int(max(1, min(MOST_REPLICAS, counts.tokens // ROUNDS // REPLICA_TOKENS)))
    kind = "replica int, weights binary, seen long"
    chunk, weights = REPLICA_TOKENS, None

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        state: dict = {"replica": None}

        def start(replica: int) -> None:
            state.update(replica=replica, network=Network(freq), held=[], size=0, seen=0)
            if weights is not None:
                state["network"].unpack(weights)

        def learn() -> None:
            if state["size"]:
                state["seen"] += state["network"].learn(np.concatenate(state["held"]))
            state.update(held=[], size=0)

        def done() -> pa.RecordBatch:
            learn()
            packed = state["network"].packed().tobytes()
            return pa.RecordBatch.from_arrays([pa.array([state["replica"]], pa.int32()), pa.array([packed], pa.binary()), pa.array([state["seen"]], pa.int64())], names=["replica", "weights", "seen"])

        for batch in batches:
            flat, sizes = _numbers(batch.column("ids"))
            ends, owner = np.cumsum(sizes), batch.column("replica").to_numpy()
            cuts = np.append(np.flatnonzero(np.diff(owner, prepend=-1)), len(owner))
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if state["replica"] != owner[i]:
                    if state["replica"] is not None:
                        yield done()
                    start(int(owner[i]))
                state["held"].append(flat[ends[i] - sizes[i] : ends[j - 1]].copy())
                state["size"] += int(ends[j - 1] - ends[i] + sizes[i])
                if state["size"] >= chunk:
                    learn()
        if state["replica"] is not None:
            yield done()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc, n = 0.0, 0
        for batch in batches:
            for packed, seen in zip(batch.column("weights"), batch.column("seen").to_pylist(), strict=True):
                acc = acc + np.frombuffer(packed.as_buffer(), dtype=np.float32).astype(np.float64) * seen
                n += seen
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([acc.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["replica", "weights", "seen"])

    for k in range(ROUNDS if counts.documents else 0):
        dealt = rows.where(F.col("round") == k).select("ids", "node", "doc_id", F.pmod("node", F.lit(replicas)).cast("int").alias("replica"))
        dealt = dealt.repartitionById(replicas, "replica").sortWithinPartitions("replica", "node", "doc_id").select("ids", "replica")
        grown = dealt.mapInArrow(local, kind)
        summers = min(replicas, _SUMMERS)
        sums = grown.repartitionById(summers, F.pmod("replica", F.lit(summers))).sortWithinPartitions("replica").mapInArrow(total, kind).collect()
        if sums:
            weights = sum(np.frombuffer(r.weights) for r in sums) / sum(r.seen for r in sums)
    return Network(freq) if weights is None else Network(freq).unpack(weights)


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    single_threaded(docs.sparkSession)
    table, counts = corpus_counts(docs, ~held_out)
    rows = stored(numbered(docs, held_out, counts), "lm", "round")
    network = fit(rows, counts)
    tokens, distinct, documents = counts.tokens, counts.distinct, counts.documents

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        for batch in batches:
            total = score_documents(network, *_numbers(batch.column("ids"))) / math.log(10)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(total)], names=[*batch.schema.names[:-1], "total"])

    kind = dict(docs.dtypes)["doc_id"]
    scored = rows.select("row", "doc_id", "held_out", "n_tokens", "known", "base", "rest", "ids")
    scored = scored.mapInArrow(run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, rest double, total double")
    each = rows.select("row", F.explode("rare").alias("h"))
    looked = each.join(table.where(F.col("n") * FREQUENT_SHARE < tokens), "h").groupBy("row").agg(F.sum(F.log10(F.col("n") + 1.0)).alias("r"), F.count("*").alias("k"))
    full = scored.join(looked, "row", "left").fillna({"r": 0.0, "k": 0})
    least = math.log10(tokens + distinct + 1)
    return full.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.col("k") + F.lit(int(documents > 0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("r") + math.log10(documents + 1) - F.col("n_tokens") * least).alias("base_score"),
        (F.col("total") + F.col("rest") + F.col("r")).alias("score"),
    )
