"""Vectorised text handling that the operators of this package share.

Texts arrive in Arrow batches.  Words are found and hashed with numpy over the
raw UTF-8 bytes, so no per-word Python object is made.  All 64-bit hashes here
are fixed functions of the bytes: equal words have equal hashes in any task, on
any machine, in any run.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower-cased.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of text that are held as numpy arrays at a time.
CHUNK_BYTES = 1 << 18
#: Bytes of an Arrow batch between an executor and its Python workers, which hold several at a time.
BATCH_BYTES = 8 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_IS_GRAPH = np.ones(256, dtype=bool)
_IS_GRAPH[[32, 9, 10, 11, 12, 13]] = False

_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Keeps the first k of eight bytes.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the finaliser of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def lower_ascii(text: str) -> str:
    """A-Z lower-cased, all else as it is."""
    return text.translate(_LOWER_MAP)


_LOWER_MAP = {c: c + 32 for c in range(65, 91)}


@dataclass
class Words:
    """Words of some texts, in order.

    ``starts`` and ``ends`` are byte offsets into ``data`` (lower-cased),
    ``doc`` the index of each word's text, ``counts`` the words of each text.
    """

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    counts: np.ndarray
    offsets: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        left = self.ends - self.starts
        out = mix64(left.astype(np.uint64) + _STEP)
        padded = np.concatenate([self.data, np.zeros(8, dtype=np.uint8)])
        eights = np.ndarray(len(self.data) + 1, dtype="<u8", buffer=padded, strides=(1,))
        at, who = self.starts, None
        while len(at):
            part = eights[at] & _MASKS[np.minimum(left, 8)]
            more = np.flatnonzero(left > 8)
            if who is None:
                out = mix64(out * _STEP + part)
                who = more
            else:
                out[who] = mix64(out[who] * _STEP + part)
                who = who[more]
            at, left = at[more] + 8, left[more] - 8
        return out

    def text(self, k: int) -> str:
        return self.data[self.starts[k] : self.ends[k]].tobytes().decode("utf-8", "replace")


def keep_freed() -> None:
    """From now on this process keeps up to some 60 MB that it has freed, for arrays to come.

    The C library hands freed memory back from twice the size of the largest block that it
    has seen freed, so that otherwise each chunk's arrays are fresh pages to be cleared.
    """
    np.empty(30 << 20, dtype=np.uint8)


def words_of(data: np.ndarray, offsets: np.ndarray, *, graph: bool = False) -> Words:
    """Words of the texts ``data[offsets[i]:offsets[i + 1]]``.

    ``graph`` takes runs without blanks (0x20, 0x09-0x0D) instead of words.
    """
    data = _LOWER[data]
    inside = (_IS_GRAPH if graph else _IS_WORD)[data]
    n = len(data)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    doc = np.searchsorted(offsets, starts, side="right") - 1
    return Words(data, starts, ends, doc, np.bincount(doc, minlength=len(offsets) - 1), offsets)


def raw_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a string or binary column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.empty(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def spans_of_rows(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes; a longer text is a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def word_chunks(column: pa.Array, *, graph: bool = False, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, last row, words) for row ranges of bounded size."""
    data, offsets = raw_texts(column)
    for a, b in spans_of_rows(offsets, limit):
        lo, hi = offsets[a], offsets[b]
        yield a, b, words_of(data[lo:hi], offsets[a : b + 1] - lo, graph=graph)


def shingle_hashes(hashes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of all runs of ``size`` words; all words of a shorter text are one run."""
    n = len(hashes)
    if not n:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    ends = np.cumsum(counts)
    begins = ends - counts
    doc = np.repeat(np.arange(len(counts)), counts)
    room = ends[doc] - np.arange(n)
    short = counts[doc] < size
    keep = (room >= size) | (short & (np.arange(n) == begins[doc]))
    acc = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        here = np.zeros(n, dtype=np.uint64)
        if k < n:
            here[: n - k] = hashes[k:]
        here[room <= k] = np.uint64(k + 1)
        acc = mix64(acc + here * _STEP + np.uint64(k))
    at = np.flatnonzero(keep)
    return acc[at], doc[at]


def rewritten(docs: DataFrame, change: Callable[[pa.RecordBatch, pa.Array], pa.RecordBatch]) -> DataFrame:
    """``docs`` with each Arrow batch passed through ``change(batch, texts)``; nulls among the texts are empty.

    Columns go by place in between: names may hold dots or clash with the operators' own.
    """
    names = docs.columns
    plain = docs.toDF(*(f"c{k}" for k in range(len(names))))
    own = plain.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield change(pa.RecordBatch.from_arrays(batch.columns[:-1], names=own), batch.column(len(own)))

    with_text = plain.select("*", text_or_empty(own[names.index("text")]).alias("t"))
    return with_text.mapInArrow(run, plain.schema).toDF(*names)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def id_crc(name: str = "doc_id") -> Column:
    """crc32 of an id's decimal digits; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary"))


def checkpoint_ready(spark: SparkSession) -> None:
    """Make sure that ``DataFrame.checkpoint`` has a folder that all executors share.

    The session's own setting holds.  Only a session that runs in one process may
    fall back to a temporary folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    context.setCheckpointDir(folder)


def saved(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in the shared folder: computed once, safe from lost executors."""
    checkpoint_ready(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows can be long: writers look at what they hold after each row and keep little of it.
_SMALL_GROUPS = {"parquet.block.size": 8 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1, "parquet.enable.dictionary": "false"}


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, in a folder for each value of ``by``: readers prune rows and columns."""
    spark = df.sparkSession
    checkpoint_ready(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    (df.write.partitionBy(*by) if by else df.write).options(**_SMALL_GROUPS).parquet(folder)
    return spark.read.schema(schema).parquet(folder)


def single_threaded(spark: SparkSession) -> None:
    """Python workers that start from now on use one thread each for matrix products: Spark runs one on every core."""
    spark.sparkContext.environment.setdefault("OMP_NUM_THREADS", "1")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; its rows go to Python workers in batches of ``BATCH_BYTES``, not of Spark's default of 64 MB, where the session leaves that open."""
    if spark.conf.get(_BATCH_SETTING, None) in (None, "67108864b"):
        spark.conf.set(_BATCH_SETTING, f"{BATCH_BYTES}b")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
