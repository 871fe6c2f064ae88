"""Whitening of embeddings from an exact integer scatter.

Every entry becomes an integer, ``floor(64 * c) + SHIFT``.  Executors subtract the shift
and sum values and products exactly: values are cut into limbs small enough for a matrix
product of floats to be exact, and the products are added as integers of any size.  The
driver gets one row for each pair of dimensions, forms ``n * XtX - S * St`` exactly, and
only then converts it to floats and decomposes it with ``eigh``.  So the covariance has no
error but that of its last conversion, however far the values are from zero, and does not
depend on how rows are spread over tasks.

What the driver and the tasks hold is bounded by the square of the dimensions, at most
``MOST_DIMENSIONS``.

Defined results: rows whose vector is null, empty, or holds null or non-finite entries are
dropped, as are rows with another number of entries than most rows have (the larger number
if two are as frequent); entries beyond the range of a long are taken as its ends.
Repeated rows and ids count each; a null id is kept; other columns are ignored.
Directions without variance can't be scaled to one and are left out, so equal vectors or
a single one give no rows, like an empty table.  Among equal eigenvalues the order is
that of ``eigh``.  ``deviation`` is a decimal, null where it has more than 38 digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallysieve.llm.textkit import BATCH_BYTES, single_threaded

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
MOST_DIMENSIONS = 4096
#: Limbs of 20 bits: a float product of two, summed over 4096 rows, is exact.
LIMB, ROWS = 20, 4096
#: Sums travel as limbs of 32 bits, the last with the sign.
PARTS = 6
_EDGE = 2.0**62


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """``vectors`` without rows whose vector is null, empty or holds null or non-finite entries."""
    v = F.col(column)
    # Null for a null vector; a null entry is no finite one.
    fine = F.forall(v, lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    return vectors.where(fine & (F.size(v) > 0))


def as_integers(column: pa.Array) -> np.ndarray:
    """One row of integers, less ``SHIFT``, for each vector."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.floor(np.clip(SCALE * flat, -_EDGE, _EDGE)).astype(np.int64).reshape(len(column), -1)


def exact_products(x: np.ndarray) -> np.ndarray:
    """``x.T @ x`` as Python integers."""
    limbs, rest = [], x
    while True:
        low = rest & ((1 << LIMB) - 1)
        rest = rest >> LIMB
        if not ((rest != 0) & (rest != -1)).any():
            # The rest is the sign, which the last limb holds.
            limbs.append((low + (rest << LIMB)).astype(np.float64))
            break
        limbs.append(low.astype(np.float64))
    out = np.zeros((x.shape[1], x.shape[1]), dtype=object)
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs[: i + 1]):
            product = (a.T @ b).astype(np.int64)
            both = product if i == j else product + product.T
            out += both.astype(object) << (LIMB * (i + j))
    return out


def _parts_of(numbers: np.ndarray) -> list[np.ndarray]:
    """Python integers as ``PARTS`` columns of longs."""
    out = []
    for _ in range(PARTS - 1):
        out.append((numbers & 0xFFFFFFFF).astype(np.int64))
        numbers = numbers >> 32
    return [*out, numbers.astype(np.int64)]


@dataclass
class Whitening:
    """Exact sums of the fit list and what follows from them."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def components(self) -> int:
        return len(self.eigenvalues)


def scatter(vectors: DataFrame, column: str, dimensions: int) -> tuple[int, list[int], np.ndarray]:
    """(n, sums, ``n * XtX - S * St``), exactly; values are less ``SHIFT``, which changes no scatter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, products = 0, np.zeros(dimensions, dtype=object), np.zeros((dimensions, dimensions), dtype=object)
        for batch in batches:
            for k in range(0, len(batch), ROWS):
                x = as_integers(batch.column(0).slice(k, ROWS))
                n += len(x)
                # 4096 values of 62 bits and a sign: add them as two halves.
                total += ((x >> 32).sum(axis=0).astype(object) << 32) + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
                products += exact_products(x)
        if n:
            upper = np.triu_indices(dimensions)
            values = np.concatenate([np.array([n], dtype=object), total, products[upper]])
            place = np.arange(len(values), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(place), *map(pa.array, _parts_of(values))], names=["place", *(f"p{k}" for k in range(PARTS))])

    partial = vectors.select(column).mapInArrow(run, "place long, " + ", ".join(f"p{k} long" for k in range(PARTS)))
    rows = partial.groupBy("place").agg(*(F.sum(f"p{k}").alias(f"p{k}") for k in range(PARTS))).collect()
    values = {r["place"]: sum(r[f"p{k}"] << 32 * k for k in range(PARTS)) for r in rows}
    if not values:
        return 0, [], np.zeros((0, 0), dtype=object)
    n, sums = values[0], [values[1 + k] for k in range(dimensions)]
    out = np.zeros((dimensions, dimensions), dtype=object)
    for place, (i, j) in enumerate(zip(*(a.tolist() for a in np.triu_indices(dimensions))), 1 + dimensions):
        out[i, j] = out[j, i] = n * values[place] - sums[i] * sums[j]
    return n, sums, out


def fit(vectors: DataFrame, column: str = "embedding", *, components: int = COMPONENTS) -> tuple[DataFrame, Whitening | None]:
    """(the rows of the fit list, their whitening; None where there are none or no direction has variance)."""
    single_threaded(vectors.sparkSession)
    rows = usable(vectors, column)
    size = F.size(column)
    common = rows.groupBy(size.alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if common is None:
        return rows, None
    if common["size"] > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {common['size']} dimensions; the scatter is held for {MOST_DIMENSIONS} at most")
    rows = rows.where(size == common["size"])
    n, sums, exact = scatter(rows, column, common["size"])
    # Powers of two keep every digit, and floats in range.
    bits = max(int(v).bit_length() for v in exact.diagonal())
    if not bits:
        return rows, None
    drop = max(0, bits - 900)
    scaled = np.array([[float(v >> drop) if drop else float(v) for v in row] for row in exact.tolist()])
    factor = float(1 << drop) / float(n) / float(n) if drop < 1000 else np.inf
    values, directions = np.linalg.eigh(scaled)
    values, directions = values[::-1], directions[:, ::-1]
    # Below this, an eigenvalue is the rounding of the others.
    seen = values > values[0] * len(values) * np.finfo(np.float64).eps
    used = min(components, int(seen.sum()))
    directions = directions[:, :used]
    directions = directions * np.sign(directions[np.abs(directions).argmax(axis=0), np.arange(used)])
    return rows, Whitening(n, sums, values[:used] * factor, directions, float(np.trace(scaled)) * factor)


def _centred(x: np.ndarray, fitted: Whitening) -> tuple[np.ndarray, list[int]]:
    """(values less their mean, the exact squared length of ``n`` times that) for each row."""
    n, sums = fitted.n, np.array(fitted.sums, dtype=object)
    bound = max((int(max(x.max(), -x.min())) if x.size else 0) * n + max(map(abs, fitted.sums)), 1)
    if bound**2 * x.shape[1] < 1 << 63:
        u = n * x - sums.astype(np.int64)
        return u / n, (u * u).sum(axis=1).tolist()
    u = x.astype(object) * n - sums
    return (u / n).astype(np.float64), (u * u).sum(axis=1).tolist()


def _whitened(x: np.ndarray, fitted: Whitening) -> tuple[np.ndarray, list[int]]:
    centred, squares = _centred(x, fitted)
    return centred @ fitted.vectors / np.sqrt(fitted.eigenvalues), squares


def identity_error(rows: DataFrame, column: str, fitted: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity, over all rows.

    Tasks centre their rows before they multiply; their means and products are merged in the order of the tasks' sums,
    and there are as many of these as tasks, of components squared numbers each, added up on executors.
    """
    k = fitted.components
    names = [f"m{i}" for i in range(k)]

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                total += _whitened(as_integers(batch.column(0).slice(at, ROWS)), fitted)[0].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in total], names=names)

    only = rows.select(column)
    sums = only.mapInArrow(means, ", ".join(f"{m} double" for m in names)).agg(*(F.sum(m).alias(m) for m in names)).first()
    mean = np.array([sums[m] for m in names]) / fitted.n

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                w = _whitened(as_integers(batch.column(0).slice(at, ROWS)), fitted)[0] - mean
                total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(total.ravel())], names=["place", "value"])

    partial = only.mapInArrow(products, "place long, value double").groupBy("place").agg(F.sum("value").alias("value"))
    worst = partial.select(F.max(F.abs(F.col("value") / fitted.n - F.when(F.col("place") % (k + 1) == 0, 1.0).otherwise(0.0))).alias("worst")).first()
    return float(worst.worst)


def whiten(vectors: DataFrame, column: str = "embedding", id_column: str = "vec_id", *, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every row of the fit list and component."""
    kind = vectors.schema[id_column].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    rows, fitted = fit(vectors, column, components=components)
    if fitted is None:
        return vectors.sparkSession.createDataFrame([], schema)
    error = identity_error(rows, column, fitted)
    k = fitted.components
    share = fitted.eigenvalues / fitted.trace
    step = max(1, BATCH_BYTES // (k * 64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), step):
                part = batch.slice(at, step)
                white, squares = _whitened(as_integers(part.column(1)), fitted)
                m = len(part)
                deviation = pa.array([Decimal(v) if v < 10**38 else None for v in squares], type=pa.decimal128(38, 0))
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(each),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, fitted.n, dtype=np.int64)),
                        deviation.take(each),
                        pa.array(white.ravel()),
                        pa.array(np.tile(share, m)),
                        pa.array(np.full(m * k, error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.select(id_column, column).mapInArrow(run, schema)
