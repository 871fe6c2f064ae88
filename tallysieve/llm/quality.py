"""Quality by ordinal cumulative-link regression on graded ratings.

All grades share one weight for each hashed feature of the text; ordered thresholds
cut the latent score: P(grade >= k) = sigmoid(w x - t_k) with t_1 < t_2 < ...  The
model gives the expected grade and the probability of the upper tail.

Defined results: a null text counts as empty; without labels every grade is as
likely; a grade that no label has gets a threshold next to its neighbour's; repeated
rows score alike; very long texts are read whole; a null id is held out or not by the crc32
of the empty text; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallysieve.llm import screened
from tallysieve.llm.textkit import id_crc, text_or_empty

GRADES = 3
RIDGE = 1e-4
#: Rows count as kept if P(grade >= 1) is at least this.
KEEP_AT = 0.5


def graded(quality: str = "quality", toxic: str = "toxic") -> Column:
    """0: low quality; 1: good but toxic; 2: good. Null without a quality label."""
    return F.when(F.col(quality) == 0, 0).when(F.col(toxic) == 1, 1).when(F.col(quality) == 1, 2)


@dataclass
class Model:
    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, z: np.ndarray) -> np.ndarray:
        """texts x (grades - 1): P(grade >= k)."""
        return screened.sigmoid(z[:, None] - self.thresholds[None, :])


def fit_rows(rows: dict[str, np.ndarray], grades: int = GRADES, ridge: float = RIDGE) -> Model:
    """``fit_places`` of rows at hand: grades y and features x."""
    y = rows["y"].astype(np.int64)
    parts = [screened.screen(rows["x"], (y >= k).astype(float)) for k in range(1, grades)]
    chosen = np.unique(np.concatenate(parts)) if parts else np.empty(0, dtype=np.uint64)
    return fit_places(y, chosen, screened.matrix(rows["x"], chosen), grades, ridge)


def fit_places(y: np.ndarray, chosen: np.ndarray, places: tuple[np.ndarray, np.ndarray], grades: int = GRADES, ridge: float = RIDGE) -> Model:
    y, n = y.astype(np.int64), len(y)
    share = np.array([(y >= k).sum() + 0.5 * (grades - k) for k in range(1, grades)]) / (n + 0.5 * grades)
    first = -np.log(share / (1 - share))
    first = np.maximum.accumulate(first + np.arange(grades - 1) * 1e-6)
    if not len(chosen):
        return Model(chosen, np.empty(0), first)
    r, c = places
    k = len(chosen)
    start = np.concatenate([np.zeros(k), first[:1], np.log(np.maximum(np.diff(first), 1e-3))])

    def thresholds(tail: np.ndarray) -> np.ndarray:
        return np.concatenate([tail[:1], tail[0] + np.cumsum(np.exp(tail[1:]))])

    def gradient(w: np.ndarray) -> np.ndarray:
        z, t = screened.linear(r, c, w[:k], n), thresholds(w[k:])
        up = np.concatenate([np.ones((n, 1)), screened.sigmoid(z[:, None] - t[None, :]), np.zeros((n, 1))], axis=1)
        rows_ = np.arange(n)
        lo, hi = up[rows_, y], up[rows_, y + 1]
        p = np.maximum(lo - hi, 1e-12)
        d_lo, d_hi = lo * (1 - lo), hi * (1 - hi)
        dz = -(d_lo - d_hi) / p / n
        dt = np.zeros(grades + 1)
        np.add.at(dt, y, d_lo / p / n)
        np.add.at(dt, y + 1, -d_hi / p / n)
        dt = dt[1:grades]
        steps = np.array([dt[j:].sum() for j in range(1, len(dt))]) * np.exp(w[k + 1 :])
        return np.concatenate([np.bincount(c, weights=dz[r], minlength=k) + ridge * w[:k], [dt.sum()], steps])

    w = screened.descend(gradient, start)
    return Model(chosen, w[:k], thresholds(w[k:]))


def fit(docs: DataFrame, labels: DataFrame, grade: Column, *, sample_rows: int = screened.SAMPLE_ROWS) -> Model:
    """Fit on about ``sample_rows`` labelled rows of the training folds (crc32 of the id mod 4 is not 2)."""
    part = screened.sample(docs, labels, grade, F.pmod(id_crc(), F.lit(4)) != 2, sample_rows, screened.style_features)
    chosen = screened.screened(part, [(part.y >= k).astype(float) for k in range(1, GRADES)])
    return fit_places(part.y, chosen, screened.places(part, chosen)[0])


def score(docs: DataFrame, model: Model, keep_at: float = KEEP_AT) -> DataFrame:
    """doc_id, held_out, expected_grade, p_ok (grade 1 or more), p_best (the top grade) and keep of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.zeros(batch.num_rows)
            for a, b, _, who, what in screened.chunk_features(batch.column("text"), screened.style_features):
                rows, cols = screened.located(who, what, model.features)
                z[a:b] = screened.linear(rows, cols, model.weights, b - a)
            tails = model.tails(z)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(tails.sum(axis=1)), pa.array(tails[:, 0].copy()), pa.array(tails[:, -1].copy()), pa.array(tails[:, 0] >= keep_at)],
                names=["doc_id", "held_out", "expected_grade", "p_ok", "p_best", "keep"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", (F.pmod(id_crc(), F.lit(4)) == 2).alias("held_out"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, expected_grade double, p_ok double, p_best double, keep boolean")
