"""Toxicity scores from a counterfactual-regularised linear classifier.

The classifier learns from word presence in labelled texts.  Each labelled text
that names a group also comes with its identity terms swapped for others of
their kind; the fit penalises the squared change of the score, so the name of a
group gains no weight of its own and neutral mentions are not rejected.

Defined results: a null text counts as empty and scores the share of toxic texts
among those without a telling word; without labels every score is 0.05; repeated
rows score alike; very long texts are read whole; a null id is held out or not by the crc32
of the empty text; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallysieve.llm import screened
from tallysieve.llm.textkit import id_crc, rewritten, text_or_empty, word_chunks, words_of

#: Terms that name people by group; each list is a ring of counterparts.
IDENTITY_RINGS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("girl", "boy"),
    ("female", "male"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "lesbian", "bisexual", "straight", "queer"),
    ("transgender", "cisgender"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("immigrant", "native", "refugee"),
    ("immigrants", "natives", "refugees"),
    ("disabled", "deaf", "blind"),
    ("old", "young", "elderly"),
)
THRESHOLD = 0.3
SPREAD = 4.0
RIDGE = 1e-5


def word_hash(word: str) -> int:
    data = np.frombuffer(word.encode(), dtype=np.uint8)
    return int(words_of(data, np.array([0, len(data)])).hashes()[0])


def identity_swaps(rings: tuple[tuple[str, ...], ...] = IDENTITY_RINGS) -> dict[int, int]:
    return {word_hash(a): word_hash(b) for ring in rings for a, b in zip(ring, ring[1:] + ring[:1], strict=True)}


@dataclass
class Model:
    features: np.ndarray
    weights: np.ndarray
    bias: float


Places = tuple[np.ndarray, np.ndarray]


def fit_rows(rows: dict[str, np.ndarray], spread: float = SPREAD, ridge: float = RIDGE) -> Model:
    """``fit_places`` of rows at hand: labels y, features x and their swapped forms."""
    chosen = screened.screen(rows["x"], rows["y"])
    changed = sum(a is not b for a, b in zip(rows["x"], rows["swapped"], strict=True))
    return fit_places(rows["y"], chosen, screened.matrix(rows["x"], chosen), screened.matrix(rows["swapped"], chosen), changed, spread, ridge)


def fit_places(y: np.ndarray, chosen: np.ndarray, plain: Places, swapped: Places, changed: int, spread: float = SPREAD, ridge: float = RIDGE) -> Model:
    """Logistic loss plus ``spread`` times the mean squared score change under swapping."""
    n, k = len(y), len(chosen)
    prior = (y.sum() + 0.1) / (n + 2)
    start = np.zeros(k + 1)
    start[-1] = np.log(prior / (1 - prior))
    if not k:
        return Model(chosen, start[:-1], float(start[-1]))
    (r, c), (rs, cs) = plain, swapped

    def gradient(w: np.ndarray) -> np.ndarray:
        z = screened.linear(r, c, w, n)
        moved = z - screened.linear(rs, cs, w, n)
        off, pull = (screened.sigmoid(z + w[-1]) - y) / n, 2 * spread * moved / max(1, changed)
        g = np.bincount(c, weights=(off + pull)[r], minlength=k) - np.bincount(cs, weights=pull[rs], minlength=k)
        return np.append(g + ridge * w[:-1], off.sum())

    w = screened.descend(gradient, start)
    return Model(chosen, w[:-1], float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, *, sample_rows: int = screened.SAMPLE_ROWS, spread: float = SPREAD) -> Model:
    """Fit on about ``sample_rows`` labelled rows of the training folds (crc32 of the id mod 4 is not 2)."""
    part = screened.sample(docs, labels, F.col("toxic"), F.pmod(id_crc(), F.lit(4)) != 2, sample_rows, screened.word_features, identity_swaps())
    chosen = screened.screened(part, [part.y])
    return fit_places(part.y, chosen, *screened.places(part, chosen), spread)


def _logits(column: pa.Array, model: Model) -> np.ndarray:
    """The score of each text before the sigmoid."""
    z, k = np.full(len(column), model.bias), max(1, len(model.features))
    for a, b, words in word_chunks(column):
        rows, cols = screened.located(words.doc, words.hashes(), model.features)
        cells = np.unique(rows * k + cols)
        z[a:b] += screened.linear(cells // k, cells % k, model.weights, b - a)
    return z


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = screened.sigmoid(_logits(batch.column("text"), model))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", (F.pmod(id_crc(), F.lit(4)) == 2).alias("held_out"), text_or_empty().alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the classifier rejects; all columns stay."""
    model = fit(docs, labels)
    return rewritten(docs, lambda batch, texts: batch.filter(pa.array(screened.sigmoid(_logits(texts, model)) < THRESHOLD)))
