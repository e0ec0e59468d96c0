"""Quality scores by nearest-neighbour voting among latent-semantic vectors.

A text is a bag of hashed byte n-grams and of a few shape counts, weighted by
log frequency and inverse document frequency and projected on the leading
singular directions of the labelled sample.  The labelled vectors, their
number bounded by ``per_label`` for each label, are broadcast; a task takes
the exact cosines of its documents with all of them, block by block as one
matrix product, and the ``neighbours`` nearest vote with their similarity.

Defined results: null and empty texts are scored like any other, as vectors
without features, whose score is the labelled sample's mean; so is every
text where there is nothing to learn from (0.5 if no label at all).  Repeated
rows are learned from once and scored each; of neighbours at equal distance any
may vote, as their similarity is the same; a very long text is read whole, in a
block of its own; an empty table gives an empty result.  Kept columns may have
any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import FOLD, bounded_sample, column_blocks, counts
from .quality_rules import statistics
from .session import carried
from .session import restored as named

BITS, ORDERS, DOCS = 12, (2, 3), 256

#: Bytes by class: upper and lower letters, digits, and each mark by itself.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[65:91], SHAPE[97:123], SHAPE[48:58], SHAPE[128:] = 65, 97, 48, 97


def features(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Log counts per 1000 bytes of n-grams and of shapes, and rates of the text."""
    size = np.maximum(np.diff(offsets), 1)[:, None]
    grams = counts(buf, offsets, ORDERS, BITS, FOLD)
    shapes = counts(buf, offsets, (1, 3), 9, SHAPE)
    s = statistics(buf, offsets)
    words = np.maximum(s["n_words"], 1)
    rates = [s["n_repeat_words"] / words, s["n_dup_lines"] / np.maximum(s["n_lines"], 1), s["n_symbols"] / words, s["n_upper"] / np.maximum(s["word_chars"], 1), s["n_digits"] / np.maximum(s["word_chars"], 1), 1 / words, s["n_lines"] / words, s["word_chars"] / words / 10]
    rate = np.stack([np.floor(8 * np.sqrt(np.minimum(r, 1))) for r in rates], axis=1).astype(int)
    onehot = np.zeros((len(size), len(rates) * 9), dtype=np.float32)
    for k in range(len(rates)):
        onehot[np.arange(len(size)), 9 * k + rate[:, k]] = 1
    onehot[s["n_words"] == 0] = 0
    return np.hstack([np.log1p(1000 * grams / size), 2 * np.log1p(1000 * shapes / size), 8 * onehot]).astype(np.float32)


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, buf, offsets in column_blocks(batch, 1, DOCS):
            rows = features(buf, offsets).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([r.tobytes() for r in rows], pa.binary())], ["label", "x"])


class QualityModel:
    """Feature weights, directions, and the labelled vectors with their labels."""

    def __init__(self, idf: np.ndarray, directions: np.ndarray, vectors: np.ndarray, labels: np.ndarray, neighbours: int):
        self.idf, self.directions, self.vectors, self.labels = idf, directions, vectors, labels
        self.neighbours, self.mean = neighbours, float(labels.mean())

    def latent(self, x: np.ndarray) -> np.ndarray:
        z = (x * self.idf) @ self.directions
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def scores(self, x: np.ndarray) -> np.ndarray:
        empty = x.sum(axis=1) == 0
        cos = self.latent(x) @ self.vectors.T
        k = min(self.neighbours, cos.shape[1])
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        sim = np.take_along_axis(cos, near, axis=1)
        vote = np.exp(20 * (sim - sim.max(axis=1, keepdims=True))) + 1e-12
        score = (vote * self.labels[near]).sum(axis=1) / vote.sum(axis=1)
        return np.where(empty, self.mean, np.clip(score, 0, 1))


def fit(train: DataFrame, per_label: int = 800, rank: int = 64, neighbours: int = 15) -> QualityModel | None:
    """A model from ``train(label, text)`` of labels 0 and 1."""
    some = bounded_sample(train.where("label is not null").select("label", F.coalesce("text", F.lit("")).alias("text")), "label", per_label)
    rows = some.mapInArrow(_features_of, "label int, x binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (bytes(r["x"]), r["label"]))
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in rows), dtype=np.float16).reshape(len(rows), -1).astype(np.float32)
    labels = np.array([r["label"] for r in rows], dtype=np.float64)
    idf = np.log1p(len(x) / (1 + (x > 0).sum(axis=0))).astype(np.float32)
    x *= idf
    values, vectors = np.linalg.eigh(x @ x.T)
    top = np.argsort(-values)[:rank]
    top = top[values[top] > 1e-6 * max(values.max(), 1e-9)]
    if not len(top):
        return None
    directions = (x.T @ vectors[:, top] / np.sqrt(values[top])).astype(np.float32)
    model = QualityModel(idf, directions, np.zeros(0), labels, neighbours)
    z = x @ directions
    model.vectors = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
    return model


def _score(model: QualityModel | None, n_kept: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offsets in column_blocks(batch, n_kept, DOCS):
                score = np.full(j - i, 0.5) if model is None else model.scores(features(buf, offsets))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(n_kept)), pa.array(np.round(score.astype(np.float64), 6))], [*batch.schema.names[:n_kept], "score"])

    return run


def score_quality(docs: DataFrame, model: QualityModel | None, keep: list[str]) -> DataFrame:
    """The ``keep`` columns and the score of each row of ``docs``."""
    rows, ddl = carried(docs, keep)
    return named(rows.mapInArrow(_score(model, len(keep)), f"{ddl}, score double"), keep)
