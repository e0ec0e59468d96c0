"""Language identification by a string kernel.

The kernel of two texts is the blended spectrum of presence: how many byte
n-grams of orders ``orders`` occur in both, over the root of the product of
how many occur in each.  ``landmarks`` training texts give a Nyström
approximation of its feature space, and one-versus-rest kernel ridge
regression in that space gives a score for each language.  Texts are scored
whole, in blocks, by two matrix products: with the landmarks' n-gram rows
and with the regression's weights.

The classifier is fitted on a bounded sample: at most ``per_language`` rows
of every language that has a labelled row, as packed bits.  Landmarks grow
with the languages: ``landmarks`` in all, or ``least_landmarks`` of each
language where that is more.  Sample rows are unpacked block by block, so
what the driver holds is landmarks * 2**bits numbers and the packed rows.

Defined results: ``und`` with score 0 for a null text, a text without any
letter, or where there is nothing to learn from; ties go to the language
that sorts first; a null doc_id falls in the fold of the empty text; rows
without a language are scored but not learned from; repeated rows are learned
from once and scored each; a very long text is read whole, in a block of its
own; an empty table gives an empty result.  Kept columns may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import bounded_sample, column_blocks, presence
from .session import carried
from .session import restored as named

_LETTER = re.compile(r"[^\W\d_]")
DOCS = 256


def _packed(orders: tuple[int, ...], bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offsets in column_blocks(batch, 1, DOCS):
                rows = np.packbits(presence(buf, offsets, orders, bits) > 0, axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([r.tobytes() for r in rows], pa.binary())], ["lang", "bits"])

    return run


class LanguageModel:
    """Landmark rows, and regression weights on kernel values."""

    def __init__(self, languages: list[str], landmarks: np.ndarray, weights: np.ndarray, orders: tuple[int, ...], bits: int):
        self.languages, self.landmarks, self.weights = languages, landmarks, weights
        self.orders, self.bits = orders, bits

    def kernel(self, x: np.ndarray) -> np.ndarray:
        size = np.sqrt(np.maximum(x.sum(axis=1), 1))
        return (x @ self.landmarks.T) / size[:, None] / np.sqrt(np.maximum(self.landmarks.sum(axis=1), 1))[None, :]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.kernel(x) @ self.weights


def _unpacked(rows: list, bits: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(bytes(r["bits"]) for r in rows), dtype=np.uint8).reshape(len(rows), -1), axis=1, count=1 << bits).astype(np.float32)


def fit(train: DataFrame, per_language: int = 300, landmarks: int = 128, least_landmarks: int = 8, orders: tuple[int, ...] = (1, 2, 3), bits: int = 13, ridge: float = 0.01) -> LanguageModel | None:
    """A model from ``train(lang, text)``; None if it has no usable row."""
    some = bounded_sample(train.where("lang is not null and text is not null").select("lang", "text"), "lang", per_language)
    rows = some.mapInArrow(_packed(orders, bits), "lang string, bits binary").collect()  # per_language rows a language
    if not rows:
        return None
    rows.sort(key=lambda r: (bytes(r["bits"]), r["lang"]))
    languages = sorted({r["lang"] for r in rows})
    pick = np.random.default_rng(1).permutation(len(rows))
    by: dict[str, list[int]] = {k: [] for k in languages}
    for i in pick.tolist():
        by[rows[i]["lang"]].append(i)
    turn = sorted((n, k, i) for k in languages for n, i in enumerate(by[k]))[: max(landmarks, least_landmarks * len(languages))]
    model = LanguageModel(languages, _unpacked([rows[i] for _, _, i in turn], bits), np.zeros(0), orders, bits)
    values, vectors = np.linalg.eigh(model.kernel(model.landmarks).astype(np.float64))
    keep = values > 1e-6 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    at = {k: c for c, k in enumerate(languages)}
    y = np.array([at[r["lang"]] for r in rows])
    balance = (1 / np.bincount(y))[y]
    balance *= len(y) / balance.sum()
    width = whiten.shape[1] + 1
    left, right = np.zeros((width, width)), np.zeros((width, len(languages)))
    for a in range(0, len(rows), DOCS):
        z = np.hstack([model.kernel(_unpacked(rows[a : a + DOCS], bits)) @ whiten, np.ones((len(y[a : a + DOCS]), 1))])
        weighed = z * balance[a : a + DOCS, None]
        left += weighed.T @ z
        right += weighed.T @ np.where(y[a : a + DOCS, None] == np.arange(len(languages)), 1.0, -1.0)
    w = np.linalg.solve(left + ridge * len(y) * 0.01 * np.eye(width), right)
    model.weights = np.vstack([whiten @ w[:-1], w[-1:]]).astype(np.float32)
    return model


def _score(model: LanguageModel | None, n_kept: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offsets in column_blocks(batch, n_kept, DOCS):
                known = np.array([bool(_LETTER.search(buf[a:b].tobytes().decode("utf-8", "replace"))) for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
                lang, score = np.full(j - i, "und", dtype=object), np.zeros(j - i)
                if model is not None:
                    s = model.kernel(presence(buf, offsets, model.orders, model.bits)) @ model.weights[:-1] + model.weights[-1]
                    best = s.argmax(axis=1)
                    lang[known] = np.array(model.languages, dtype=object)[best][known]
                    score[known] = np.clip((s[np.arange(len(s)), best] + 1) / 2, 0, 1)[known]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(n_kept)), pa.array(lang, pa.string()), pa.array(score.astype(np.float64))], [*batch.schema.names[:n_kept], "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: LanguageModel | None, keep: list[str]) -> DataFrame:
    """The ``keep`` columns, lang_pred and score of each row of ``docs``."""
    rows, ddl = carried(docs, keep)
    return named(rows.mapInArrow(_score(model, len(keep)), f"{ddl}, lang_pred string, score double"), keep)
