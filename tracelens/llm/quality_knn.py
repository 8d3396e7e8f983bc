"""Quality by nearest-neighbour voting among labelled documents in a latent-semantic space.

A text becomes the square roots of its hashed byte-bigram frequencies and of its word-repetition, letter-case and
symbol terms.  The singular vectors of the sample's term matrix make the latent space.  The labelled latent vectors (their
number is a parameter, so their size is bounded) are broadcast; cosines of every document with all of them are exact
matrix products, block by block, and the nearest ones vote with their similarities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

from tracelens.llm.labelled import labelled_sample
from tracelens.llm.words import slices, text_buffer, words_of

#: Hash buckets of bigrams, and levels of each shape term.
BIGRAMS, LEVELS = 1 << 11, 16
LATENT, NEIGHBOURS = 48, 15
#: Labelled documents of either class that may vote.
SAMPLE_PER_CLASS = 2_000
#: Documents of one block of cosines.
BLOCK = 1_024
SHAPES = 7
TERMS = BIGRAMS + SHAPES * LEVELS
#: Weight of a shape term beside all bigrams.
SHAPE_WEIGHT = 0.5


def terms(column: pa.Array) -> np.ndarray:
    """The term vector of each text (null: empty), in single precision."""
    data, offsets = text_buffer(column)
    out = np.zeros((len(column), TERMS), np.float32)
    for low, high in slices(offsets, 1 << 20):
        at = offsets[low : high + 1] - offsets[low]
        part = data[offsets[low] : offsets[high]]
        words = words_of(part, at)
        for d in range(high - low):
            own = part[at[d] : at[d + 1]]
            row = out[low + d]
            if len(own) > 1:
                pairs = own[:-1].astype(np.int32) * 256 + own[1:]
                row[:BIGRAMS] = np.bincount((pairs * 40_503 >> 4) % BIGRAMS, minlength=BIGRAMS)
                row[:BIGRAMS] /= len(pairs)
            hashes = words.hashes[words.first[d] : words.first[d + 1]]
            for k, x in enumerate(_shapes(own, hashes)):
                # both neighbouring levels, so that close values have close terms
                place = min(max(x, 0.0), 1.0) * (LEVELS - 2)
                level = int(place)
                row[BIGRAMS + k * LEVELS + level] = SHAPE_WEIGHT * (1 - place + level)
                row[BIGRAMS + k * LEVELS + level + 1] = SHAPE_WEIGHT * (place - level)
    np.sqrt(out, out=out)
    return out


def _shapes(text: np.ndarray, words: np.ndarray) -> tuple[float, ...]:
    """Size, distinct words, repeats of the word before, capitals, digits, symbols and bytes to a word, each about 0 to 1."""
    n, w = max(len(text), 1), max(len(words), 1)
    kinds = np.bincount(text, minlength=256)
    capitals, digits = kinds[0x41:0x5B].sum(), kinds[0x30:0x3A].sum()
    letters = capitals + kinds[0x61:0x7B].sum() + kinds[0x80:].sum()
    blanks = kinds[0x20] + kinds[0x09:0x0E].sum()
    distinct = len(np.unique(words)) / w if len(words) else 0.0
    again = float((words[1:] == words[:-1]).mean()) if len(words) > 1 else 0.0
    return (np.log1p(len(words)) / 12, distinct, again, capitals / max(letters, 1), 4 * digits / n, 4 * (n - letters - digits - blanks) / n if len(text) else 0.0, n / w / 24)


@dataclass
class QualityModel:
    """The mean and latent axes of the sample's terms, and the labelled latent unit vectors."""

    mean: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def latent(self, x: np.ndarray) -> np.ndarray:
        out = (x - self.mean) @ self.axes
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def scores(self, column: pa.Array) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest labelled vectors, ties by their order in the sample."""
        out = np.full(len(column), self.prior)
        k = min(NEIGHBOURS, len(self.labels))
        for low in range(0, len(column) if k else 0, BLOCK):
            cosines = self.latent(terms(column.slice(low, BLOCK))) @ self.vectors.T
            near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosines, near, 1), 1e-6).astype(np.float64) ** 4
            out[low : low + BLOCK] = (weight * self.labels[near]).sum(1) / weight.sum(1)
        return np.clip(out, 0.0, 1.0)


def train(texts: list[str], labels: list[int]) -> QualityModel:
    x, y = terms(pa.array(texts, pa.string())), np.array(labels, np.float64)
    if not len(y):
        return QualityModel(np.zeros(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), y, 0.5)
    mean = x.mean(0)
    centred = x - mean
    values, axes = np.linalg.eigh((centred.T @ centred).astype(np.float64))
    model = QualityModel(mean, axes[:, ::-1][:, :LATENT].astype(np.float32), np.zeros((0, 1), np.float32), y, float(y.mean()))
    model.vectors = model.latent(x)
    return model


def fit_quality(documents: DataFrame, labels: DataFrame, held: Column, per_class: int = SAMPLE_PER_CLASS) -> QualityModel:
    """Learn from a bounded sample of rows that are labelled and not held out."""
    rows = labelled_sample(documents.select("doc_id", "text"), labels, "quality", held, per_class).orderBy("doc_id").collect()
    return train([r["text"] for r in rows], [r["label"] for r in rows])


def _scored(batches: Iterator[pa.RecordBatch], model: QualityModel) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.append_column("score", pa.array(model.scores(batch.column("text"))))


def quality_scores(documents: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id and score (0 to 1) for every row; null texts are empty and have a score too; other columns are not read."""
    own = documents.select("doc_id", "text")
    schema = StructType([*own.schema.fields, StructField("score", DoubleType())])
    return own.mapInArrow(lambda b: _scored(b, model), schema).drop("text")
