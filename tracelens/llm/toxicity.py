"""Toxicity by subword bags: embeddings of hashed character n-grams, averaged into a linear softmax.

A word is the bag of its character n-grams, so an unseen misspelling shares most of its vectors with the
spelling that was seen.  A few toxic words would drown in the average over a long text; the
average is therefore taken over every run of ``RUN`` words and the text has its most toxic run's score, and
training follows the same rule (embeddings and softmax jointly, by adaptive gradient steps in numpy).

The embeddings and the softmax collapse into one weight for each n-gram bucket, so scoring needs one number for
each distinct word and a rolling mean.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

from tracelens.llm.labelled import labelled_sample

BUCKETS, WIDTH, RUN = 1 << 16, 8, 2
#: Documents of either class in the training sample.
SAMPLE_PER_CLASS = 1_200
#: Words whose logits a worker keeps.
KEPT_WORDS = 400_000
_WORD = re.compile(r"[^\W\d_]+")


def text_words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams (3 to 6) of each word with its ends marked, concatenated, and each word's first."""
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words), dtype=np.int32), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(codes))
    grams, owner = [], []
    h = np.full(len(codes), 0x9E3779B97F4A7C15, np.uint64)
    for n in range(6):
        h = (h[: len(codes) - n] ^ codes[n:]) * np.uint64(0x100000001B3)
        if n >= 2:
            whole = np.flatnonzero(left[: len(h)] > n)
            x = h[whole]
            grams.append(((x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int32) % BUCKETS)
            owner.append(word[whole])
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(grams)[order], np.searchsorted(owner[order], np.arange(len(words)))


def _runs(logits: np.ndarray, bounds: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean logit of the run of words that begins at each word (shorter at a text's end), and the run's length."""
    total = np.concatenate([[0.0], np.cumsum(logits)])
    at = np.arange(len(logits))
    end = np.minimum(at + run, np.repeat(bounds[1:], np.diff(bounds)))
    return (total[end] - total[at]) / np.maximum(end - at, 1), end - at


@dataclass
class ToxicityModel:
    """One weight for each n-gram bucket (embedding times softmax) and the bias."""

    weights: np.ndarray
    bias: float

    def word_logits(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        grams, first = word_grams(words)
        return np.add.reduceat(self.weights[grams], first) / np.diff(np.append(first, len(grams)))

    def scores(self, texts: list[str], known: dict[str, float]) -> np.ndarray:
        """Probability that a text is toxic; a text without words has the probability of the bias alone.

        ``known`` keeps the logits of words between calls.
        """
        logits = np.zeros(len(texts))
        low = 0
        while low < len(texts):
            high, total = low, 0
            while high < len(texts) and (high == low or total + len(texts[high]) <= 1 << 21):
                total += len(texts[high])
                high += 1
            words = [text_words(t) for t in texts[low:high]]
            if len(known) > KEPT_WORDS:
                known.clear()
            new = [w for w in set().union(*words) if w not in known]
            for at in range(0, len(new), 20_000):
                some = new[at : at + 20_000]
                known.update(zip(some, self.word_logits(some).tolist(), strict=True))
            bounds = np.concatenate([[0], np.cumsum([len(w) for w in words])])
            values = np.fromiter((known[w] for one in words for w in one), float, int(bounds[-1]))
            has = np.flatnonzero(np.diff(bounds))
            if len(has):
                logits[low + has] = np.maximum.reduceat(_runs(values, bounds, RUN)[0], bounds[has])
            low = high
        return 1 / (1 + np.exp(-np.clip(logits + self.bias, -30, 30)))


def _odds(flat: np.ndarray, bounds: np.ndarray, y: np.ndarray, words: int) -> np.ndarray:
    """Smoothed log odds of each word by the number of toxic and clean texts that have it."""
    pairs = np.unique(flat * len(y) + np.repeat(np.arange(len(y)), np.diff(bounds)))
    toxic = y[pairs % len(y)] == 1
    t, c = np.bincount(pairs[toxic] // len(y), minlength=words), np.bincount(pairs[~toxic] // len(y), minlength=words)
    return np.log((t + 0.5) / (c + 0.5)) - np.log((y.sum() + 1) / (len(y) - y.sum() + 1)) - 1 / np.sqrt(t + c + 0.5)


def train(texts: list[str], labels: list[int], steps: int = 60, rate: float = 0.3, seed: int = 5) -> ToxicityModel:
    """Fit embeddings and softmax jointly.

    Each step takes every text's most toxic run: by the words' log odds in the first half of the steps, so that
    the first choice is not chance, and then as the model itself has it.
    """
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        prior = float(np.clip(y.mean() if len(y) else 0.0, 0.01, 0.99))
        return ToxicityModel(np.zeros(BUCKETS), float(np.log(prior / (1 - prior))))
    vocabulary: dict[str, int] = {}
    ids, lengths = [], []
    for text in texts:
        words = text_words(text)
        ids.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words), np.int64, len(words)))
        lengths.append(len(words))
    has = np.array(lengths) > 0
    y, ids = y[has], [x for x, k in zip(ids, has, strict=True) if k]
    flat, bounds = np.concatenate(ids), np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    gram_flat, gram_start = word_grams(list(vocabulary))
    gram_size = np.diff(np.append(gram_start, len(gram_flat)))
    odds = _odds(flat, bounds, y, len(vocabulary))
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    soft = rng.normal(0, 0.5, (2, WIDTH)).astype(np.float32)
    bias, ge, gs, gb = 0.0, np.full(BUCKETS, 1e-6), np.full(soft.shape, 1e-6), 1e-6
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    for step in range(steps):
        collapsed = (embed @ (soft[1] - soft[0])).astype(np.float32)
        word_logit = np.add.reduceat(collapsed[gram_flat], gram_start) / gram_size
        mean, size = _runs(word_logit[flat], bounds, RUN)
        choice = mean if 2 * step >= steps else _runs(odds[flat], bounds, RUN)[0]
        first = np.flatnonzero(choice == np.repeat(np.maximum.reduceat(choice, bounds[:-1]), np.diff(bounds)))
        first = first[np.unique(np.repeat(np.arange(len(y)), np.diff(bounds))[first], return_index=True)[1]]
        error = (1 / (1 + np.exp(-np.clip(mean[first] + bias, -30, 30))) - y) * weight
        # gradient of each chosen run, spread over its words and their n-grams
        many = size[first]
        word = flat[np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
        g_word = np.bincount(word, np.repeat(error / many, many), minlength=len(vocabulary))
        used = np.flatnonzero(g_word)
        count = gram_size[used]
        at = np.repeat(gram_start[used], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        g_gram = np.bincount(gram_flat[at], np.repeat(g_word[used] / count, count), minlength=BUCKETS)
        touched = np.flatnonzero(g_gram)
        direction = soft[1] - soft[0]
        g_soft = (g_gram[touched, None] * embed[touched]).sum(0)
        ge[touched] += g_gram[touched] ** 2 * float(direction @ direction)
        embed[touched] -= (rate * g_gram[touched, None] * direction / np.sqrt(ge[touched])[:, None]).astype(np.float32)
        for row, sign in ((1, 1), (0, -1)):
            gs[row] += g_soft**2
            soft[row] -= (rate * 0.2 * sign * g_soft / np.sqrt(gs[row])).astype(np.float32)
        gb += error.sum() ** 2
        bias -= rate * error.sum() / np.sqrt(gb)
    return ToxicityModel((embed @ (soft[1] - soft[0])).astype(np.float64), float(bias))


def fit_toxicity(documents: DataFrame, labels: DataFrame, held, per_class: int = SAMPLE_PER_CLASS) -> ToxicityModel:
    """Train on a bounded sample of rows that are labelled and not held out; only their texts are read by the driver."""
    rows = labelled_sample(documents.select("doc_id", "text"), labels, "toxic", held, per_class).orderBy("doc_id").collect()
    return train([r["text"] for r in rows], [r["label"] for r in rows])


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def _scored(batches: Iterator[pa.RecordBatch], model: ToxicityModel) -> Iterator[pa.RecordBatch]:
    known: dict[str, float] = {}
    for batch in batches:
        yield batch.append_column("score", pa.array(model.scores(_texts(batch), known)))


def _below(batches: Iterator[pa.RecordBatch], model: ToxicityModel, threshold: float) -> Iterator[pa.RecordBatch]:
    known: dict[str, float] = {}
    for batch in batches:
        yield batch.filter(pa.array(model.scores(_texts(batch), known) < threshold))


def toxicity_scores(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id and score for every row; null, empty and wordless texts have the score of the bias; other columns are not read."""
    own = documents.select("doc_id", "text")
    schema = StructType([*own.schema.fields, StructField("score", DoubleType())])
    return own.mapInArrow(lambda b: _scored(b, model), schema).drop("text")


def without_toxic(documents: DataFrame, model: ToxicityModel, threshold: float) -> DataFrame:
    """The rows of ``documents``, with all their columns, whose score is below the threshold."""
    return documents.mapInArrow(lambda b: _below(b, model, threshold), documents.schema)
