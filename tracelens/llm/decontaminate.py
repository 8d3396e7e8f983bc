"""Benchmark decontamination by a prefix-filtered set join of item windows with whole documents.

An item's windows are all runs of ``window`` consecutive words.  A window can only occur where its
rarest shingle does, so that shingle alone is its necessary prefix: shingle frequencies are counted over
all documents, each window is filed under its rarest one, and documents are probed by their own
shingles.  The shingle's place in the window gives the one possible place in the document; windows that
would begin before the document or end after it are dropped by these positional and length bounds, and
the rest are compared word by word.

The index of the items is broadcast in blocks of at most ``BLOCK_WINDOWS`` windows; a larger benchmark
takes further passes over the documents, each written before the next.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tracelens.llm.words import ALNUM, batches_of_words, grams, words_of, text_buffer
from tracelens.session import materialise

WINDOW = 13
SHINGLE = 5
#: Windows in one broadcast block: some 200 bytes each.
BLOCK_WINDOWS = 250_000
_FILTER_BITS = 20


def _item_words(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Distinct windows of each item as the hashes of their words."""
    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        words = words_of(data, offsets, ALNUM, lower=True)
        names = batch.column("item").to_pylist()
        out = []
        for d, name in enumerate(names):
            h = words.hashes[words.first[d] : words.first[d + 1]]
            n = min(window, len(h))
            out += [(name, h[i : i + n].tobytes()) for i in range(len(h) - n + 1)] if n else []
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else ([], []), (pa.string(), pa.binary()), strict=True)], ["item", "words"])


class Members:
    """Membership of 64-bit values in a fixed set: a bit table first, then a sorted search."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.table = np.zeros(1 << _FILTER_BITS, bool)
        self.table[(self.values & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True

    def find(self, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the probes that are members, and which member each is."""
        if not len(self.values):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.table[(probes & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.values, probes[maybe]), len(self.values) - 1)
        hit = self.values[at] == probes[maybe]
        return maybe[hit], at[hit]


@dataclass
class Windows:
    """Windows of a block: hashes of their words, and the items that have each."""

    words: list[np.ndarray]
    items: list[list[str]]

    def shingles(self, size: int) -> list[np.ndarray]:
        return [grams(w, min(size, len(w))) for w in self.words]


def _count(batches: Iterator[pa.RecordBatch], members: dict[int, Members]) -> Iterator[pa.RecordBatch]:
    """Occurrences of the items' shingles in a task's documents."""
    total = {n: np.zeros(len(m.values), np.int64) for n, m in members.items()}
    for batch in batches:
        for _, _, words in batches_of_words(batch.column("text"), ALNUM, lower=True):
            for n, m in members.items():
                _, which = m.find(grams(words.hashes, n))
                total[n] += np.bincount(which, minlength=len(m.values))
    for n, m in members.items():
        has = np.flatnonzero(total[n])
        yield pa.RecordBatch.from_arrays([pa.array(m.values[has].view(np.int64)), pa.array(total[n][has])], ["shingle", "n"])


class Index:
    """Windows filed under their rarest shingle."""

    def __init__(self, windows: Windows, size: int, frequency: dict[int, int]):
        self.windows = windows
        self.by_length: dict[int, tuple[Members, list[list[tuple[int, int]]]]] = {}
        filed: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for w, shingles in enumerate(windows.shingles(size)):
            counts = [frequency.get(int(s), 0) for s in shingles.view(np.int64)]
            place = min(range(len(counts)), key=counts.__getitem__)
            filed.setdefault(min(size, len(windows.words[w])), {}).setdefault(int(shingles[place]), []).append((w, place))
        for n, by in filed.items():
            members = Members(np.array(list(by), np.uint64))
            flat = [by[int(v)] for v in members.values]
            sizes = np.array([len(x) for x in flat])
            pairs = np.array([p for x in flat for p in x], np.int64)
            self.by_length[n] = members, (np.concatenate([[0], np.cumsum(sizes)]), pairs)
        self.length = np.array([len(w) for w in windows.words], np.int64)
        self.padded = np.zeros((len(windows.words), int(self.length.max(initial=0))), np.uint64)
        for i, w in enumerate(windows.words):
            self.padded[i, : len(w)] = w

    def matches(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, first word, window) of each occurrence of a window."""
        found = []
        for n, (members, (bounds, pairs)) in self.by_length.items():
            at, which = members.find(grams(hashes, n))
            many = bounds[which + 1] - bounds[which]
            flat = np.repeat(bounds[which], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            window, place = pairs[flat].T if len(flat) else (flat, flat)
            start = np.repeat(at, many) - place
            doc = np.searchsorted(first, np.repeat(at, many), "right") - 1
            inside = (start >= first[doc]) & (start + self.length[window] <= first[doc + 1])
            start, doc, window = start[inside], doc[inside], window[inside]
            columns = np.arange(self.padded.shape[1])
            for low in range(0, len(start), 65_536):
                s, w = start[low : low + 65_536], window[low : low + 65_536]
                words = hashes[np.minimum(s[:, None] + columns, len(hashes) - 1)]
                same = ((words == self.padded[w]) | (columns >= self.length[w][:, None])).all(1)
                found.append((doc[low : low + 65_536][same], s[same], w[same]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_ADDED = "_words long, _spans array<struct<start: long, end: long>>, _items array<string>"


def _probe(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, all_spans, all_items = [], [], []
        for low, high, words in batches_of_words(batch.column("text"), ALNUM, lower=True):
            n_words += words.counts().tolist()
            spans: list[list] = [[] for _ in range(high - low)]
            items: list[set] = [set() for _ in range(high - low)]
            doc, start, window = index.matches(words.hashes, words.first)
            for d, s, w in zip(doc.tolist(), start.tolist(), window.tolist(), strict=True):
                s -= int(words.first[d])
                spans[d].append((s, s + int(index.length[w])))
                items[d].update(index.windows.items[w])
            all_spans += spans
            all_items += items
        if "_spans" in batch.schema.names:  # of earlier blocks
            for i, (old, names) in enumerate(zip(batch.column("_spans").to_pylist(), batch.column("_items").to_pylist(), strict=True)):
                all_spans[i] += [(x["start"], x["end"]) for x in old]
                all_items[i].update(names)
        columns = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in ("_words", "_spans", "_items")]
        names = [n for n in batch.schema.names if n not in ("_words", "_spans", "_items")]
        merged = [[{"start": s, "end": e} for s, e in _merged(x)] for x in all_spans]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(n_words, pa.int64()), pa.array(merged, SPANS), pa.array([sorted(x) for x in all_items], pa.list_(pa.string()))],
            [*names, "_words", "_spans", "_items"],
        )


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """``documents`` with _words (count), _spans (merged word spans of item windows) and _items (ids as text, sorted).

    Words are maximal runs of ASCII letters and digits and non-ASCII characters, A-Z in lower case; null texts have none.
    An item of fewer words than a window is one window, an item without words none; items with equal windows
    are all named; an item without id is named "".  Every row of ``documents`` comes back once with all its
    columns; a name among the added columns must not be among them.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    windows = materialise(items.mapInArrow(lambda b: _item_words(b, window), "item string, words binary").groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items")))
    blocks = max(1, -(-windows.count() // BLOCK_WINDOWS))
    for block in range(blocks):
        rows = windows.filter(F.pmod(F.xxhash64("words"), F.lit(blocks)) == block).collect()
        own = Windows([np.frombuffer(r["words"], np.uint64) for r in rows], [r["items"] for r in rows])
        shingles: dict[int, list[np.ndarray]] = {}
        for s, w in zip(own.shingles(shingle), own.words, strict=True):
            shingles.setdefault(min(shingle, len(w)), []).append(s)
        members = {n: Members(np.concatenate(s)) for n, s in shingles.items()}
        counted = documents.select("text").mapInArrow(lambda b, m=members: _count(b, m), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
        index = Index(own, shingle, {r["shingle"]: r["n"] for r in counted.collect()})
        columns = [f"`{n}` {t}" for n, t in documents.dtypes if n not in ("_words", "_spans", "_items")]
        documents = documents.mapInArrow(lambda b, i=index: _probe(b, i), ", ".join(columns) + ", " + _ADDED)
        if block + 1 < blocks:
            documents = materialise(documents)
    return documents


def hit_words(spans: str = "_spans") -> Column:
    """How many words the merged spans cover."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda total, x: total + x["end"] - x["start"])


def is_contaminated(hits: Column, words: Column) -> Column:
    """A twentieth of the words, and one at least, lie in item windows."""
    return (hits > 0) & (hits * 20 >= words)
