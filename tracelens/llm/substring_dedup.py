"""Substring deduplication: words covered by windows that also start in an earlier document are removed.

Windows of ``window`` words are grouped by their minimiser, the smallest hash of the ``seed``-word runs inside.
Equal windows have equal minimisers, and neighbouring windows mostly share theirs: such a super-k-mer is one row, with a hash
of its words. Rows are judged without their words, and every minimiser alike, however many rows it has:

1.  A minimiser of one document has no repeated window.
2.  Of equal super-k-mers all windows repeat, except in the smallest of their documents. So only that document's can still
    be open, and only where different super-k-mers have the minimiser.
3.  Open windows are cut once more, by minimisers of almost their own length, and judged in the same way; what is open then
    is judged window by window.

Only documents with repeated or open windows move with their texts. Runs of words are compared by 64-bit hashes, among those
with one minimiser: exact up to their collisions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracelens.llm.words import batches_of_words, grams, run_hashes
from tracelens.session import materialise

WINDOW, SEED = 50, 8
#: Windows of one super-k-mer at most.
LONGEST = 256
#: Not read: no number of super-k-mers changes how a minimiser is treated. The name stays for callers that set it.
HOT = 1_000


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    step = 1
    while 2 * step <= width:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    rest = width - step
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def super_kmers(hashes: np.ndarray, first: np.ndarray, window: int, seed: int, among: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(minimiser, document, first window's word in the document, windows) of each run of windows with one minimiser.

    ``among`` tells for each word whether the window that starts there counts; without it, all do.
    """
    empty = np.zeros(0, np.int64)
    if len(hashes) < window:
        return empty, empty, empty, empty
    least = _smallest(grams(hashes, seed), window - seed + 1)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    whole = doc[: len(least)] == doc[window - 1 :]
    at = np.flatnonzero(whole if among is None else whole & among[: len(least)])
    if not len(at):
        return empty, empty, empty, empty
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (least[at[1:]] != least[at[:-1]]) | (doc[at[1:]] != doc[at[:-1]])
    begins = np.flatnonzero(new)
    size = np.diff(np.append(begins, len(at)))
    pieces = -(-size // LONGEST)
    within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = np.repeat(begins, pieces) + within * LONGEST
    count = np.minimum(np.repeat(size, pieces) - within * LONGEST, LONGEST)
    place = at[begin]
    return least[place].view(np.int64), doc[place], place - first[doc[place]], count


_RUNS = "key long, digest long, doc_id long, start int, n int"


def _runs(batches: Iterator[pa.RecordBatch], window: int, seed: int, again: bool = False) -> Iterator[pa.RecordBatch]:
    """Super-k-mers of all windows; ``again``: of the windows of ``runs`` only, with the hashes of their windows packed."""
    for batch in batches:
        ids = batch.column("doc_id").to_numpy()
        for low, high, words in batches_of_words(batch.column("text")):
            among = _among(words.first, batch.column("runs").slice(low, high - low).to_pylist(), len(words.hashes)) if again else None
            key, doc, start, count = super_kmers(words.hashes, words.first, window, seed, among)
            place = words.first[doc] + start
            digest = run_hashes(words.hashes, place, place + count + window - 1).view(np.int64)
            columns = [pa.array(key), pa.array(digest), pa.array(ids[low + doc]), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32))]
            if again:
                every = grams(words.hashes, window)
                bounds = np.concatenate([[0], np.cumsum(count)])
                each = np.repeat(place - bounds[:-1], count) + np.arange(bounds[-1])
                columns.append(pa.Array.from_buffers(pa.binary(), len(key), [None, pa.py_buffer((8 * bounds).astype(np.int32)), pa.py_buffer(every[each])]))
            yield pa.RecordBatch.from_arrays(columns, ["key", "digest", "doc_id", "start", "n"] + ["windows"] * again)


def _among(first: np.ndarray, runs: list[list[dict]], n_words: int) -> np.ndarray:
    """Whether a window of ``runs`` (one list a document) starts at each word."""
    change = np.zeros(n_words + 1, np.int64)
    for begin, end, own in zip(first[:-1], first[1:], runs, strict=True):
        for r in own:
            change[min(begin + r["start"], end)] += 1
            change[min(begin + r["start"] + r["n"], end)] -= 1
    return np.cumsum(change[:-1]) > 0


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of super-k-mers; equal ones that follow each other are one row."""
    for batch in batches:
        count = batch.column("n").to_numpy().astype(np.int64)
        digest = np.frombuffer(b"".join(batch.column("windows").to_pylist()), np.int64)
        row = np.repeat(np.arange(len(count)), count)
        within = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (digest[1:] != digest[:-1])
        at = np.flatnonzero(new)
        n = np.diff(np.append(at, len(row)))
        key, doc, start = (batch.column(c).to_numpy()[row[at]] for c in ("key", "doc_id", "start"))
        columns = [pa.array(key), pa.array(digest[at]), pa.array(doc), pa.array((start + within[at]).astype(np.int32)), pa.array(n.astype(np.int32))]
        yield pa.RecordBatch.from_arrays(columns, ["key", "digest", "doc_id", "start", "n"])


def _judged(runs: DataFrame) -> DataFrame:
    """The written ``runs`` with repeated windows, ``hit``, and those that may have some, not ``hit``; the others have none.

    Tables are written before they are joined, so that no side of a join is an aggregate and a hot key can be split.
    """
    shared = runs.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("key")
    runs = materialise(runs.join(materialise(shared), "key"))
    strings = materialise(runs.groupBy("key", "digest").agg(F.min("doc_id").alias("low")))
    several = strings.groupBy("key").agg(F.min("low").alias("least"), F.max("low").alias("most")).filter("least < most").select("key", F.lit(True).alias("several"))
    known = runs.join(strings.join(materialise(several), "key", "left"), ["key", "digest"])
    return materialise(known.withColumn("hit", F.col("doc_id") > F.col("low")).filter("hit or several").drop("low", "several"))


def kept_words(text: str | None, hits: list[dict] | None, window: int) -> tuple[int, int, bytes]:
    """Number of words, number of removed words, and the kept ones joined by a blank."""
    words = (text or "").encode().split()
    if not hits:
        return len(words), 0, b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for h in hits:
        change[h["start"]] += 1
        change[h["start"] + h["n"] + window - 1] -= 1
    keep = np.cumsum(change[:-1]) == 0
    kept = [words[i] for i in np.flatnonzero(keep)]
    return len(words), len(words) - len(kept), b" ".join(kept)


def _told(batches: Iterator[pa.RecordBatch], window: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hits = batch.column("hits").to_pylist() if "hits" in batch.schema.names else [None] * batch.num_rows
        out = [kept_words(t, h, window) for t, h in zip(batch.column("text").to_pylist(), hits, strict=True)]
        columns = [batch.column("doc_id"), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())]
        columns += [pa.array([hashlib.sha256(x[2]).hexdigest() for x in out], pa.string()), pa.array([x[2].decode() if with_text else None for x in out], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


_TOLD = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def repeated_windows(documents: DataFrame, window: int = WINDOW, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text, runs) of the documents that may have repeated windows, and (doc_id, start, n): runs of repeated windows.

    Both are written or cheap to read again; start counts words, n windows.
    """
    longer = window - (window - seed) // 6
    named = documents.filter("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    judged = _judged(materialise(named.mapInArrow(lambda b: _runs(b, window, seed), _RUNS)))
    by_doc = judged.groupBy("doc_id").agg(F.collect_set(F.struct("start", "n", "hit")).alias("runs"))
    moved = materialise(named.join(materialise(by_doc), "doc_id"))
    undecided = moved.withColumn("runs", F.filter("runs", lambda r: ~r["hit"])).filter(F.size("runs") > 0)
    closer = _judged(materialise(undecided.mapInArrow(lambda b: _runs(b, window, longer, again=True), _RUNS + ", windows binary")))
    windows = materialise(closer.filter("not hit").drop("digest", "hit").mapInArrow(_windows, _RUNS))
    least = windows.groupBy("key", "digest").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").drop("high")
    last = windows.join(materialise(least), ["key", "digest"]).filter("doc_id > low")
    found = [x.select("doc_id", "start", "n") for x in (judged.filter("hit"), closer.filter("hit"), last)]
    return moved, found[0].unionByName(found[1]).unionByName(found[2])


def deduplicate_substrings(documents: DataFrame, window: int = WINDOW, seed: int = SEED, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text (null unless ``with_text``) for every row of ``documents``.

    Words are runs of anything but ASCII white space; null texts have none.  Windows are judged on the input.  Rows with equal
    doc_id are one document that came several times and never remove each other's words; a row without doc_id keeps
    all its words and removes none.  Texts shorter than a window are kept.  Other columns are not read.
    """
    moved, found = repeated_windows(documents, window, seed)
    hits = materialise(found.groupBy("doc_id").agg(F.collect_set(F.struct("start", "n")).alias("hits")))
    changed = moved.select("doc_id", "text").join(hits, "doc_id").mapInArrow(lambda b: _told(b, window, with_text), _TOLD)
    whole = documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda b: _told(b, window, with_text), _TOLD)
    return whole.join(hits.select("doc_id"), "doc_id", "left_anti").unionByName(changed)
