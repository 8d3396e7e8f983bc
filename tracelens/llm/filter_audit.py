"""Interactions of five document filters in every order, from contingency tensors.

One pass over the texts leaves four of the five failure bits and a digest of each document; the fifth (an earlier
document has the same text) comes from slim rows by digest.  What is left of a part is a 2 x 2 x 2 x 2 x 2 table of
counts, whatever the number of documents; every figure of every order and step is that tensor contracted with
"pass", "fail" or "all" along each axis.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

FILTERS = "ABCDE"
#: Limits of the filters: words, distinct words and capitals in hundredths, and marks. Fixed values.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 100, 80, 10, b"#$%&*|"
_CAPITALS, _INNER_BYTES = bytes(range(65, 91)), bytes(range(0x80, 0xC0))
#: Bytes of a text beyond which its words are counted one by one instead of listed.
LISTED = 1 << 20
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _own_faults(text: bytes) -> int:
    """Bits 16, 8, 4 and 2 for the failures A to D of one text, in UTF-8."""
    if len(text) <= LISTED:  # bytes.split() takes the same six blanks as the word rule
        words = text.split()
        n, distinct = len(words), len(set(words))
    else:
        n, seen = 0, set()
        for m in _WORD.finditer(text):
            n += 1
            seen.add(m.group())
        distinct = len(seen)
    capitals, points = len(text) - len(text.translate(None, _CAPITALS)), len(text.translate(None, _INNER_BYTES))
    marked = len(text.translate(None, MARKS)) < len(text)
    return 16 * (n < LEAST_WORDS) + 8 * (100 * distinct < LEAST_DISTINCT * n) + 4 * (100 * capitals > MOST_CAPITALS * points) + 2 * marked


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
        masks = pa.array([_own_faults(t) for t in texts], pa.int32())
        digests = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), masks, digests], ["doc_id", "part", "mask", "digest"])


def fault_counts(documents: DataFrame, labels: DataFrame, part: Column) -> DataFrame:
    """(part, mask, n, n_good, n_toxic): documents by part and set of failing filters (A is bit 16, E bit 1).

    Equal texts are found by SHA-256.  A document with no doc_id has no smaller doc_id and is none for others; a repeated
    doc_id is as many documents; a document is good or toxic if any label row of its id says so.
    """
    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(part.cast("string"), F.lit("")).alias("part"), "text")
    # parted before the pass over the texts, so that each text is read once; the scan skips files without null ids by their statistics
    facts = lambda which: slim.filter(which).mapInArrow(_facts, "doc_id long, part string, mask int, digest binary")
    says = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    votes = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    told = facts("doc_id is not null").join(votes, "doc_id", "left").fillna(False, ["good", "toxic"])
    lone = facts("doc_id is null").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    # each aggregate shrinks a group of copies on the map side, so that the window sees a row for each kind of copy and not each copy
    kinds = ["digest", "part", "mask", "good", "toxic"]
    rows = told.unionByName(lone).groupBy("doc_id", *kinds).agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    copies = rows.groupBy(*kinds).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))).alias("n_lone"), first.alias("first"))
    copies = copies.withColumn("leads", F.col("first.doc_id") == F.min("first.doc_id").over(Window.partitionBy("digest")))
    passing = F.coalesce("n_lone", F.lit(0)) + F.coalesce(F.when(F.col("leads"), F.col("first.n")), F.lit(0))
    both = copies.select("part", "mask", "good", "toxic", F.explode(F.array(F.struct(F.lit(0).alias("e"), passing.alias("n")), F.struct(F.lit(1).alias("e"), (F.col("n") - passing).alias("n")))).alias("x"))
    n, of = F.col("x.n"), lambda c: F.sum(F.when(F.col(c), F.col("x.n")).otherwise(0))
    return both.groupBy("part", (F.col("mask") + F.col("x.e")).alias("mask")).agg(F.sum(n).alias("n"), of("good").alias("n_good"), of("toxic").alias("n_toxic"))


def orders() -> list[str]:
    return ["".join(p) for p in permutations(FILTERS)]


def _selections(given: list[str]) -> dict[str, list[np.ndarray]]:
    """For each kind of figure, one (rows, 2) array of weights on (pass, fail) for each axis; rows are orders x steps."""
    ok, fails, any_ = (1, 0), (0, 1), (1, 1)
    chosen = lambda f: [np.array([f(o, s, o.index(x)) for o in given for s in range(5)], np.int64) for x in FILTERS]
    return {
        "kept": chosen(lambda o, s, at: ok if at <= s else any_),
        "removed": chosen(lambda o, s, at: ok if at < s else fails if at == s else any_),
        "failing": chosen(lambda o, s, at: fails if at == s else any_),
        "unique": chosen(lambda o, s, at: fails if at == s else ok),
    }


def contract(counts: np.ndarray, given: list[str]) -> dict[str, np.ndarray]:
    """``counts`` (3 x 32: all, good, toxic by mask) as figures for each order and step, orders outermost."""
    tensors = counts.reshape(3, 2, 2, 2, 2, 2)
    of = {k: np.einsum("kabcde,ra,rb,rc,rd,re->kr", tensors, *v) for k, v in _selections(given).items()}
    removed, letter = of["removed"][0], np.array([FILTERS.index(x) for o in given for x in o])
    shapley = np.zeros(5, np.int64)
    np.add.at(shapley, letter, removed)
    return dict(zip(COUNTS, (of["kept"][0], removed, of["failing"][0] - removed, of["unique"][0], of["removed"][1], of["removed"][2], shapley[letter]), strict=True))


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    given = orders()
    order, step = [o for o in given for _ in range(5)], [s for _ in given for s in range(1, 6)]
    for batch in batches:
        for part, cells in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist(), strict=True):
            counts = np.zeros((3, 32), np.int64)
            for c in cells:
                counts[:, c["mask"]] = c["n"], c["n_good"], c["n_toxic"]
            figures = contract(counts, given)
            arrays = [pa.array([part] * len(order)), pa.array(order), pa.array(step, pa.int32()), *(pa.array(figures[c]) for c in COUNTS)]
            yield pa.RecordBatch.from_arrays(arrays, ["part", "filter_order", "step", *COUNTS])


def audit_filters(documents: DataFrame, labels: DataFrame, part: Column) -> DataFrame:
    """One row for each part, order of the five filters and step: documents kept, removed, failing but gone before, failing
    this filter alone, good and toxic ones removed, and the filter's removals summed over all orders.

    Filters: A under 100 words, B under 80 % distinct words, C over 10 % capitals, D a mark of ``MARKS``, E the text of a smaller
    doc_id.  Null texts are empty, null parts the empty string; an empty table gives no rows; very long texts are read word by
    word; other columns are not read.  A part is 32 cells at most, however many documents it has.
    """
    cells = fault_counts(documents, labels, part).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "n_good", "n_toxic")).alias("cells"))
    return cells.mapInArrow(_audits, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))
