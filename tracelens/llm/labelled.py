"""Bounded samples of labelled documents for fitting, apart from those held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, held: Column, per_class: int) -> DataFrame:
    """doc_id, text, label (0 or 1) of at most ``per_class`` documents of either class, first by a hash of the id.

    Ids with both labels, or none, and held-out ids are left out; null texts are empty.  Ids are chosen from the labels alone, so
    that only the sample is joined with texts (its size is bounded by ``per_class``, so it may be broadcast).
    """
    votes = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held)
    sure = votes.groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("high")).filter("label = high").select("doc_id", "label")
    rank = F.xxhash64("doc_id", F.lit(11))
    chosen = None
    for value in (0, 1):
        part = sure.filter(F.col("label") == value).orderBy(rank, "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    return documents.join(F.broadcast(chosen), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "label")
