"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies.

Words are in lower case, shingles are pairs of neighbouring words.  A template of L words meets a text in
windows of L words, one at every word, so that a copy of it fills one window whole.  Windows and templates are hashed
by BANDS functions, one row a band, and those that agree in a band are candidates; a candidate counts
if the window has at least ``least`` of the template's distinct pairs.  A window with containment c has a
Jaccard similarity of c / (2 - c) at least, so it is retrieved with probability 1 - (1 - c / (2 - c)) ** BANDS:
0.9998 for c = 0.8 and 8 bands, and 1 for a whole copy.

A window can only have that share of a template's pairs if it has one of any 1 + floor((1 - least) * pairs) of them.
The longest ones are the template's anchors: only windows around an anchor are hashed, in texts that hold one.
All of it is built-in functions; templates are broadcast, and their number is checked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Bands of one row each, and the share of a template's pairs that a window must contain.
BANDS, LEAST = 8, 0.8
MOST_TEMPLATES = 10_000
#: License statements by short name. Common wordings of public license notices.
STATEMENTS = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("mit", "Released under the MIT License."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]


def license_words(text: Column) -> Column:
    """Lower-case words: runs of letters, digits, dots inside numbers and hyphens."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+(?:-\p{L}+)*|\d+(?:\.\d+)*"), 0)


def _pairs(words: Column) -> Column:
    """Each word with its successor."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)))


def _bands(pairs: Column, bands: int) -> Column:
    """The smallest hash of the pairs under each function, with the function's number."""

    def band(number: int) -> Column:
        return F.struct(F.lit(number).alias("band"), F.array_min(F.transform(pairs, lambda p: F.xxhash64(p, F.lit(number)))).alias("least_hash"))

    return F.array(*map(band, range(bands)))


def _starts(at: Column, length: int) -> Column:
    """Windows of one length that hold the pair at a position."""
    first = F.greatest(at - length + 2, F.lit(0))
    return F.transform(F.sequence(first, at), lambda s: F.struct(s.alias("start"), F.lit(length).alias("length")))


def _templates(documents: DataFrame, statements: Sequence[tuple[str, str]], least: float) -> DataFrame:
    if len(statements) > MOST_TEMPLATES:
        raise ValueError("scan in several passes: the templates are broadcast")
    words = documents.sparkSession.createDataFrame(list(statements), "license string, statement string").withColumn("words", license_words(F.col("statement")))
    pairs = words.filter(F.size("words") > 1).withColumn("pairs", F.array_distinct(_pairs(F.col("words"))))
    by_length = F.array_sort(F.transform("pairs", lambda p: F.struct((-F.length(p)).alias("n"), p.alias("pair"))))
    spare = F.floor(F.size("pairs") * F.lit(1 - least) + F.lit(1e-9)).cast("int") + 1
    return pairs.select("license", F.size("words").alias("length"), "pairs", F.transform(F.slice(by_length, F.lit(1), spare), lambda x: x["pair"]).alias("anchors"))


def scan_licenses(documents: DataFrame, statements: Sequence[tuple[str, str]] = STATEMENTS, least: float = LEAST, bands: int = BANDS) -> DataFrame:
    """doc_id, license, first_word (of the first window), n_windows, n_pairs (most found), of_pairs: a row for each license that a document has.

    Null and empty texts have none; rows with equal doc_id count as one document, null among them; windows of repeated rows
    count once; an empty table gives no rows; columns other than doc_id and text are not read.
    """
    templates = _templates(documents, statements, least)
    rows = templates.collect()  # at most MOST_TEMPLATES
    anchors = sorted({a for r in rows for a in r["anchors"]})
    lengths = sorted({r["length"] for r in rows})
    quoted = ["[^\\p{L}\\d]*".join(w.replace(".", "\\.") for w in a.split(" ")) for a in anchors]
    spoken = documents.select("doc_id", "text").filter(F.lower("text").rlike("|".join(quoted) or "(?!)"))
    words = spoken.select("doc_id", license_words(F.col("text")).alias("words")).filter(F.size("words") > 1).withColumn("pairs", _pairs(F.col("words")))
    wanted = F.array(*[F.lit(a) for a in anchors])
    at = F.filter(F.transform("pairs", lambda p, i: F.when(F.array_contains(wanted, p), i)), lambda i: i.isNotNull())
    starts = F.array_distinct(F.flatten(F.transform(at, lambda i: F.flatten(F.array(*[_starts(i, n) for n in lengths])))))
    windows = (
        words.withColumn("window", F.explode(starts)).filter(F.col("window.start") + F.col("window.length") <= F.size("words"))
        .select("doc_id", "window.start", "window.length", F.slice("pairs", F.col("window.start") + 1, F.col("window.length") - 1).alias("own"))
    )
    hashed = windows.withColumn("key", F.explode(_bands(F.col("own"), bands))).select("doc_id", "start", "length", "own", "key.*")
    filed = templates.withColumn("key", F.explode(_bands(F.col("pairs"), bands))).select("license", "length", "pairs", "key.*")
    found = F.size(F.array_intersect("own", "pairs"))
    matches = (
        hashed.join(F.broadcast(filed), ["length", "band", "least_hash"])
        .withColumns({"n_pairs": found.cast("long"), "of_pairs": F.size("pairs").cast("long")}).filter(F.col("n_pairs") >= F.lit(least) * F.col("of_pairs"))
        .select("doc_id", "license", F.col("start").cast("long").alias("start"), "n_pairs", "of_pairs").distinct()
    )
    return matches.groupBy("doc_id", "license").agg(
        F.min("start").alias("first_word"), F.countDistinct("start").alias("n_windows"), F.max("n_pairs").alias("n_pairs"), F.max("of_pairs").alias("of_pairs")
    )
