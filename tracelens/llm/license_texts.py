"""Scans for license notices and whole license texts, with the template set of this module and tolerant windows.

``license_scan`` answers for one-sentence statements in windows of exactly their length, as its SQL says. Here
templates are the notices below and the whole texts in ``licenses``, cut into passages of PASSAGE words, one at every
STEP words. A window is SLACK words longer than its template, begins with words of it, and may be cut off by the
text's end. A window counts

* for a template of up to SHORT words: if it begins with the template, whole or with one inserted word;
* for a longer one: if it has at least ``least`` of the template's distinct pairs; for a notice also all its numbers and
  names, and no qualifier (Affero, Lesser) that the notice hasn't.

Retrieval is by MinHash bands as in ``license_scan``; shingles of short templates are words, as an inserted word breaks a pair.
All of it is built-in functions; templates are broadcast.
"""

from __future__ import annotations

from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, Row, functions as F

from tracelens.llm.license_scan import BANDS, LEAST, MOST_TEMPLATES, STATEMENTS, _bands, _pairs, license_words

PASSAGE, STEP, SLACK, SHORT = 40, 20, 2, 5
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_CC = "This work is licensed under a Creative Commons {} 4.0 International License."
NOTICES = [
    *STATEMENTS,
    ("all-rights-reserved", "All rights reserved."),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("mit", "Licensed under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("isc", "Licensed under the ISC License."),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("gpl-2.0", _GNU.format("General Public License", "2")), ("gpl-3.0", _GNU.format("General Public License", "3")),
    ("lgpl-2.1", _GNU.format("Lesser General Public License", "2.1")), ("lgpl-3.0", _GNU.format("Lesser General Public License", "3")),
    ("agpl-3.0", _GNU.format("Affero General Public License", "3")),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    *[(f"cc-by{code}-4.0", _CC.format(f"Attribution{name}")) for code, name in (("-sa", "-ShareAlike"), ("-nd", "-NoDerivatives"), ("-nc", "-NonCommercial"), ("-nc-sa", "-NonCommercial-ShareAlike"), ("-nc-nd", "-NonCommercial-NoDerivatives"))],
    *[(f"cc-{code.lower()}-4.0", f"Licensed under CC {code} 4.0.") for code in ("BY", "BY-SA", "BY-ND", "BY-NC-SA", "BY-NC-ND")],
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0."),
]
QUALIFIERS = {"affero", "lesser", "library"}
_NAMES = {"apache", "mit", "isc", "bsd", "bsd-style", "gnu", "mozilla", "eclipse", "boost", "attribution", *QUALIFIERS}


def license_texts() -> list[tuple[str, str]]:
    """The whole license texts by short name, as the files beside this module hold them."""
    return [(p.stem, p.read_text()) for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))]


def _cut(words: list[str]) -> list[list[str]]:
    """Overlapping passages that cover all words."""
    if len(words) <= PASSAGE:
        return [words]
    return [words[s : s + PASSAGE] for s in [*range(0, len(words) - PASSAGE, STEP), len(words) - PASSAGE]]


def _template(at: int, license_name: str, words: list[str], notice: bool, least: float) -> Row:
    pairs = list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))
    short = len(words) <= SHORT
    spare = 2 if short else int(len(pairs) * (1 - least) + 1e-9) + 1
    must = sorted({w for w in words if w[0].isdigit() or w in _NAMES or w.startswith("attribution-")}) if notice else []
    no = sorted(QUALIFIERS - set(words)) if notice else []
    shingles = list(dict.fromkeys(words)) if short else pairs
    return Row(template=at, license=license_name, length=len(words) + SLACK, short=short, words=words, pairs=pairs, shingles=shingles, must=must, no=no, anchors=sorted(pairs, key=lambda p: (-len(p), p))[:spare])


def _templates(documents: DataFrame, notices: list[tuple[str, str]], texts: list[tuple[str, str]], least: float) -> list[Row]:
    given = documents.sparkSession.createDataFrame([(k, n, s, k < len(notices)) for k, (n, s) in enumerate([*notices, *texts])], "k int, license string, statement string, notice boolean")
    out: list[Row] = []
    for r in sorted(given.withColumn("words", license_words(F.col("statement"))).collect(), key=lambda r: r["k"]):
        for words in [r["words"]] if r["notice"] else _cut(r["words"]):
            out.append(_template(len(out), r["license"], words, r["notice"], least))
    if len(out) > MOST_TEMPLATES:
        raise ValueError("scan in several passes: the templates are broadcast")
    return out


def scan_license_texts(documents: DataFrame, notices: list[tuple[str, str]] = NOTICES, texts: list[tuple[str, str]] | None = None, least: float = LEAST, bands: int = BANDS) -> DataFrame:
    """doc_id, license, first_word, n_templates, of_templates, n_pairs, of_pairs: a row for each license of which a document has a notice or a passage.

    ``n_templates`` of the license's ``of_templates`` notices and passages were found; ``n_pairs`` of ``of_pairs`` is the best of them.
    Null and empty texts have none; rows with equal doc_id count as one document, null among them.
    """
    rows = _templates(documents, list(notices), license_texts() if texts is None else list(texts), least)
    lengths = sorted({(a, r["length"]) for r in rows for a in r["anchors"]})
    around = max(r["length"] for r in rows)
    anchors = F.broadcast(documents.sparkSession.createDataFrame(lengths, "anchor string, length int"))
    words = documents.select("doc_id", license_words(F.col("text")).alias("words")).filter(F.size("words") > 1)
    skipped = F.greatest(F.col("at") - around, F.lit(0))
    met = (
        words.select("doc_id", "words", F.posexplode(_pairs(F.col("words"))).alias("at", "anchor")).join(anchors, "anchor")
        .select("doc_id", "at", "length", skipped.alias("skipped"), F.slice("words", skipped + 1, 2 * around + 2).alias("near"))
    )
    first = F.greatest(F.col("at") - F.col("skipped") - F.col("length") + 2, F.lit(0))
    windows = (
        met.withColumn("from", F.explode(F.sequence(first, F.col("at") - F.col("skipped"))))
        .select("doc_id", (F.col("skipped") + F.col("from")).alias("start"), "length", F.slice("near", F.col("from") + 1, F.col("length")).alias("own_words"))
        .filter(F.size("own_words") > 1).withColumn("own", _pairs(F.col("own_words")))
    )
    is_short = F.col("length") <= SHORT + SLACK
    hashed = windows.withColumn("key", F.explode(_bands(F.when(is_short, F.col("own_words")).otherwise(F.col("own")), bands))).select("doc_id", "start", "length", "own", "own_words", "key.*")
    schema = "template int, license string, length int, short boolean, words array<string>, pairs array<string>, shingles array<string>, must array<string>, no array<string>, anchors array<string>"
    templates = documents.sparkSession.createDataFrame(rows, schema).drop("anchors")
    filed = templates.withColumn("key", F.explode(_bands(F.col("shingles"), bands))).drop("shingles").select("*", "key.*").drop("key")
    found, n = F.size(F.array_intersect("own", "pairs")), F.size("words")
    inserted = F.exists(F.sequence(F.lit(1), n - 1), lambda i: F.concat(F.slice("own_words", F.lit(1), i), F.slice("own_words", i + 2, n - i)) == F.col("words"))
    enough = F.when(F.col("short"), (F.slice("own_words", F.lit(1), n) == F.col("words")) | inserted).otherwise(
        (found >= F.lit(least) * F.size("pairs")) & F.array_contains("pairs", F.element_at("own", 1))
        & (F.size(F.array_except("must", "own_words")) == 0) & ~F.arrays_overlap("no", "own_words")
    )
    matches = (
        hashed.join(F.broadcast(filed), ["length", "band", "least_hash"]).filter(enough)
        .select("doc_id", "license", "template", F.col("start").cast("long").alias("start"), F.struct(found.cast("long").alias("n"), F.size("pairs").cast("long").alias("of")).alias("best"))
    )
    of: dict[str, int] = {}
    for r in rows:
        of[r["license"]] = of.get(r["license"], 0) + 1
    counts = reduce(lambda c, x: c.when(F.col("license") == x[0], x[1]), of.items(), F.when(F.lit(False), 0)).cast("long")
    share = F.struct((F.col("best.n") / F.col("best.of")).alias("share"), F.col("best.n"), F.col("best.of"))
    return matches.groupBy("doc_id", "license").agg(
        F.min("start").alias("first_word"), F.countDistinct("template").alias("n_templates"), F.max(share).alias("best")
    ).select("doc_id", "license", "first_word", "n_templates", counts.alias("of_templates"), F.col("best.n").alias("n_pairs"), F.col("best.of").alias("of_pairs"))
