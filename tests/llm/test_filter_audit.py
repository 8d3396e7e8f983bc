"""The filter audit against its definition, document by document and order by order."""

import collections
import itertools
import random
import re

from pyspark.sql import functions as F

from tracelens.llm import filter_audit as fa
from tracelens.llm.filter_audit import COUNTS, audit_filters, contract, orders

DOCUMENTS = "doc_id long, text string, lang string, mask string, good int"
LABELS = "doc_id long, quality int, toxic int"


def brute(documents, labels):
    smallest = {}
    for doc, text, _ in documents:
        if doc is not None:
            smallest[text or ""] = min(doc, smallest.get(text or "", doc))
    parts = collections.defaultdict(list)
    for doc, text, lang in documents:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": doc is not None and smallest[text] < doc,
        }
        says = [any(d == doc and doc is not None and row[k] == 1 for d, *row in labels) for k in (0, 1)]
        parts[lang or ""].append((fails, *says))
    out = []
    for part, rows in parts.items():
        figures, totals = [], collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, x in enumerate(order, 1):
                earlier = order[: step - 1]
                here = [r for r in rows if r[0][x] and not any(r[0][y] for y in earlier)]
                failing = [r for r in rows if r[0][x]]
                kept = sum(not any(r[0][y] for y in order[:step]) for r in rows)
                unique = sum(r[0][x] and sum(r[0].values()) == 1 for r in rows)
                totals[x] += len(here)
                figures.append([part, order, step, kept, len(here), len(failing) - len(here), unique, sum(r[1] for r in here), sum(r[2] for r in here), x])
        out += [(*f[:-1], totals[f[-1]]) for f in figures]
    return sorted(out)


def fixture(draw):
    words = ["one", "Two", "THREE", "fo#ur", "fünf", "six\x0bseven", "acht nine", "$", "ABC"]
    texts = [None, "", " \n", "one " * 120, " ".join(f"w{k}" for k in range(130)), "É" * 50 + "A" * 5 + "b" * 40]
    texts += [" ".join(draw.choices(words, k=draw.randint(1, 150))) for _ in range(12)]
    texts += [" ".join(f"w{draw.randint(0, 400)}" for _ in range(draw.randint(80, 140))) for _ in range(12)]
    documents = [(k, draw.choice(texts), draw.choice(["en", "de", "", None])) for k in range(150)]
    documents += [(None, texts[4], "en"), (None, texts[4], "en"), (None, None, None), documents[3], documents[3], (7, texts[4], "fr"), (7, "one", "fr")]
    labels = [(draw.randint(0, 160), draw.choice([0, 1, None]), draw.choice([0, 1, None])) for _ in range(120)] + [(None, 1, 1)]
    return documents, labels


def test_audit_equals_the_definition(spark):
    documents, labels = fixture(random.Random(2))
    df = spark.createDataFrame([(*d, "clash", 1) for d in documents], DOCUMENTS).repartition(3)
    got = audit_filters(df, spark.createDataFrame(labels, LABELS), F.col("lang"))
    assert got.columns == ["part", "filter_order", "step", *COUNTS]
    assert sorted(map(tuple, got.collect())) == brute(documents, labels)


def test_empty_tables(spark):
    none, no_labels = spark.createDataFrame([], DOCUMENTS), spark.createDataFrame([], LABELS)
    assert audit_filters(none, no_labels, F.col("lang")).collect() == []
    one = spark.createDataFrame([(1, None, None, None, None)], DOCUMENTS)
    rows = audit_filters(one, no_labels, F.col("lang")).collect()
    assert len(rows) == 600 and {r.part for r in rows} == {""} and all(r.kept + r.removed <= 1 for r in rows)


def test_a_large_group_of_copies_is_one_document_kept(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"), F.lit("en").alias("lang"))
    rows = audit_filters(df, spark.createDataFrame([], LABELS), F.col("lang")).filter("filter_order = 'EABCD' and step = 1").collect()
    assert [(r.kept, r.removed) for r in rows] == [(1, 3999)]


def test_words_of_very_long_texts(monkeypatch):
    draw = random.Random(1)
    texts = [" ".join(f"w{draw.randint(0, n)}" for _ in range(n)).encode() for n in (50, 99, 100, 400, 3000)]
    short = [fa._own_faults(t) for t in texts]
    monkeypatch.setattr(fa, "LISTED", 10)
    assert [fa._own_faults(t) for t in texts] == short


def test_contraction_by_mask():
    draw = random.Random(3)
    import numpy as np

    counts = np.array([[draw.randint(0, 9) for _ in range(32)] for _ in range(3)])
    figures, k = contract(counts, orders()), 0
    bit = {x: 16 >> "ABCDE".index(x) for x in "ABCDE"}
    for order in orders():
        for step, x in enumerate(order):
            before = sum(bit[y] for y in order[:step])
            here = [m for m in range(32) if m & bit[x] and not m & before]
            assert figures["removed"][k] == counts[0, here].sum() and figures["toxic_lost"][k] == counts[2, here].sum()
            k += 1
