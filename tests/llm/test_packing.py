"""Packing against a best fit that looks at every open window, and over repeated rows."""

import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from tracelens.llm import packing
from tracelens.llm.packing import best_fit, pack_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain_best_fit(lengths, window):
    rooms, out = [], []
    for n in lengths:
        fits = [(room, k) for k, room in enumerate(rooms) if room >= n]
        if fits:
            room, k = min(fits)
        else:
            rooms.append(window)
            room, k = window, len(rooms) - 1
        out.append((k, window - room))
        rooms[k] -= n
    return out


def test_the_tree_finds_the_tightest_window():
    draw = random.Random(4)
    for window in (16, 100, 1024):
        for _ in range(30):
            lengths = sorted((draw.randint(1, window) for _ in range(draw.randint(1, 200))), reverse=True)
            where, offset = best_fit(np.array(lengths), window)
            want = plain_best_fit(lengths, window)
            assert where.max() == max(k for k, _ in want)  # ties of equal room may go to either window
            # the rooms that are left, and so every later choice, are the same
            left = lambda places: sorted(sum(n for n, (k, _) in zip(lengths, places) if k == s) for s in range(int(where.max()) + 1))
            assert left(want) == left(list(zip(where.tolist(), offset.tolist())))


def places(rows, window):
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in used.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= window
    return used


def test_repeated_rows_spread_like_others(spark):
    words = " ".join(f"w{k}" for k in range(40))
    hot = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(words).alias("text"))
    rows = pack_documents(hot.repartition(4), PATH, with_ids=False).select("sequence_id", "offset", "length").collect()
    used = places(rows, packing.WINDOW)
    assert len(rows) == 20_000
    tokens = sum(r.length for r in rows)
    assert len(used) * packing.WINDOW <= tokens * 1.25  # equal pieces of over 40 ids leave a rest in every window
    nothing = spark.range(9_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    used = places(pack_documents(nothing.repartition(2), PATH, with_ids=False).collect(), packing.WINDOW)
    assert sum(map(len, used.values())) == 9_000 and len(used) <= 12


def test_blocks_and_partitions_number_their_own_sequences(spark):
    draw = random.Random(5)
    texts = [(k, " ".join(draw.choices(["alpha", "beta", "Ünï", "x"], k=draw.randint(0, 3000)))) for k in range(300)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    rows = pack_documents(df, PATH).collect()
    places(rows, packing.WINDOW)
    own = {}
    for r in rows:
        own.setdefault(r.doc_id, []).append((r.start, r.ids))
    encoder = packing.TextIds(PATH)
    for k, text in texts:
        assert b"".join(ids for _, ids in sorted(own[k])) == encoder.encode(text) + np.array([packing.END_ID], "<u4").tobytes()
    assert len({r.sequence_id for r in rows}) * packing.WINDOW <= 1.05 * sum(r.length for r in rows)
    assert pack_documents(df.limit(0), PATH).count() == 0
