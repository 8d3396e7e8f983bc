"""Exact join of documents by the Jaccard similarity of their word shingles, as classes of linked texts.

Jaccard distance is a metric.  Documents that share no shingle are all at distance 1, so pivots
that are documents cannot part a sparse corpus; the first pivots are therefore single shingles.

1.  A document can lie within 0.2 of another only if four fifths of its shingles occur elsewhere.
    In order of their hashes, the first ``n - ceil(0.8 n) + n // 5`` shingles of two linked documents have at least
    ``m // 5`` in common, where m is the smaller one's size.  These first shingles travel as packed five-byte strings to buckets
    that tell which ones are shared; documents with too few leave the join here.  The others, once for each set, deal out
    all their shingles, which come back with their frequencies.  A shingle that several documents of one block hold
    travels once for the block, so a passage that is everywhere stays cheap, and counts come back as one row for each block and bucket.
2.  Shared shingles, rarest first, are pivots.  Any two linked documents share one of the first
    ``n - ceil(0.8 n) + 1`` of either, so each is replicated to the cells of these and the cells that
    overlap make a region.
3.  A region is joined by document pivots: two far members make two Voronoi cells, members
    within the triangle-inequality window ``|d(x, p) - d(x, q)| <= 0.4`` go to both, and cells are
    joined recursively until they are small or no longer shrink; then exactly, by counts of shared shingles.
4.  A region too large for a task is first compared with a few pivots of its own.  Those within
    0.2 of one class of pivots are one class already; only the others are compared with all members,
    tile by tile.

Links leave a task as a spanning forest, never as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tracelens.llm.groups import Classes, groups
from tracelens.llm.words import batches_of_words, mix, shingle_sets
from tracelens.operators.components import connected_components
from tracelens.session import materialise

#: Shingles that one bucket of step 1 receives on average.
BUCKET_SHINGLES = 1_500_000
#: One in so many shingles is posted beyond those that a linked document may lack.
EXTRA = 5
#: Hashes and most 64-bit words (32 MB) of the filter that finds the texts that go on; where it is full, more texts move, no fewer.
BLOOM_HASHES, BLOOM_WORDS = 4, 1 << 22
#: Largest region (documents, shingles) that one task joins; also the size of a tile beyond.
REGION_DOCS, REGION_SHINGLES = 256, 2_000_000
#: Document pivots of a region that is too large for one task.
PIVOTS = 16
_EXACT_BELOW = 48


def _block(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of incidence matrices over the shared shingles."""
    m = len(sets)
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    new = np.ones(len(tokens), bool)
    new[1:] = tokens[1:] != tokens[:-1]
    column = np.cumsum(new) - 1
    keep = np.bincount(column)[column] > 1
    column, owner = column[keep], owner[keep]
    out = np.zeros((m, m), np.float64)
    if len(column):
        column = np.concatenate([[0], np.cumsum(column[1:] != column[:-1])])
        for low in range(0, int(column[-1]) + 1, 4096):
            s, e = np.searchsorted(column, [low, low + 4096])
            part = np.zeros((m, min(4096, int(column[-1]) + 1 - low)), np.float32)
            part[owner[s:e], column[s:e] - low] = 1
            out += part @ part.T
    np.fill_diagonal(out, [len(s) for s in sets])
    return out.astype(np.int64)


def _shared_with(pivot: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of each set (not empty) with the pivot."""
    tokens = np.concatenate(sets)
    at = np.minimum(np.searchsorted(pivot, tokens), len(pivot) - 1)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    return np.add.reduceat((pivot[at] == tokens).astype(np.int64), starts)


def _linked(shared: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * shared >= percent * (a + b - shared)


def join_region(sets: list[np.ndarray], percent: int, classes: Classes, members: np.ndarray | None = None) -> None:
    """Join in ``classes`` all members with a Jaccard similarity of ``percent`` or more, exactly."""
    members = np.arange(len(sets)) if members is None else members
    own = [sets[i] for i in members]
    size = np.array([len(s) for s in own])
    if len(members) > _EXACT_BELOW:
        distance = lambda p: 1 - (c := _shared_with(own[p], own)) / (size + size[p] - c)
        to_p = distance(0)
        to_q = distance(int(np.argmax(to_p)))
        window = 2 * (1 - percent / 100) + 1e-9
        left, right = to_p <= to_q + window, to_q <= to_p + window
        if max(left.sum(), right.sum()) <= 0.8 * len(members):
            join_region(sets, percent, classes, members[left])
            join_region(sets, percent, classes, members[right])
            return
    classes.join_matrix(_linked(_block(own), size[:, None], size[None, :], percent), members, members)


def _profiles(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, words in batches_of_words(batch.column("text"), lower=True):
            sets, bounds = shingle_sets(words, n)
            keys = [xxhash.xxh3_128_digest(sets[s:e]) for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(low, high - low), pa.array(np.diff(bounds)), pa.array(keys, pa.binary())],
                ["doc_id", "n_shingles", "set_key"],
            )


def _cut(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of its first shingles a document of ``n`` posts in step 1."""
    return np.minimum(n, n - (n * percent + 99) // 100 + np.maximum(1, n // EXTRA))


def _planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers as their lowest bytes, then the next ones: the high bytes are mostly zero and compress to nothing."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _first_shingles(batch: pa.RecordBatch, n: int, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, shingles, documents) of runs of documents, of each document the first shingles by hash."""
    ids = batch.column("doc_id").to_numpy()
    for low, high, words in batches_of_words(batch.column("text"), lower=True):
        sets, bounds = shingle_sets(words, n)
        size = np.diff(bounds)
        first = np.arange(len(sets)) - np.repeat(bounds[:-1], size) < np.repeat(_cut(size, percent), size)
        yield ids[low:high], sets[first], np.repeat(np.arange(high - low), size)[first]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*[x.split() for x in schema.split(", ")], strict=True)
    kinds = [pa.int64() if k == "long" else pa.binary() for k in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names)


def _wide(blobs: list[bytes]) -> np.ndarray:
    """Tails of 40 bits as 64-bit numbers."""
    short = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 5)
    out = np.zeros((len(short), 8), np.uint8)
    out[:, :5] = short
    return out.view("<u8").ravel()


_POSTED = "bucket long, block long, docs binary, lengths binary, tails binary, common binary, ids binary, known binary"


def _posted(batches: Iterator[pa.RecordBatch], n: int, percent: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Shingles of each block of documents by bucket: one tail of 40 bits for each, with the documents' places in the block and run lengths."""
    for batch in batches:
        for ids, sets, doc in _first_shingles(batch, n, percent):
            order = np.argsort(sets, kind="stable")
            ranked = sets[order]
            again = np.zeros(len(ranked), bool)
            again[1:] = ranked[1:] == ranked[:-1]
            several = again.copy()
            several[:-1] |= again[1:]
            known = np.bincount(doc[order[several]], minlength=len(ids))
            common = ranked[several & ~again]
            rest = np.sort(order[~several])
            # equal blocks are added up, which only counts too much
            block = xxhash.xxh3_64_intdigest(ids.tobytes()) >> 1
            rows = {}
            for values, owner in ((sets[rest], doc[rest]), (common, None)):
                bucket = (values % np.uint64(buckets)).astype(np.int64)
                tail = ((values // np.uint64(buckets)) & np.uint64((1 << 40) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
                by = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.diff(bucket[by], prepend=-1, append=-1))
                for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                    row = rows.setdefault(int(bucket[by[s]]), [b"", b"", b"", b""])
                    if owner is None:
                        row[3] = tail[by[s:e]].tobytes()
                    else:
                        docs, lengths = np.unique(owner[by[s:e]], return_counts=True)
                        row[:3] = _planes(docs), _planes(lengths), tail[by[s:e]].tobytes()
            out = [[b, block, *row, b"", b""] for b, row in rows.items()]
            if out:
                out.append([int(block % buckets), block, b"", b"", b"", b"", ids.tobytes(), _planes(known)])
            yield _batch(out, _POSTED)


_COUNTED = "block long, docs binary, shared binary, ids binary"


def _shared_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of a document's shingles in this bucket occur in other documents too: one row for each block."""
    for _, rows in groups(batches, "bucket"):
        at = {c: rows.column(c).to_pylist() for c in rows.column_names if c != "bucket"}
        out = [(block, b"", known, ids) for block, ids, known in zip(at["block"], at["ids"], at["known"], strict=True) if ids]
        tails, common = _wide(at["tails"]), _wide(at["common"])
        if len(tails):
            order = np.argsort(tails, kind="stable")
            ranked = tails[order]
            same = ranked[1:] == ranked[:-1]
            shared = np.zeros(len(tails), bool)
            shared[1:] |= same
            shared[:-1] |= same
            common = np.unique(common)
            if len(common):
                near = np.minimum(np.searchsorted(common, ranked), len(common) - 1)
                shared |= common[near] == ranked
            flag = np.zeros(len(tails), np.int64)
            flag[order] = shared
            low = 0
            for block, planes, lengths in zip(at["block"], at["docs"], at["lengths"], strict=True):
                if planes:
                    docs, size = _numbers(planes), _numbers(lengths)
                    ends = low + np.cumsum(size)
                    n = np.add.reduceat(flag[low : ends[-1]], ends - size - low)
                    low = int(ends[-1])
                    if n.any():
                        out.append((block, _planes(docs[n > 0]), _planes(n[n > 0]), b""))
        yield _batch(out, _COUNTED)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of a block's documents from all buckets."""
    for _, rows in groups(batches, "block"):
        at = {c: rows.column(c).to_pylist() for c in ("docs", "shared", "ids")}
        ids = np.frombuffer(next(x for x in at["ids"] if x), np.int64)
        total = np.zeros(len(ids), np.int64)
        for docs, shared, own in zip(at["docs"], at["shared"], at["ids"], strict=True):
            if own:
                total += _numbers(shared)
            else:
                total[_numbers(docs)] += _numbers(shared)
        has = total > 0
        yield pa.RecordBatch.from_arrays([pa.array(ids[has]), pa.array(total[has])], ["doc_id", "shared"])


_DEALT = "bucket long, block long, docs binary, lengths binary, tails binary, ids binary, sizes binary"


def _dealt(batches: Iterator[pa.RecordBatch], n: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """All shingles of each block of documents by bucket, as ``_posted`` has them, but each with its document."""
    for batch in batches:
        for ids, sets, bounds in _true_sets(batch, n):
            size = np.diff(bounds)
            doc = np.repeat(np.arange(len(ids)), size)
            block = xxhash.xxh3_64_intdigest(ids.tobytes()) >> 1
            bucket = (sets % np.uint64(buckets)).astype(np.int64)
            tail = ((sets // np.uint64(buckets)) & np.uint64((1 << 40) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
            by = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[by], prepend=-1, append=-1))
            out = []
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                docs, lengths = np.unique(doc[by[s:e]], return_counts=True)
                out.append((int(bucket[by[s]]), block, _planes(docs), _planes(lengths), tail[by[s:e]].tobytes(), b"", b""))
            out.append((int(block % buckets), block, b"", b"", b"", ids.tobytes(), _planes(size)))
            yield _batch(out, _DEALT)


_FREQUENT = "block long, docs binary, lengths binary, tokens binary, times binary, ids binary, sizes binary"


def _frequencies(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """The shingles of this bucket that come more than once, and how often: one row for each block."""
    for (bucket,), rows in groups(batches, "bucket"):
        at = {c: rows.column(c).to_pylist() for c in rows.column_names if c != "bucket"}
        out = [(block, b"", b"", b"", b"", ids, sizes) for block, ids, sizes in zip(at["block"], at["ids"], at["sizes"], strict=True) if ids]
        _, column, times = np.unique(tails := _wide(at["tails"]), return_inverse=True, return_counts=True)
        low = 0
        for block, planes, lengths in zip(at["block"], at["docs"], at["lengths"], strict=True):
            if planes:
                owner = np.repeat(_numbers(planes), _numbers(lengths))
                own, df = tails[low : low + len(owner)], times[column[low : low + len(owner)]]
                low += len(owner)
                several = df > 1
                if several.any():
                    docs, size = np.unique(owner[several], return_counts=True)
                    short = own[several].view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
                    out.append((block, _planes(docs), _planes(size), short + int(bucket).to_bytes(8, "little"), _planes(df[several]), b"", b""))
        yield _batch(out, _FREQUENT)


def _cells(batches: Iterator[pa.RecordBatch], percent: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Of each document the rarest shared shingles, as many that any linked one has one of them too; none where too few are shared.

    A token is a bucket and a tail; should two shingles have the same, regions only get larger.
    """
    for _, rows in groups(batches, "block"):
        at = {c: rows.column(c).to_pylist() for c in rows.column_names if c != "block"}
        ids, n = next((np.frombuffer(i, np.int64), _numbers(s)) for i, s in zip(at["ids"], at["sizes"], strict=True) if i)
        parts = [x for x in zip(at["docs"], at["lengths"], at["tokens"], at["times"], strict=True) if x[0]]
        if not parts:
            continue
        doc = np.concatenate([np.repeat(_numbers(d), _numbers(k)) for d, k, _, _ in parts])
        token = np.concatenate([_wide([t[:-8]]) * np.uint64(buckets) + np.uint64(int.from_bytes(t[-8:], "little")) for _, _, t, _ in parts])
        df = np.concatenate([_numbers(x) for _, _, _, x in parts])
        order = np.lexsort((token, df, doc))
        shared = np.bincount(doc, minlength=len(ids))
        spare = shared - (n * percent + 99) // 100
        place = np.arange(len(doc)) - np.repeat(np.cumsum(shared) - shared, shared)
        first = place <= np.repeat(spare, shared)
        yield pa.RecordBatch.from_arrays([pa.array(ids[doc[order][first]]), pa.array(token[order][first].view(np.int64))], ["node", "token"])


def _true_sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple]:
    """(ids, shingles, bounds) of runs of rows, without those whose set has not the digest ``set_key``."""
    keys, ids = batch.column("set_key").to_pylist(), batch.column("doc_id").to_numpy()
    for low, high, words in batches_of_words(batch.column("text"), lower=True):
        sets, bounds = shingle_sets(words, n)
        size = np.diff(bounds)
        good = np.array([xxhash.xxh3_128_digest(sets[s:e]) == keys[low + d] for d, (s, e) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))], bool)
        if good.any():
            yield ids[low:high][good], sets[np.repeat(good, size)], np.concatenate([[0], np.cumsum(size[good])])


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        region = dict(zip(batch.column("doc_id").to_pylist(), batch.column("region").to_pylist(), strict=True))
        for ids, sets, bounds in _true_sets(batch, n):
            packed = [sets[s:e].tobytes() for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([region[i] for i in ids.tolist()], pa.int64()), pa.array(np.diff(bounds)), pa.array(packed, pa.binary())], ["node", "region", "n", "shingles"])


def _bits(ids: np.ndarray, words: int) -> np.ndarray:
    """Places of each id in a Bloom filter of ``words`` (a power of two) 64-bit words, one row for each hash."""
    once = mix(ids.view(np.uint64))  # neighbouring ids have no hash in common
    return np.stack([mix(once + np.uint64(k)) for k in range(1, BLOOM_HASHES + 1)]) & np.uint64(64 * words - 1)


def _bloom(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = np.unique(_bits(batch.column(0).to_numpy(), words))
        word, starts = np.unique(at >> np.uint64(6), return_index=True)
        bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), starts) if len(at) else at
        yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(bits.view(np.int64))], ["word", "bits"])


def bloom_filter(ids: DataFrame, n: int) -> np.ndarray:
    """64-bit words of a Bloom filter of the ``n`` values of a column of longs; about 8 to 16 bits a value, ``BLOOM_WORDS`` words at most."""
    words = 1 << min(BLOOM_WORDS.bit_length() - 1, max(0, (n // 8).bit_length()))
    set_ = ids.mapInArrow(lambda b: _bloom(b, words), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(words, np.uint64)
    out[set_.column("word").to_numpy()] = set_.column("bits").to_numpy().view(np.uint64)
    return out


def in_bloom(ids: np.ndarray, bloom: np.ndarray) -> np.ndarray:
    at = _bits(ids, len(bloom))
    return ((bloom[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool).all(axis=0)


def by_bloom(batches: Iterator[pa.RecordBatch], bloom: np.ndarray, inside: bool) -> Iterator[pa.RecordBatch]:
    """Rows whose doc_id may be in the filter, or the others, which surely are not."""
    for batch in batches:
        if (keep := in_bloom(batch.column("doc_id").to_numpy().astype(np.int64), bloom) == inside).any():
            yield batch.filter(pa.array(keep))


def _forest(nodes: list[int], classes: Classes) -> pa.RecordBatch:
    up = classes.roots()
    away = np.flatnonzero(up != np.arange(len(up)))
    ids = np.array(nodes, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(ids[away]), pa.array(ids[up[away]])], ["src", "dst"])


def _arrays(column) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def _small_regions(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for _, rows in groups(batches, "region"):
        sets = _arrays(rows.column("shingles"))
        classes = Classes(len(sets))
        join_region(sets, percent, classes)
        yield _forest(rows.column("node").to_pylist(), classes)


def _to_pivots(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links of each member to its region's pivots; class: of the pivots that it is linked with, else -1."""
    kept: dict[int, tuple] = {}
    for batch in batches:
        out = []
        regions, nodes, sets = batch.column("region").to_pylist(), batch.column("node").to_pylist(), _arrays(batch.column("shingles"))
        for i, region in enumerate(regions):
            if region not in kept:
                kept.clear()
                ids = [p["node"] for p in batch.column("pivots")[i].as_py()]
                pivots = [np.frombuffer(p["shingles"], np.uint64) for p in batch.column("pivots")[i].as_py()]
                classes = Classes(len(pivots))
                join_region(pivots, percent, classes)
                kept[region] = ids, pivots, classes.roots()
            ids, pivots, up = kept[region]
            shared = np.array([int(_shared_with(p, [sets[i]])[0]) for p in pivots])
            near = np.flatnonzero(_linked(shared, np.array([len(p) for p in pivots]), len(sets[i]), percent))
            out += [(region, nodes[i], ids[j], int(up[near[0]])) for j in near] or [(region, nodes[i], None, -1)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["region", "node", "pivot", "class"])


def _tiles(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links between the open members of one tile and all members of another."""
    for _, rows in groups(batches, "region", "open_tile", "tile"):
        sets, side = _arrays(rows.column("shingles")), rows.column("is_open").to_numpy()
        size = np.array([len(s) for s in sets])
        classes = Classes(len(sets))
        a, b = np.flatnonzero(side), np.flatnonzero(~side)
        linked = _linked(_block(sets), size[:, None], size[None, :], percent)
        classes.join_matrix(linked[np.ix_(a, b)], a, b)
        classes.join_matrix(linked[np.ix_(a, a)], a, a)
        yield _forest(rows.column("node").to_pylist(), classes)


def shingle_profiles(documents: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id, n_shingles and a digest of the shingle set, for every row."""
    return documents.select("doc_id", "text").mapInArrow(lambda b: _profiles(b, shingle), "doc_id long, n_shingles long, set_key binary")


def _shared_shingles(documents: DataFrame, total: int, shingle: int, percent: int) -> DataFrame:
    """doc_id and (at least) the number of its first shingles, ``total`` of all rows, that are first shingles of other rows too; not below the truth."""
    buckets = total // BUCKET_SHINGLES + 1
    posted = documents.mapInArrow(lambda b: _posted(b, shingle, percent, buckets), _POSTED)
    counted = posted.repartition(max(buckets, 2), "bucket").sortWithinPartitions("bucket").mapInArrow(_shared_counts, _COUNTED)
    return (
        counted.repartition("block").sortWithinPartitions("block")
        .mapInArrow(_sums, "doc_id long, shared long")
        .groupBy("doc_id").agg(F.sum("shared").alias("shared"))
    )


def _rarest(documents: DataFrame, total: int, shingle: int, percent: int) -> DataFrame:
    """(node, token): the rarest shared shingles of each row of (doc_id, text, set_key) with ``total`` shingles in all."""
    buckets = total // BUCKET_SHINGLES + 1
    dealt = documents.mapInArrow(lambda b: _dealt(b, shingle, buckets), _DEALT)
    frequent = dealt.repartition(max(buckets, 2), "bucket").sortWithinPartitions("bucket").mapInArrow(lambda b: _frequencies(b, buckets), _FREQUENT)
    return frequent.repartition("block").sortWithinPartitions("block").mapInArrow(lambda b: _cells(b, percent, buckets), "node long, token long")


def _regions(cells: DataFrame) -> DataFrame:
    """(node, region): overlapping cells of the rarest shared shingles."""
    lowest = materialise(cells.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").drop("high"))
    met = cells.join(lowest, "token").select(F.col("node").alias("src"), F.col("low").alias("dst")).distinct()
    return connected_components(met).withColumnRenamed("component", "region")


def _links(nodes: DataFrame, percent: int) -> DataFrame:
    """(src, dst): a spanning forest of all links inside the regions, as a written table."""
    sized = materialise(nodes)
    extent = sized.groupBy("region").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("total"))
    parts = F.ceil(F.greatest(F.col("docs") / REGION_DOCS, F.col("total") / REGION_SHINGLES)).cast("int")
    members = sized.join(materialise(extent.filter("docs > 1").select("region", parts.alias("parts"))), "region")
    small = members.filter("parts = 1").select("region", "node", "shingles").repartition("region").sortWithinPartitions("region")
    links = small.mapInArrow(lambda b: _small_regions(b, percent), "src long, dst long")

    large = members.filter("parts > 1")
    rank = F.xxhash64("node", F.lit(7))
    # min_by over 16 slots, so that no task holds more of a region than one candidate a slot
    first = large.groupBy("region", F.pmod(F.xxhash64("node"), F.lit(PIVOTS)).alias("slot")).agg(F.min_by(F.struct("node", "shingles"), rank).alias("pivot"))
    pivots = first.groupBy("region").agg(F.collect_list("pivot").alias("pivots"))
    tested = materialise(
        large.join(pivots, "region").select("region", "node", "shingles", "pivots").mapInArrow(lambda b: _to_pivots(b, percent), "region long, node long, pivot long, class long")
    )
    stars = tested.filter("pivot is not null").select(F.col("node").alias("src"), F.col("pivot").alias("dst"))
    verdicts = tested.groupBy("region", "node").agg(F.min("class").alias("class"))
    core = verdicts.filter("class >= 0").groupBy("region", "class").count().groupBy("region").agg(F.max_by("class", F.struct("count", "class")).alias("core"))
    told = verdicts.join(core, "region", "left").select("region", "node", (~F.col("class").eqNullSafe(F.col("core"))).alias("open"))
    tiled = large.join(told, ["region", "node"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    open_side = tiled.filter("open").select("region", "node", "shingles", F.col("own").alias("open_tile"), F.explode(every).alias("tile"), F.lit(True).alias("is_open"))
    used = tiled.filter("open").select("region", F.col("own").alias("open_tile")).distinct()
    other = tiled.join(used, "region").select("region", "node", "shingles", "open_tile", F.col("own").alias("tile"), F.lit(False).alias("is_open"))
    keys = ["region", "open_tile", "tile"]
    pairs = open_side.unionByName(other).repartition(*keys).sortWithinPartitions(*keys)
    return materialise(links.unionByName(stars).unionByName(pairs.mapInArrow(lambda b: _tiles(b, percent), "src long, dst long")))


def jaccard_classes(documents: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``documents`` (doc_id, text, ...).

    Words are runs of anything but ASCII white space, with A-Z in lower case; a text of fewer words
    than a shingle is one shingle; null, empty and blank texts have none and are linked with nothing.
    Two documents are linked when ``100 * |A & B| >= percent * |A | B|``; component_id is the smallest
    doc_id reachable by links.  Equal rows count as one document and come back as often as they came;
    a row without doc_id is linked with nothing and has no component_id.  Other columns are not read.
    """
    spark = documents.sparkSession
    profiles = materialise(shingle_profiles(documents, shingle))
    linkable = profiles.filter("doc_id is not null and n_shingles > 0")
    first = materialise(linkable.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n")))
    named = documents.filter("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    n = F.col("n_shingles")
    whole = F.floor((n * percent + 99) / 100)
    posted = F.least(n, n - whole + F.greatest(F.lit(1), F.floor(n / EXTRA)))
    total = int(linkable.agg(F.sum(posted)).first()[0] or 0)
    shared = _shared_shingles(named, total, shingle, percent)
    least = F.greatest(F.lit(1), F.floor(F.floor((F.col("n") * percent + 99) / 100) / EXTRA))
    alive = materialise(first.join(shared.withColumnRenamed("doc_id", "node"), "node").filter(F.col("shared") >= least).select("node", "set_key", "n"))
    # only texts that go on, and a few more, are dealt out for the join; they take a fraction of what their shingles do
    bloom = spark.sparkContext.broadcast(bloom_filter(alive.select("node"), alive.count()))
    found = named.mapInArrow(lambda b: by_bloom(b, bloom.value, True), named.schema)
    likely = materialise(found.join(alive.withColumnRenamed("node", "doc_id"), "doc_id"))
    cells = materialise(_rarest(likely, int(alive.agg(F.sum("n")).first()[0] or 0), shingle, percent))
    regions = materialise(_regions(cells))
    nodes = likely.join(regions.select(F.col("node").alias("doc_id"), "region"), "doc_id")
    nodes = nodes.mapInArrow(lambda b: _sets(b, shingle), "node long, region long, n long, shingles binary")
    classes = connected_components(_links(nodes, percent))
    known = first.select("set_key", "node").join(classes, "node", "left").select("set_key", F.coalesce("component", "node").alias("class"))
    linked = linkable.join(known, "set_key").select("doc_id", "n_shingles", F.col("class").alias("component_id"))
    alone = profiles.filter("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)
