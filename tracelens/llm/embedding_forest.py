"""Near-duplicate embeddings by a forest of random-projection trees.

A tree splits all vectors by a random direction at every level, at the median of a bounded sample; a vector
within ``SPILL`` of the cut goes to both sides.  Vectors of one label that share a leaf of any tree are compared exactly, in
double precision.  Equal vectors are one vector with a weight; a leaf too large for a task is compared tile by tile.

A pair that meets in several leaves is counted in the first of them only, which each task can tell from the
vectors' own leaf lists, so links are counted without ever being listed; they leave a task as counts and a
spanning forest, and the classes are the components of these.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tracelens.llm.groups import Classes, groups
from tracelens.operators.components import connected_components
from tracelens.session import materialise

TREES, LEAF, SPILL = 6, 256, 0.02
#: Vectors that the cuts are learned from (the index holds every vector), and the least number of them behind a cut.
SAMPLE, LEAST_SAMPLE = 40_000, 8
#: Vectors of one leaf that a task compares with each other; beyond, tiles of this size meet in pairs.
TILE = 2_048


@dataclass
class Forest:
    """Per tree: a direction for each level, and the cuts of that level's nodes."""

    directions: np.ndarray  # tree, level, dimension
    cuts: list[list[np.ndarray]]

    @staticmethod
    def fit(sample: np.ndarray, largest: int, trees: int = TREES, leaf: int = LEAF, seed: int = 13) -> Forest:
        """Cuts for leaves of about ``leaf`` vectors of the largest label."""
        depth = max(0, min(math.ceil(math.log2(max(largest, 1) / leaf)), int(math.log2(max(len(sample), 1) / LEAST_SAMPLE)) if len(sample) else 0))
        rng = np.random.default_rng(seed)
        directions = rng.normal(size=(trees, depth, sample.shape[1] if sample.size else 1))
        directions /= np.linalg.norm(directions, axis=2, keepdims=True)
        cuts = []
        for t in range(trees):
            node, own = np.zeros(len(sample), np.int64), []
            for level in range(depth):
                at = sample @ directions[t, level]
                order = np.lexsort((at, node))
                bounds = np.searchsorted(node[order], np.arange(2**level + 1))
                middle = (bounds[:-1] + bounds[1:]) // 2
                cut = np.where(bounds[1:] > bounds[:-1], at[order][np.minimum(middle, len(at) - 1)], 0.0)
                own.append(cut)
                node = 2 * node + (at > cut[node])
            cuts.append(own)
        return Forest(directions, cuts)

    def leaves(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per tree: (vector, leaf) pairs, with spill."""
        out = []
        for t, cuts in enumerate(self.cuts):
            row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
            for level, cut in enumerate(cuts):
                gap = (x @ self.directions[t, level])[row] - cut[node]
                right, left = gap > -SPILL, gap <= SPILL
                row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
            out.append((row, node))
        return out


def _vectors(column: pa.Array) -> np.ndarray:
    """Rows of unit vectors in double precision."""
    x = np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, label, the vector's bytes in double precision (null where it can link with nothing) and their digest."""
    for batch in batches:
        out = []
        for v, label in zip(batch.column("embedding").to_pylist(), batch.column("label").to_pylist(), strict=True):
            x = None if v is None or label is None or any(c is None for c in v) else np.array(v, np.float64) + 0.0
            good = x is not None and len(x) and np.isfinite(x).all() and x.any() and np.isfinite(n := np.linalg.norm(x)) and n > 0
            blob = x.tobytes() if good else None
            out.append((blob, xxhash.xxh3_128_digest(blob) if good else None))
        vectors, digests = zip(*out, strict=True) if out else ((), ())
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(vectors, pa.binary()), pa.array(digests, pa.binary())], ["vec_id", "label", "vector", "digest"])


def _placed(batches: Iterator[pa.RecordBatch], forests: dict[int, Forest]) -> Iterator[pa.RecordBatch]:
    """A row for each vector and leaf; ``lists`` holds all (tree, leaf) codes of the vector, ascending."""
    for batch in batches:
        sizes = np.array([len(b) // 8 for b in batch.column("vector").to_pylist()])
        for size, forest in forests.items():
            part = batch.filter(pa.array(sizes == size))
            if not part.num_rows:
                continue
            vectors = part.column("vector")
            found = forest.leaves(_vectors(vectors))
            row = np.concatenate([r for r, _ in found])
            code = np.concatenate([(np.int64(t) << 40) + leaf for t, (_, leaf) in enumerate(found)])
            order = np.lexsort((code, row))
            row, code = row[order], code[order]
            bounds = np.searchsorted(row, np.arange(part.num_rows + 1))
            lists = [code[s:e].tobytes() for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [part.column(c).take(at) for c in ("node", "label", "weight", "vector")] + [pa.array(lists, pa.binary()).take(at), pa.array(code), pa.array(np.full(len(row), size))],
                ["node", "label", "weight", "vector", "lists", "leaf", "size"],
            )


def _met_before(lists: list[bytes], leaf: int) -> np.ndarray:
    """Which vectors share a leaf before this one."""
    codes = [np.frombuffer(b, np.int64) for b in lists]
    flat, owner = np.concatenate(codes), np.repeat(np.arange(len(codes)), [len(c) for c in codes])
    early = flat < leaf
    _, column = np.unique(flat[early], return_inverse=True)
    out = np.zeros((len(lists), len(lists)), bool)
    width = int(column.max(initial=-1)) + 1
    for low in range(0, width, 2_048):
        some = (column >= low) & (column < low + 2_048)
        part = np.zeros((len(lists), min(2_048, width - low)), np.float32)
        part[owner[early][some], column[some] - low] = 1
        out |= part @ part.T > 0
    return out


def _compared(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Links inside a leaf, or between two tiles of it: each vector's count (by weight), and a spanning forest."""
    for (_, _, leaf, a, b), rows in groups(batches, "label", "size", "leaf", "a", "b"):
        x, side = _vectors(rows.column("vector").combine_chunks()), rows.column("tile").to_numpy()
        weight, nodes = rows.column("weight").to_numpy(), rows.column("node").to_numpy()
        linked = x @ x.T >= least
        np.fill_diagonal(linked, False)
        if a != b:
            linked &= side[:, None] != side[None, :]
        classes, every = Classes(len(x)), np.arange(len(x))
        classes.join_matrix(linked, every, every)
        linked &= ~_met_before(rows.column("lists").to_pylist(), leaf)
        up = classes.roots()
        n = linked @ weight
        has = np.flatnonzero((n > 0) | (up != every))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[has]), pa.array(nodes[up[has]]), pa.array(n[has])], ["src", "dst", "n"])


def near_embeddings(embeddings: DataFrame, least: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``embeddings`` (vec_id, embedding, label, ...).

    Vectors are compared when their labels are equal and not null and they have as many components.  Null and
    zero vectors, those with null or non-finite components, and rows without label or vec_id are linked with nothing
    (without vec_id, component_id and kept are null).  Equal rows count as one vector and come back as often as
    they came.  Every reported link has a cosine of ``least`` or more; a pair that no tree puts in one leaf is missed.
    """
    kind = embeddings.schema["label"].dataType.simpleString()
    rows = materialise(embeddings.select(F.col("vec_id").cast("long"), "embedding", "label").mapInArrow(_digested, f"vec_id long, label {kind}, vector binary, digest binary"))
    valid = rows.filter("vec_id is not null and digest is not null")
    once = valid.groupBy("label", "digest", "vec_id").agg(F.first("vector").alias("vector"))
    nodes = materialise(once.groupBy("label", "digest").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("weight"), F.first("vector").alias("vector")))
    dims = nodes.groupBy("label", (F.length("vector") / 8).cast("int").alias("size")).count().groupBy("size").agg(F.max("count").alias("largest"))
    forests = {}
    for r in dims.collect():  # one row for each dimension that occurs
        sample = nodes.filter(F.length("vector") == 8 * r["size"]).orderBy(F.xxhash64("node", "digest")).select("vector").limit(SAMPLE).toArrow()
        forests[r["size"]] = Forest.fit(_vectors(sample.column("vector").combine_chunks()), r["largest"])
    placed = nodes.select("node", "label", "weight", "vector").mapInArrow(
        lambda b: _placed(b, forests), f"node long, label {kind}, weight long, vector binary, lists binary, leaf long, size long"
    )
    placed = materialise(placed)
    leaf = ["label", "size", "leaf"]
    parts = placed.groupBy(*leaf).agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("parts"))
    tiled = placed.join(parts, leaf).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(F.least("tile", i).alias("a"), F.greatest("tile", i).alias("b"))))
    keys = [*leaf, "a", "b"]
    met = tiled.withColumn("pair", pair).select("*", "pair.*").drop("pair", "parts").repartition(*keys).sortWithinPartitions(*keys)
    links = materialise(met.mapInArrow(lambda b: _compared(b, least), "src long, dst long, n long"))
    counts = links.groupBy("src").agg(F.sum("n").alias("n")).withColumnRenamed("src", "node")
    classes = connected_components(links.filter("src <> dst").select("src", "dst"))
    known = nodes.select("label", "digest", "node", "weight").join(counts, "node", "left").join(classes, "node", "left")
    told = known.select("label", "digest", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    linked = valid.select("vec_id", "label", "digest").join(told, ["label", "digest"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("vec_id is null or digest is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
