"""Connected components by contraction to random neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tracelens.operators.scan import with_row_index
from tracelens.session import materialise

#: Edges up to which the contracted graph is finished by one task (two longs each). Fixed value.
TASK_EDGES = 500_000


def _representatives(edges: DataFrame, turn: int) -> DataFrame:
    """(id, rep): of a node and its neighbours the one that this round's hash puts first."""
    both = edges.unionByName(edges.select(F.col("t").alias("s"), F.col("s").alias("t")))
    rank = lambda c: F.xxhash64(c, F.lit(turn))
    nearest = both.groupBy(F.col("s").alias("id")).agg(F.min_by("t", rank("t")).alias("t"))
    return nearest.select("id", F.when(rank("t") < rank("id"), F.col("t")).otherwise(F.col("id")).alias("rep"))


def _relabelled(edges: DataFrame, ids: DataFrame, key: str, label: str) -> DataFrame:
    """``edges`` between the labels of their ends: loops dropped, each once.

    Tables that grow with the input are joined by their keys: a compressed file can look small enough for a broadcast that the driver cannot hold.
    """
    for end in edges.columns:
        edges = edges.join(ids.select(F.col(key).alias(end), F.col(label).alias(f"_{end}")).hint("merge"), end).drop(end)
    s, t = (F.col(c) for c in edges.columns)
    return edges.filter(s != t).select(F.greatest(s, t).alias("s"), F.least(s, t).alias("t")).distinct()


def _roots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(id, root) of every end of the edges of one task, by union-find."""
    edges = [batch for batch in batches if len(batch)]
    if not edges:
        return
    ids, places = np.unique(pd.concat(edges)[["s", "t"]].to_numpy().ravel(), return_inverse=True)
    parent = list(range(len(ids)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    pairs = places.ravel().tolist()
    for a, b in zip(pairs[::2], pairs[1::2]):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    yield pd.DataFrame({"id": ids, "root": ids[[find(x) for x in range(len(ids))]]})


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` with the smallest node as the component label.

    Nodes are numbered in their order, so that all rounds work on numbers.  In a round every node is replaced by that one of itself
    and its neighbours which a hash, new each time, puts first; edges between what is left are kept once.  A path maps to a path, so
    this never parts or joins components, and as the picks are random the graph is expected to shrink by a constant factor whatever its shape:
    all rounds together cost little more than the first.  The rest, when it has at most ``TASK_EDGES`` edges, is finished in one task.
    Each round is written to the shared folder, so the plan stays short and a lost executor costs one round.
    """
    raw = materialise(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).filter("src is not null and dst is not null"))
    nodes = with_row_index(raw.select(F.col("src").alias("node")).union(raw.select("dst")).distinct(), ["node"], "id")
    current = materialise(_relabelled(raw, nodes, "node", "id"))
    rounds: list[DataFrame] = []
    while current.count() > TASK_EDGES:
        rounds.append(materialise(_representatives(current, len(rounds))))
        current = materialise(_relabelled(current, rounds[-1], "id", "rep"))
    labels = current.repartition(1).mapInPandas(_roots, "id long, root long")
    for step in reversed(rounds):
        higher = labels.select(F.col("id").alias("rep"), "root").hint("merge")
        labels = step.join(higher, "rep", "left").select("id", F.coalesce("root", "rep").alias("root"))
    labels = materialise(labels)
    lowest = labels.groupBy("root").agg(F.min("id").alias("low"))
    found = labels.join(materialise(lowest).hint("merge"), "root").select("id", "low")
    named = nodes.join(found.hint("merge"), "id", "left").select("node", F.coalesce("low", "id").alias("low"))
    return named.join(nodes.select(F.col("id").alias("low"), F.col("node").alias("component")).hint("merge"), "low").select("node", "component")
