import datetime
import random

from tracelens.demo.queries import QUERIES
from tracelens.operators import components
from tracelens.operators.components import connected_components


def partition(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


def test_components_with_hub_chain_and_selfloop(spark):
    rng = random.Random(3)
    edges = [("hub", f"n{i:03d}") for i in range(80)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(30)]
    edges += [(f"r{rng.randrange(40)}", f"r{rng.randrange(40)}") for _ in range(25)] + [("alone", "alone")]
    df = spark.createDataFrame(edges, "src string, dst string")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == partition(edges)


def test_component_clusters_takes_every_row(spark, tmp_path):
    rng = random.Random(4)
    day = datetime.datetime(1995, 1, 1)
    rows = [(k // 3, rng.randrange(6), day + datetime.timedelta(days=rng.randrange(20)), float(k % 50 + 1)) for k in range(150)]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_shipdate timestamp, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.node: r.component for r in QUERIES["component_clusters"](spark, str(tmp_path)).collect()}
    assert got == partition([(f"order:{o}", f"shipping:{s}:{d:%Y-%m-%d}") for o, s, d, _ in rows])


def test_components_by_rounds_and_in_one_task_are_the_same(spark, monkeypatch):
    rng = random.Random(5)
    edges = [(f"{k:04d}", f"{k + 1:04d}") for k in range(300)] + [(f"r{rng.randrange(200)}", f"r{rng.randrange(200)}") for _ in range(120)]
    edges += [("hub", f"h{k}") for k in range(50)] + [("alone", "alone"), ("x", None)]
    df = spark.createDataFrame(edges, "src string, dst string")
    expected = partition([e for e in edges if None not in e])
    # nothing of 300 links in a row may need more than a few rounds, as every one is written
    written, write = [], components.materialise
    monkeypatch.setattr(components, "materialise", lambda x: written.append(1) or write(x))
    for most in (components.TASK_EDGES, 0):
        monkeypatch.setattr(components, "TASK_EDGES", most)
        assert {r.node: r.component for r in connected_components(df).collect()} == expected
        if most:
            assert len(written) <= 5
    assert len(written) < 50
