"""Counterparty clusters against a union-find over the same identifiers."""

from pyspark.sql import functions as F

from tracelens.operators import identities as ident, reports


def test_clusters_equal_a_union_find(spark):
    ids = {k: [f"uid:{k % 7}"] * (k % 3 == 0) + [f"ph:{k // 5}"] * (k % 4 != 1) for k in range(60)}
    df = spark.createDataFrame(list(ids.items()), "id long, ids array<string>")
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for k, own in ids.items():
        for i in own:
            up[root(i)] = root(("pmt", k))
    expected = {frozenset(j for j in ids if root(("pmt", j)) == root(("pmt", k))) for k in ids}
    found: dict[str, set[int]] = {}
    for r in ident.resolve_counterparties(df, "id", F.col("ids")).collect():
        found.setdefault(r["cluster"], set()).add(r["id"])
    assert set(map(frozenset, found.values())) == expected


def test_only_payments_with_several_identifiers_enter_the_graph(spark, monkeypatch):
    seen, real = [], ident.connected_components
    monkeypatch.setattr(ident, "connected_components", lambda edges: (seen.append(edges.count()), real(edges))[1])
    rows = [(1, ["uid:1"]), (2, ["uid:1", None, "ph:9"]), (3, ["zz:3"]), (3, ["ph:9"]), (4, ["uid:4"]), (5, ["uid:4"]), (6, []), (7, None), (6, None), (None, ["uid:1"]), (8, ["aa:1"])]
    got = ident.resolve_counterparties(spark.createDataFrame(rows, "id long, ids array<string>"), "id", F.col("ids")).collect()
    want = [(1, "ph:9"), (2, "ph:9"), (3, "ph:9"), (3, "ph:9"), (4, "pmt:4"), (5, "pmt:4"), (6, "pmt:6"), (6, "pmt:6"), (7, "pmt:7"), (8, "aa:1"), (None, None)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and seen == [2]


def test_tables_that_lack_columns(spark):
    df = spark.createDataFrame([(1, "=x")], "id int, note string")
    rows, gaps = reports.select_tolerant(df, {"id": "long", "amount": "long"})
    assert gaps == ["amount"] and rows.first().asDict() == {"id": 1, "amount": None}
    assert reports.export_rows(df, ["note", "absent"]).first().asDict() == {"note": "'=x", "absent": None}
    timed = spark.range(1).select(F.struct(F.lit(0).cast("long").alias("epoch_ms")).alias("at"))
    assert reports.flatten_times(timed).columns == ["at_iso", "at_epoch_ms"]
