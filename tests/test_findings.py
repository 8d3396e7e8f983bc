"""Findings where nothing is found, and the label rules of ranked counterparties."""

from pyspark.sql import functions as F

from tracelens.operators import findings as f

PAID = "id long, state string, paise long, party string"


def test_nothing_found_gives_no_rows(spark):
    good = spark.createDataFrame([(1, "SUCCESS", 10, "a"), (2, None, None, None)], PAID)
    assert f.payment_findings(good).collect() == [] and f.payment_findings(good.limit(0)).collect() == []
    assert f.wallet_findings(spark.createDataFrame([(0,), (None,)], "paise long")).collect() == []
    assert f.device_findings(spark.createDataFrame([("m", None), ("n", False)], "model string, is_rooted boolean")).collect() == []
    assert f.store_findings(spark.createDataFrame([("s", 20, 100), ("t", 0, 0), ("u", None, 5)], "store string, free_pages long, total_pages long")).collect() == []
    assert f.message_findings(spark.createDataFrame([(5, 0, 3, 8)], "confirmed long, uncorroborated long, only_right long, n_right long")).collect() == []


def test_recovery_says_either(spark):
    schema = "table string, extent string, ambiguous boolean"
    scanned, none = spark.range(3), spark.createDataFrame([], schema)
    assert [(r.severity, r.category, r.n) for r in f.recovery_findings(none, scanned).collect()] == [("info", "no_deleted_records_recovered", 3)]
    some = spark.createDataFrame([("a", "high", False), ("b", "medium", False), (None, "high", True)], schema)
    assert [(r.severity, r.category, r.n) for r in f.recovery_findings(some, scanned).collect()] == [("high", "recovered_deleted_records", 3)]


def test_missing_payments_by_severity(spark):
    schema = "entity string, score int, verdict string"
    old = spark.createDataFrame([("a", 1, "before window"), ("b", 2, "inside window")], schema)
    new = old.union(spark.createDataFrame([("c", 1, "inside window")], schema))
    assert [(r.severity, r.n) for r in f.missing_payment_findings(old).collect()] == [("info", 1)]
    assert [(r.severity, r.n, r.detail) for r in f.missing_payment_findings(new).collect()] == [("medium", 2, '{"before_window":1,"inside_window":1,"undated":0,"sample_inside_window":["c"]}')]


def test_rank_keys_and_labels(spark):
    schema = "seq long, direction string, state string, paise long, user_id string, phone string, vpa string, name string, resolved string, is_merchant boolean"
    rows = [
        (1, "IN", "SUCCESS", 5, "u1", "91", "v@x", "****1", None, None), (2, "IN", "settled ", 6, "u1", None, None, "9876", None, True), (3, "IN", "SUCCESS", 7, "u1", None, None, "Ann", None, False), (4, "IN", "SUCCESS", 1, "u1", None, None, None, "Real Ann", None),
        (5, "IN", "SUCCESS", 4, "", "+91 98765 43210", None, "98765", None, None), (6, "IN", "SUCCESS", 4, None, "9876543210", "w@x", "***10", None, None), (7, "IN", "FAILED", 99, "u1", None, None, None, None, None), (8, "SELF", "SUCCESS", 99, "u1", None, None, None, None, None),
        (9, "OUT", "SUCCESS", 3, None, "***1", "W@x", "Bob", None, None), (10, "OUT", "SUCCESS", 2, None, None, None, "BOB", None, None), (11, "OUT", "SUCCESS", None, None, None, None, "bob", None, None), (12, "OUT", "SUCCESS", 1, None, None, None, None, None, None),
    ]
    got = [(r.direction, r.place, r.label, r.kind, r.n, r.paise, r.grouped_by, r.key) for r in f.rank_counterparties(spark.createDataFrame(rows, schema)).orderBy("direction", "place").collect()]
    assert got == [
        ("IN", 1, "Real Ann", "Merchant", 4, 19, "uid", "u1"), ("IN", 2, "***10", "Peer", 2, 8, "ph", "9876543210"), ("OUT", 1, "Bob", "Peer", 1, 3, "vpa", "w@x"), ("OUT", 2, "BOB", "Peer", 1, 2, "name", "bob"),
    ]
    assert len(f.rank_counterparties(spark.createDataFrame(rows, schema), 1).collect()) == 2
    weak = spark.createDataFrame([("****1",), ("+91",), ("Ann",), (None,), ("XX12",)], "n string").select(f.weak_name(F.col("n")).alias("w"))
    assert [r.w for r in weak.collect()] == [True, True, False, True, True]


def test_missing_payments_are_worked_out_once(spark):
    alone = F.when(F.col("id") < 4, "inside window").otherwise("undated")
    missing = spark.range(9).select(F.lit(1).alias("score"), alone.alias("verdict"), F.format_string("e%d", "id").alias("entity"))
    out = f.missing_payment_findings(missing)
    assert "Range" not in out._jdf.queryExecution().optimizedPlan().toString()
    row = out.first()
    assert (row.severity, row.n) == ("medium", 9) and '"inside_window":4' in row.detail and '["e0","e1","e2","e3"]' in row.detail
