"""Files, nested documents, messages and shared expenses on written and hand-made fixtures."""

import base64
import decimal
import hashlib
import itertools
import json
import random

from pyspark.sql import functions as F

from tracelens.operators import nested, shared
from tracelens.sources import files


def written(folder, contents):
    for name, content in contents.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    return str(folder)


def by_name(rows, folder):
    return {r.path.split(f"{folder}/")[-1]: r for r in rows}


def test_inventory_of_written_files(spark, tmp_path):
    contents = {"a.JSON": b"{}", "sub/core.db": files.PLAIN_HEADER + b"rest", "sub/locked.sqlite": b"\x01" * 40, "empty.db": b"", ".hidden": b"x", "noext": b"y", "two.dots.tar": b"z"}
    listing = files.read_files(spark, written(tmp_path, contents))
    rows = by_name(files.file_inventory(listing).collect(), tmp_path)
    listed = {n: c for n, c in contents.items() if n not in ("empty.db", ".hidden")}  # Spark's readers pass over both
    assert {n: (r.size, r.sha256) for n, r in rows.items()} == {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in listed.items()}
    assert {n: r.ext for n, r in rows.items()} == {"a.JSON": ".json", "sub/core.db": ".db", "sub/locked.sqlite": ".sqlite", "noext": "(noext)", "two.dots.tar": ".tar"}
    assert {n: r.encrypted for n, r in rows.items() if r.encrypted is not None} == {"sub/core.db": False, "sub/locked.sqlite": True}
    assert {r.ext: (r.n, r.bytes) for r in files.extension_counts(listing).collect()}[".db"] == (1, len(files.PLAIN_HEADER) + 4)
    names = spark.createDataFrame([("x/.hidden", 0), ("x/a.", 0), ("x.d/b", 0)], "path string, length long")
    assert [r.ext for r in files.file_inventory(names, hashed=False).orderBy("path").collect()] == ["(noext)", "(noext)", "."]


def test_documents_under_the_size_rule(spark, tmp_path):
    contents = {"s/device.json": b'\xef\xbb\xbf{"a":1}', "s/good.json": b' \n{"a":{"b":"x"}}', "s/list.json": b"[1]", "s/bad.json": b"{", "s/text.json": b"hello", "s/large.json": b'{"a":"' + b"x" * 100 + b'"}'}
    listing = files.read_files(spark, written(tmp_path, contents))
    docs = files.read_json_docs(listing, 50)
    status = {n: r.status for n, r in by_name(docs.drop("doc").collect(), tmp_path).items()}
    assert status == {"s/device.json": "not json", "s/good.json": "parsed", "s/list.json": "parsed", "s/bad.json": "undecodable", "s/text.json": "not json", "s/large.json": "over size cap"}
    plan = listing.filter("length > 50").select("path", "length")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan  # what is over the cap is never read


def test_documents_of_a_folder_merged(spark):
    rows = [("p/one/user.json", '{"name":"","id":7}'), ("p/one/config.json", '{"title":"App","id":9}'), ("p/two/config.json", '{"title":"Two"}'), ("p/two/other.json", '{"title":"no"}')]
    docs = spark.createDataFrame(rows, "path string, text string").select("path", F.parse_json("text").alias("doc"))
    merged = files.merged_docs(docs, F.regexp_extract("path", "p/([^/]+)/", 1), {"user.json": "user", "config.json": "config"}, {"id": ["user:id", "config:id"], "title": ["user:title", "config:title"]})
    assert {r.folder: (r.id, r.title) for r in merged.collect()} == {"one": ("7", "App"), "two": (None, "Two")}


def test_preference_files(spark, tmp_path):
    head = b"<?xml version='1.0' encoding='utf-8' standalone='yes' ?>\n"
    body = b'<map>\n<string name="s">a &amp; {"j":1}</string><string name="empty"></string><int name="i" value="-3"/><long name="l" value="9000000000"/><float name="f" value="1.5"/><boolean name="b" value="true"/><set name="t"><string>x</string><string>y</string></set><int value="1"/><int name="bad" value="x"/></map>'
    path = written(tmp_path, {"one.xml": head + body, "two.xml": head + b'<map><string name="s">other</string></map>', "none.xml": head + b"<map />"})
    rows = {(r.file, r.key): (r.value_type, r.value) for r in files.prefs_table(files.read_prefs_xml(spark, path)).collect()}
    assert rows == {
        ("one.xml", "s"): ("string", 'a & {"j":1}'), ("one.xml", "empty"): ("string", rows[("one.xml", "empty")][1]), ("one.xml", "i"): ("int", "-3"), ("one.xml", "l"): ("long", "9000000000"), ("one.xml", "f"): ("float", "1.5"),
        ("one.xml", "b"): ("boolean", "true"), ("one.xml", "t"): ("set", '["x","y"]'), ("one.xml", "bad"): ("int", None), ("two.xml", "s"): ("string", "other"),
    }
    assert rows[("one.xml", "empty")][1] in (None, "")


def walk(value, path=(), depth=0, most=12):
    if depth < most and isinstance(value, dict) and value:
        for k, v in value.items():
            yield from walk(v, (*path, k), depth + 1, most)
    elif depth < most and isinstance(value, list) and value:
        for k, v in enumerate(value):
            yield from walk(v, (*path, str(k)), depth + 1, most)
    else:
        yield ".".join(path) or None, value


def document(draw, depth):
    if depth == 0 or draw.random() < 0.3:
        return draw.choice([1, "x", True, None, 2.5, [], {}, "call 9876543210", "a@b"])
    if draw.random() < 0.5:
        return [document(draw, depth - 1) for _ in range(draw.randint(0, 3))]
    return {draw.choice("pqrs"): document(draw, depth - 1) for _ in range(draw.randint(0, 3))}


def test_leaves_equal_a_walk(spark):
    draw = random.Random(9)
    docs = [document(draw, 6) for _ in range(120)]
    df = spark.createDataFrame([(k, json.dumps(d)) for k, d in enumerate(docs)], "id long, text string").select("id", F.parse_json("text").alias("doc"))
    for most in (3, 12):
        got = sorted((r.id, r.path or "", r.leaf or "null") for r in nested.leaves(df, "doc", most).select("id", "path", F.to_json("leaf").alias("leaf")).collect())
        want = sorted((k, path or "", json.dumps(v, separators=(",", ":"), sort_keys=True)) for k, d in enumerate(docs) for path, v in walk(d, most=most))
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert [json.loads(g[2]) for g in got] == [json.loads(w[2]) for w in want]
    empty = df.limit(0)
    assert nested.leaves(empty, "doc").count() == 0
    seen = nested.values_seen(nested.leaves(df, "doc"), ["id"])
    assert {(r.id, r.kind, r.value) for r in seen.collect()} == {
        (k, kind, value) for k, d in enumerate(docs) for _, v in walk(d) for kind, value, text in (("phone", "9876543210", "call 9876543210"), ("address", "a@b", "a@b")) if v == text
    }


def test_delivered_message_odd_rows(spark):
    code = lambda d: base64.b64encode(json.dumps(d).encode()).decode().rstrip("=")
    rows = [(1, None), (2, "[]"), (3, '{"message": 5}'), (4, '{"message":{"payload":null}}'), (5, json.dumps({"message": {"payload": code({"data": {"placements": [{"template": "text"}, {"template": {"templateParams": {"value": {"title": 5}}}}]}})}})), (6, json.dumps({"message": {"payload": ""}}))]
    got = {r.message_id: (r.kind, r.title, r.is_notification, r.payload_undecodable) for r in nested.delivered_messages(spark.createDataFrame(rows, "id long, data string"), "id", "data").collect()}
    assert got["1"] == got["2"] == got["3"] == got["4"] == ("unclassified", None, False, False)
    assert got["5"] == ("NOTIFICATION", "5", True, False) and got["6"] == ("unclassified", None, False, True)


SHARE = "expense long, seq long, member string, is_payer boolean, paise long"


def test_nets_add_up_to_nothing(spark):
    draw = random.Random(12)
    rows = [(draw.randint(0, 40), k, draw.choice("abcdef"), draw.choice([True, False, False, None]), draw.choice([0, None, *range(1, 500)])) for k in range(400)]
    members = spark.createDataFrame(rows, SHARE).repartition(3)
    owed = {}
    for expense, own in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        own = list(own)
        payer = next((m for _, _, m, pays, _ in sorted(own, key=lambda r: r[1]) if pays), None)
        for _, _, m, pays, paise in own:
            if payer is not None and not pays and paise and m != payer:
                owed[payer, m] = owed.get((payer, m), 0) + paise
                owed[m, payer] = owed.get((m, payer), 0) - paise
    got = {(r.member, r.other): r.net for r in shared.pairwise_nets(shared.debts(members)).collect()}
    assert got == owed and sum(got.values()) == 0
    rows = shared.balances(shared.debts(members)).collect()
    assert sum(r.net for r in rows) == 0 and all(r.net == r.to_receive - r.to_give for r in rows)
    assert shared.balances(shared.debts(members.limit(0))).count() == 0


def test_expense_totals(spark):
    members = spark.createDataFrame([(1, 2, "a", True, 10), (1, 1, "b", True, 99), (1, 3, "c", False, 5), (2, 1, "a", False, 7), (2, 2, "b", None, None)], SHARE)
    entries, settled = spark.createDataFrame([(1,), (2,), (3,)], "expense long"), spark.createDataFrame([(1, "p1"), (1, "p2")], "expense long, payment string")
    rows = {r.expense: (r.payer, r.total, r.settlement, r.n_members) for r in shared.expenses(entries, members, settled).collect()}
    assert rows == {1: ("b", 99, "p2", 3), 2: (None, 7, None, 2), 3: (None, 0, None, 0)}


def test_payloads_do_not_travel_through_the_lookups_of_leg_transactions(spark):
    from tracelens.demo.queries import QUERIES
    import tracelens.demo.stores  # noqa: F401

    def joins(node):
        of = lambda seq: [seq.apply(k) for k in range(seq.size())]
        found = [[a.dataType().simpleString() for a in of(node.output())]] if node.nodeName() == "Join" else []
        return found + [j for child in of(node.children()) for j in joins(child)]

    carried = joins(QUERIES["leg_transactions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan())
    # those who pay and are paid are asked for by the payload itself
    assert len(carried) >= 6 and sum("variant" in kinds for kinds in carried) <= 2


def test_preference_files_stay_small_enough_for_a_task(spark, monkeypatch, tmp_path):
    from tracelens.demo import records
    from tracelens.demo.queries import QUERIES

    folder = str(tmp_path / "prefs")
    monkeypatch.setattr(records, "PREFS_ROWS", 40)
    monkeypatch.setattr(records, "fresh_path", lambda spark: folder)
    rows = QUERIES["preferences"](spark, "/root/testdata/sf0.001")
    n = spark.read.parquet("/root/testdata/sf0.001/customer.parquet").count()
    assert rows.count() == 5 * n
    # a file is one task's, so no file may hold all customers
    written = spark.read.text(folder).filter("value like '%<map>%'").groupBy(F.col("_metadata.file_name")).count().collect()
    assert sum(r["count"] for r in written) == n and max(r["count"] for r in written) == 40


def test_a_row_gets_its_own_payload_only(spark):
    from tracelens.demo import ledger

    rows = ledger._rows(spark, "/root/testdata/sf0.001")
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").collect()
    told = {r.row_pk: r.data for r in rows.select("row_pk", "data").collect()}
    for o in orders:
        paise = int(decimal.Decimal(str(o.o_totalprice * 100)).quantize(decimal.Decimal(1), decimal.ROUND_HALF_UP))
        assert told[o.o_orderkey] == ledger._SHAPES[o.o_orderkey % 6].replace("#", str(o.o_orderkey)).replace("~", str(o.o_custkey)).replace("^", str(paise))
    # no other shape's text is made for it
    plan = rows.select("data")._jdf.queryExecution().optimizedPlan().toString()
    assert "replace(" not in plan and "array(" not in plan
