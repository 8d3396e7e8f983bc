"""Pages, filters, enrichment and exports on hand-made tables."""

import collections
import random

import pytest
from pyspark.sql import Observation, functions as F

from tracelens.operators import enrich, exports, views
from tracelens.operators.skew import lookup_join
from tracelens.sources.files import file_inventory


def test_pages_by_key_cover_the_table_once(spark):
    draw = random.Random(5)
    rows = [(k, draw.choice([None, 1, 2, 3]), draw.choice([None, "a", "b"])) for k in range(57)]
    df = spark.createDataFrame(rows, "id long, n int, s string").repartition(4)
    keys = [("n", True), ("s", False), ("id", True)]
    null_last = lambda v, down: (v is None, 0 if v is None else -v if down else v) if not isinstance(v, str) else (False, v)
    whole = sorted(rows, key=lambda r: (null_last(r[1], True), (r[2] is None, r[2] or ""), -r[0]))
    seen, after = [], None
    while True:
        page = sorted(views.key_page(df, keys, 10, after).collect(), key=lambda r: whole.index((r.id, r.n, r.s)))
        seen += [(r.id, r.n, r.s) for r in page]
        assert len({r.has_more for r in page}) == 1
        if not page[0].has_more:
            break
        after = (page[-1].n, page[-1].s, page[-1].id)
    assert seen == whole
    assert views.key_page(df.limit(0), keys, 10).count() == 0 and views.key_page(df, keys, 99_999).count() == 57


def test_counts_of_a_view_are_of_the_whole_table(spark):
    df = spark.range(100).select(F.col("id"), (F.col("id") % 3).alias("kind"))
    wanted, order, seen = F.col("kind") == 1, [F.col("id").desc()], Observation()
    rows = views.counted_view(df, wanted, order, 5).collect()
    assert [r.id for r in rows] == [97, 94, 91, 88, 85] and {(r.total, r.matched, r.truncated) for r in rows} == {(100, 33, True)}
    assert [r.id for r in views.observed_view(df, wanted, order, 5, seen).collect()] == [97, 94, 91, 88, 85]
    assert seen.get == {"total": 100, "matched": 33}
    assert {r.truncated for r in views.counted_view(df, wanted, order, 33).collect()} == {False}


def test_criteria_fail_on_nulls(spark):
    from datetime import date

    df = spark.createDataFrame([(1, "IN", "Low x", None, None, "p"), (2, None, "LOW", 5, 19_800_000, "P7"), (3, "in", None, 9, 86_399_999, None)], "id long, direction string, type string, paise long, ms long, party string")
    ids = lambda **k: [r.id for r in df.filter(views.payment_tests(df, **k)).orderBy("id").collect()]
    assert ids() == [1, 2, 3] and ids(equal={"direction": "In"}) == [1, 3] and ids(part={"type": "LOW"}) == [2] and ids(least=5, most=8) == [2]
    # 05:30 of the second row is the next day in a zone half an hour further
    assert ids(first=date(1970, 1, 1), last=date(1970, 1, 1)) == [2, 3] and ids(first=date(1970, 1, 2), zone="Asia/Kolkata") == [3]
    assert ids(text="paise") == [1, 2, 3] and ids(anywhere=(["party", "type"], "p")) == [1, 2] and ids(either=(["party", "type"], "LOW")) == [2]
    assert [r.id for r in views.filter_table(df, " LOW ", {"party": "7"}).collect()] == [2] and views.filter_table(df, None, {"absent": "x"}).count() == 0


def test_lookup_join_is_a_left_join(spark):
    facts = spark.createDataFrame([(1, "a"), (2, None), (2, None), (3, "z"), (None, "b")], "id int, key string")
    dim = spark.createDataFrame([("a", 1.5), ("b", None), (None, 9.0)], "key string, v double")
    assert sorted(map(tuple, lookup_join(facts, dim, "key").select("id", "key", "v").collect()), key=str) == sorted([(1, "a", 1.5), (2, None, None), (2, None, None), (3, "z", None), (None, "b", None)], key=str)
    numbers = lookup_join(facts, spark.createDataFrame([(1, "x")], "id long, w string"), "id")
    assert numbers.filter("w = 'x'").count() == 1 and numbers.count() == 5


FIELDS = "id string, global_id string, data_source string, direction string, name string, connection string, verified string, cbs string, phone string, note string, saved string"


def fill(payments, messages, conversations, contacts, book):
    """The same by a loop over the payments, counting what each source fills."""
    chat, group = {}, {}
    for seq, ids, gid, *entry in sorted(messages, key=lambda m: m[0]):
        for i in ids:
            if i and i.strip():
                chat.setdefault(i, entry)
                if gid is not None:
                    group.setdefault(i, gid)
    ok = lambda v: bool(v and v.strip())
    tails = {}
    for p in sorted(payments, key=lambda p: p["id"]):
        if p["data_source"] == "ledger" and ok(p["phone"]) and ok(p["cbs"]):
            tails.setdefault(p["phone"][-4:], p["cbs"])
    counts, out = collections.Counter(), {}
    for p in map(dict, payments):
        entry = next((chat[i] for i in (p["id"], p["global_id"]) if i in chat), None)
        gid = group.get(p["id"]) if p["id"] in group else group.get(p["global_id"])
        conv = conversations.get(gid, {}) if gid is not None else {}
        way, other, masked, note = entry or (None,) * 4

        def put(field, tiers, p=p):
            if not ok(p[field]):
                p[field] = None
                for tier, v in tiers:
                    if ok(v):
                        p[field] = v
                        counts[field, tier] += 1
                        return

        if p["direction"] not in ("RECEIVED", "SENT"):
            p["direction"] = None
            put("direction", [("chat", {"IN": "RECEIVED", "OUT": "SENT"}.get((way or "").upper()))])
        put("name", [("chat", other), ("conversation", conv.get("display_name"))])
        put("connection", [("conversation", conv.get("connection"))])
        put("phone", [("conversation", conv.get("phone")), ("member", conv.get("member_phone")), ("masked member", conv.get("masked_phone")), ("masked chat", masked)])
        whole = p["phone"] if p["phone"] and "*" not in p["phone"] else None
        known = contacts.get(whole, (None, None)) if whole else (None, None)
        put("verified", [("conversation", conv.get("verified")), ("contact", known[0])])
        put("cbs", [("conversation", conv.get("cbs")), ("contact", known[1]), ("same tail", tails.get(whole[-4:]) if whole else None)])
        put("note", [("chat", note.strip() if note else None)])
        put("saved", [("phonebook", book.get(whole) if whole else None)])
        out[p["id"]] = p
    return out, counts


def test_enrichment_equals_a_loop(spark):
    draw = random.Random(21)
    names = FIELDS.replace(" string", "").split(", ")
    some = lambda *v: draw.choice([None, None, "", *v])
    phones = [f"9{k:09d}" for k in (11, 22, 1022, 3011)]
    payments = [dict(zip(names, (f"p{k}", f"g{draw.randint(0, 60)}", draw.choice(["ledger", "card"]), draw.choice(["SENT", "RECEIVED", "UNKNOWN", None]), some("N"), some("c1"), some("V"), some(f"B{k}"), some(*phones, "****11"), some("note"), some("S")))) for k in range(120)]
    messages = [(k, [draw.choice([None, "", f"p{draw.randint(0, 130)}"]), f"g{draw.randint(0, 70)}"], draw.choice([None, *range(12)]), some("in", "OUT"), some("Chat"), some("****77"), some("  said ")) for k in range(90)]
    conversations = {g: {"connection": some("cc"), "verified": some("CV"), "cbs": some("CB"), "display_name": some("CD"), "phone": some(*phones), "member_phone": some(*phones), "masked_phone": some("****22")} for g in range(9)}
    contacts, book = {phones[0]: ("PV", None), phones[2]: (None, "PC")}, {phones[1]: "Saved", phones[2]: ""}
    want, counts = fill(payments, messages, conversations, contacts, book)
    tables = [
        spark.createDataFrame([tuple(p[n] for n in names) for p in payments], FIELDS), spark.createDataFrame(messages, "seq long, ids array<string>, group_id long, way string, other_name string, other_phone string, note string"),
        spark.createDataFrame([(g, *c.values()) for g, c in conversations.items()], "group_id long, connection string, verified string, cbs string, display_name string, phone string, member_phone string, masked_phone string"),
        spark.createDataFrame([(k, *v) for k, v in contacts.items()], "phone string, verified string, cbs string"), spark.createDataFrame(list(book.items()), "phone string, name string"),
    ]
    rich = enrich.enrich_payments(*tables)
    got = {r.id: r for r in rich.collect()}
    assert len(got) == len(payments)
    for i, p in want.items():
        assert {f: got[i][f] for f in enrich.FIELDS} == {f: p[f] for f in enrich.FIELDS}, i
    assert {(r.field, r.tier): r.n for r in enrich.patch_counts(rich, enrich.FIELDS).collect()} == dict(counts)
    seen = Observation()
    enrich.observed(rich, enrich.FIELDS, seen).collect()
    assert seen.get == {f: sum(n for (field, _), n in counts.items() if field == f) for f in enrich.FIELDS}


def test_label_levels(spark):
    groups = spark.createDataFrame([(1, "Club"), (2, "***12"), (3, "***12"), (4, ""), (5, "***12"), (6, None), (7, None), (8, None), (9, "12*a")], "group_id long, name string")
    talk = spark.createDataFrame([(3, "c3", None, None, None), (4, None, None, "94", None), (6, None, "Disp", None, "**6"), (7, None, None, None, "**7"), (2, None, None, "92", None)], "group_id long, connection string, display_name string, phone string, masked_phone string")
    paid = spark.createDataFrame([("p2", 2, "**", "k2"), ("p1", 2, None, None), ("p9", 4, "99", None)], "id string, group_id long, phone string, cluster string")
    clusters = spark.createDataFrame([("k2", "(unknown)"), ("k3", "Cluster name")], "cluster string, display_name string")
    found = enrich.label_groups(groups, talk, paid, clusters, spark.createDataFrame([("cid:c3", "k3"), ("ph:94", "k4")], "identifier string, cluster string"), spark.createDataFrame([("92", "Book")], "phone string, name string"))
    assert {r.group_id: (r.label, r.label_by, r.cluster) for r in found.collect()} == {
        1: ("Club", "group", None), 2: ("Book", "phonebook", "k2"), 3: ("Cluster name", "cluster", "k3"), 4: ("94", "phone", "k4"), 5: ("***12", "masked name", None),
        6: ("Disp", "member", None), 7: ("**7", "masked phone", None), 8: (None, None, None), 9: ("12*a", "group", None),
    }


def test_exports_are_whole_or_absent(spark, tmp_path):
    df = spark.createDataFrame([(1, '=a "q"', "x\ny"), (2, "", None), (3, None, "-5")], "id long, name string, note string")
    path = str(tmp_path / "out")
    exports.write_export(df, path, ["id", "name", "note", "gone"], "all")
    assert exports.read_manifest(spark, path).first().n_rows == 3
    assert {r.id: (r.name, r.gone) for r in exports.read_export(spark, path).collect()}["1"] == ('\'=a "q"', None)
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        exports.write_export(df, path, ["id"], "all")
    df.write.csv(f"{path}/data", mode="append")
    with pytest.raises(ValueError, match="differ"):
        exports.read_export(spark, path)
    half = str(tmp_path / "half")
    df.write.csv(f"{half}/data")
    with pytest.raises(FileNotFoundError):
        exports.read_export(spark, half)
    exports.write_catalog({"one": (df, ["id"]), "two": (df, ["name"])}, str(tmp_path / "all"), "json")
    assert exports.read_export(spark, str(tmp_path / "all/two")).columns == ["name"]
    raw = exports.with_raw(df.select("id", "name"), spark.createDataFrame([(1, "d")], "id long, decoded string"), "id")
    assert {r.summary.id: r.raw and r.raw.decoded for r in raw.collect()} == {1: "d", 2: None, 3: None}


def test_root_depends_on_every_file(spark):
    files = spark.range(300).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"), F.col("id").alias("length"), F.col("id").cast("string").cast("binary").alias("content"))
    listed = file_inventory(files)
    root = lambda df: exports.manifest_root(df).first()
    one = root(listed)
    assert (one.n_files, one.root) == (300, root(listed.repartition(7)).root)
    assert one.root != root(listed.filter("path <> 'f7'")).root and root(listed.limit(0)).n_files == 0
    assert one.root != root(listed.withColumn("sha256", F.when(F.col("path") == "f7", "0").otherwise(F.col("sha256")))).root


def test_notifications_are_decoded_once(spark):
    from tracelens.demo.queries import QUERIES
    import tracelens.demo.lists  # noqa: F401

    plan = QUERIES["notifications_view"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "placements" not in plan and "parse_json" not in plan
