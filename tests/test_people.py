"""The payment builder, contacts and chats on odd rows."""

from tracelens.functions import classify as rules
from tracelens.operators import builder, contacts, threads
from tracelens.operators.skew import dim_join

ROWS = "entity_id string, global_id string, type string, state string, created string, error string, data string, row_pk long"


def ledger(spark):
    rows = [
        ("b", "g1", "P2P_ENRICHMENT", "S", "5", None, "{}", 1), ("a", "g1", "P2P_ENRICHMENT", "S", "5", None, "{}", 2), ("z", "g1", "SENT_PAYMENT", "ERRORED", "5", "E7", "[1]", 3), ("z", "g1", "SENT_PAYMENT", "ERRORED", "5", "E7", "[1]", 4),
        ("c", "", "EXTERNAL_PAYMENT", None, None, None, None, 5), ("d", None, "NEW_TYPE", "", "x", None, '{"requester":{"type":"USER"},"to":{"name":"T"}}', 6), (None, None, "SYMPHONY", None, None, None, "{}", 7), (None, None, "SYMPHONY", None, None, None, "{}", 8),
    ]
    return spark.createDataFrame(rows, ROWS)


def test_one_row_stands_for_a_payment(spark):
    rows = ledger(spark)
    assert {(r.payment_key, r.entity_id, r.row_pk, r.n_aliases) for r in builder.canonical_rows(rows).collect()} == {("g1", "z", 3, 3), ("c", "c", 5, 0), ("d", "d", 6, 0), (None, None, 7, 1)}
    assert {(r.alias, r.row_pk, r.canonical, r.canonical_type) for r in builder.alias_rows(rows).collect()} == {("b", 1, "z", "SENT_PAYMENT"), ("a", 2, "z", "SENT_PAYMENT"), ("z", 4, "z", "SENT_PAYMENT")}
    assert {(r.id, r.primary) for r in builder.id_map(rows).collect()} == {("g1", "z"), ("a", "z"), ("b", "z"), ("z", "z"), ("c", "c"), ("d", "d")}
    assert builder.canonical_rows(rows.limit(0)).count() == 0


def test_payments_of_unreadable_payloads(spark):
    none = spark.createDataFrame([], "handle string, app_title string")
    banks = spark.createDataFrame([], "bank_id string, bank_name string, ifsc_prefix string")
    handles = rules.handle_dimension(none, banks, spark.createDataFrame([], "handle string"))
    canonical = builder.canonical_rows(ledger(spark))
    got = {r.id: r for r in builder.build_payments(canonical, handles, banks).collect()}
    assert set(got) == {"z", "c", None}
    z = got["z"]
    assert (z.state, z.failure_reason, z.direction, z.paise, z.ms, z.classification, z.sender_app_label, z.bank_name, z.note) == ("FAILED", "E7", "SENT", 0, 5000, "OTHER", "No VPA", "", "")
    assert (got["c"].state, got["c"].direction, got["c"].ms) == ("UNKNOWN", "SERVICE", None)
    requests = {r.id: (r.name, r.paise, r.requester_type) for r in builder.build_requests(canonical).collect()}
    assert requests == {"d": ("T", 0, "USER")}


def test_dimensions_beyond_the_limit_are_looked_up(spark):
    facts = spark.createDataFrame([(1, "a"), (2, None), (3, "zz")], "id int, k string")
    dim = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    for most in (2, 1):
        joined = dim_join(facts, dim, "k", most)
        assert sorted((r.id, r.v) for r in joined.select("id", "v").collect()) == [(1, 1), (2, None), (3, None)]
    assert "BroadcastHashJoin" in plan(dim_join(facts, dim, "k", 2))


def test_chat_links_prefer_the_smallest_group(spark):
    people = spark.createDataFrame([("a",), ("b",), (None,), ("c",)], "connection string")
    members = spark.createDataFrame([(1, 10, "a", False), (2, 11, "a", False), (3, 12, "a", None), (4, 13, "b", True), (5, 14, "c", False), (6, 15, "c", False), (7, None, "b", False)], "seq long, group_id long, connection string, is_self boolean")
    groups = spark.createDataFrame([(10, 5), (11, 2), (12, 2), (14, 0), (15, 98)], "group_id long, size long")
    assert {(r.connection, r.chat_group) for r in contacts.chat_links(people, members, groups).collect()} == {("a", 11), ("b", None), (None, None), ("c", 15)}


def test_people_keep_what_rows_say(spark):
    rows = spark.createDataFrame([(1, "s", "k", "90", None, None, None, True, "A"), (2, "s", "k", "91", None, None, None, False, None), (3, "s", None, "90", None, None, None, None, "B"), (4, "s", None, None, None, None, None, None, None), (4, "t", " ", "", "", None, None, None, None)],
                                 "seq long, source string, connection string, phone string, vpa string, name string, bank_name string, on_app boolean, upi_state string")
    assert [tuple(r) for r in contacts.contradictions(rows).collect()] == [("k", "on_app", "false,true", "90,91")]
    assert {(r.seq, r.source): (r.person, r.n_rows) for r in contacts.with_row_counts(rows).collect()} == {(1, "s"): ("k", 2), (2, "s"): ("k", 2), (3, "s"): ("90", 1), (4, "s"): ("s#4", 1), (4, "t"): ("t#4", 1)}


def test_messages_without_cards_or_parties(spark):
    topics = spark.createDataFrame([(1, 5, "T")], "group_id long, owner_member long, topic_name string")
    members = threads.member_rows(
        spark.createDataFrame([(1, 5, 1, None, "Me", None, None, "1", None), (2, 6, 1, "k", "", "Shop", "**6", None, "1")], "seq long, member long, group_id long, connection string, app_name string, merchant_name string, masked_phone string, on_app string, deleted string"),
        topics, spark.createDataFrame([("k", "Real", "96")], "connection string, name string, phone string"),
    )
    assert {r.member: (r.display_name, r.is_self, r.name_resolved, r.phone_full, r.state) for r in members.collect()} == {5: ("Me", True, None, None, "ACTIVE"), 6: ("Shop", False, None, "96", "DELETED")}
    said = [(k, g, "TEXT_MESSAGE", None, None, m, c) for k, (g, m, c) in enumerate([(1, 6, '{"message":"hi"}'), (1, None, "no json"), (2, 6, None), (1, 5, '{"content":"x","amount":-1}'), (None, 9, "[1]")])]
    rows = {r.message_id: (r.direction, r.other_name, r.text, r.paise) for r in threads.message_rows(spark.createDataFrame(said, "message_id long, group_id long, kind string, created_ms long, deleted string, source_member long, content string"), topics, members).collect()}
    assert rows == {0: ("IN", "Shop", "hi", None), 1: ("UNKNOWN", None, None, None), 2: ("UNKNOWN", None, None, None), 3: ("OUT", None, None, None), 4: ("UNKNOWN", None, None, None)}
    assert [(r.name, r.member_count) for r in threads.group_rows(spark.createDataFrame([(1,), (3,)], "group_id long"), topics, members).orderBy("group_id").collect()] == [("T", 2), ("3", 0)]
