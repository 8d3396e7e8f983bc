"""Corroboration, conversations and the graph on small hand-made tables."""

import random

from tracelens.operators import chats, evidence, graph

REF = "ids array<string>, kind string, ms long, paise long, party string"


def union_find(records):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for ids, *_ in records:
        for i in ids:
            a, b = sorted((root(ids[0]), root(i)))
            up[b] = a
    return root


def test_folding_equals_a_union_find(spark):
    draw = random.Random(8)
    sources = {name: [] for name in ("ledger", "chat", "rewards")}
    for _ in range(300):
        ids = [draw.choice([f"i{draw.randint(0, 250)}", f"c{draw.randint(0, 9)}-{draw.randint(0, 40)}", "", None]) for _ in range(draw.randint(1, 4))]
        kind = draw.choice(["ledger_row", "split_expense", "chat_receipt", None])
        sources[draw.choice(list(sources))].append((ids, kind, draw.choice([None, draw.randint(0, 99)]), draw.choice([None, draw.randint(1, 9)]), draw.choice([None, "x", "y"])))
    # a chain that only the last record closes, and records without any id
    sources["chat"] += [([f"z{k}", f"z{k + 1}"], "chat_receipt", None, None, None) for k in range(40)] + [([], "chat_receipt", 1, 1, "x"), ([None, " "], "chat_receipt", 1, 1, "x")]
    kept = [([i for i in dict.fromkeys(ids) if i and i.strip()], *rest, name, place) for place, (name, rows) in enumerate(sources.items()) for ids, *rest in rows]
    kept = [r for r in kept if r[0]]
    root = union_find(kept)
    expected = {}
    for ids, kind, ms, paise, party, name, place in kept:
        e = expected.setdefault(root(ids[0]), {"sources": set(), "kinds": set(), "ids": set(), "n": 0, "ms": [], "paise": [], "party": []})
        order = (place, 2**62 if ms is None else ms, ids[0])
        e["sources"].add(name), e["kinds"].add(kind), e["ids"].update(ids)
        e["n"] += 1
        e["ms"] += [ms] if ms is not None else []
        e["paise"] += [(order, paise)] if paise is not None else []
        e["party"] += [(order, party)] if party is not None else []
    first = lambda rows: min(rows)[1] if rows else None
    want = {
        min(e["ids"]): (len(e["sources"]), ",".join(sorted(e["sources"])), ",".join(sorted(k for k in e["kinds"] if k)), bool(e["kinds"] & set(evidence.PAYMENT_KINDS)), e["n"], min(e["ms"], default=None), first(e["paise"]), first(e["party"]), len(e["ids"]))
        for e in expected.values()
    }
    got = evidence.corroborate({k: spark.createDataFrame(v, REF) for k, v in sources.items()})
    assert {r.entity: tuple(r)[1:] for r in got.collect()} == want
    # two ids of one record never give two entities
    whole = {r.id: r.entity for r in evidence.alias_entities(spark.createDataFrame([(r[0],) for r in kept], "ids array<string>")).collect()}
    assert all(len({whole[i] for i in r[0]}) == 1 for r in kept)


def test_missing_payments_by_window(spark):
    ledger = spark.createDataFrame([(["a"], "ledger_row", 50, 1, None), (["b"], "ledger_row", None, 1, None)], REF)
    chat = spark.createDataFrame([(["a"], "chat_receipt", 60, 1, None), (["c"], "chat_receipt", 60, 1, None), (["d"], "chat_receipt", 40, 1, None), (["e"], "chat_receipt", None, 1, None), (["f"], "split_expense", 60, 1, None)], REF)
    index = evidence.corroborate({"ledger": ledger, "chat": chat})
    rows = {r.entity: (r.verdict, r.severity) for r in evidence.missing_payments(index, ledger, "ledger").collect()}
    assert rows == {"c": ("inside window", "high"), "d": ("before window", "low"), "e": ("undated", "medium")}
    undated = evidence.missing_payments(index, ledger.filter("ms is null"), "ledger")
    assert {r.verdict for r in undated.collect()} == {"no ledger dates", "undated"}
    assert evidence.corroborate({"ledger": ledger.limit(0)}).count() == 0
    assert [r.entity for r in evidence.ranked(index).collect()][:2] == ["a", "f"]


MEMBER = "group_id long, seq long, connection string, display_name string, masked_phone string, deleted boolean"


def test_owner_and_counterparty(spark):
    rows = [
        (1, 0, "own", "Me", "XX1", False), (1, 1, "p", "P", "XX2", True), (1, 2, "q", "Q", None, None),
        (2, 0, None, "Me", "XX1", False), (2, 1, "q", "Q", None, False),  # the owner by masked phone
        (3, 0, "own", "Me", "XX1", False),  # nobody else
        (4, 0, "own", "Me", "XX1", False), (4, 1, None, "M", "XX1", False),  # all are the owner: the one whose connection differs
        (5, 0, "r", "R", "XX5", False), (5, 1, "own", "Me", "XX1", False), (5, 2, "s", "S", "", False),
        (1, 0, "own", "Me", "XX1", False),  # a repeated row
    ]
    members, groups = spark.createDataFrame(rows, MEMBER), spark.createDataFrame([(k, f"g{k}") for k in range(1, 7)], "group_id long, name string")
    people = spark.createDataFrame([("p", "91", "Pat"), ("q", None, "Quin"), ("r", "92", None)], "connection string, phone string, name string")
    got = {r.group_id: (r.n_members, r.other_connection, r.other_display_name, r.other_phone, r.is_group, r.owner_present) for r in chats.conversations(groups, members, people).collect()}
    assert got == {
        1: (3, "p", "P", "91", True, True), 2: (2, "q", "Q", None, False, True), 3: (1, "own", "Me", None, False, True),
        4: (2, None, "M", None, False, True), 5: (3, "r", "R", "92", True, True), 6: (0, None, None, None, False, False),
    }
    assert {tuple(r) for r in chats.member_phones(members, people).collect()} == {(1, "91"), (5, "92")}


def test_most_frequent_counts_groups_and_breaks_ties(spark):
    df = spark.createDataFrame([(1, "b"), (1, "b"), (1, "b"), (2, "a"), (3, "a"), (2, "c"), (3, "c"), (4, None), (5, None), (6, None)], "group_id long, key string")
    assert spark.range(1).select(chats.most_frequent(df, "group_id", "key").alias("k")).first().k == "a"
    assert spark.range(1).select(chats.most_frequent(df.limit(0), "group_id", "key").alias("k")).first().k is None


def test_graph_by_hand(spark):
    contacts = spark.createDataFrame(
        [(1, "90", "a@x", None, " ", None, None), (2, "90", "b@x", "k1", "Ann", False, "S"), (3, "90", None, "k9", "Zed", True, "T"), (4, "", "c@x", None, None, False, None), (5, None, None, "k2", "Kim", None, None), (6, None, "", None, "One", None, None), (7, None, None, None, "Two", None, None), (8, "91", None, None, None, None, None)],
        "seq long, phone string, vpa string, connection string, name string, on_app boolean, upi_state string",
    )
    book = spark.createDataFrame([(1, "91", None), (2, "91", "Bob"), (3, "92", None), (4, "92", "Late"), (5, None, "Nobody"), (6, "90", "Other")], "seq long, number string, name string")
    paid = spark.createDataFrame(
        [(1, "90", "c@x", "n", "IN", "COMPLETED", 10, 5), (2, None, "a@x", "n", "OUT", "FAILED", 20, 3), (3, "77", "c@x", "n", "OUT", "COMPLETED", 30, 9), (4, "88", "w@y", "Wes", "IN", "COMPLETED", 40, 1), (5, None, "w@y", None, "IN", "PENDING", 50, 2),
         (6, None, None, "Kim", "OUT", "COMPLETED", 60, None), (7, None, " ", "", "OUT", "COMPLETED", 70, 4), (8, "92", None, None, "OUT", "COMPLETED", 80, 6), (9, None, "lone@y", None, "IN", "COMPLETED", 90, 7)],
        "id long, phone string, vpa string, party_name string, direction string, state string, paise long, ms long",
    )
    members = spark.createDataFrame(
        [(1, 1, 11, "own", "Me", True, None), (2, 1, 12, "k1", "Ann", False, True), (3, 2, 21, None, "Me", True, None), (4, 2, 22, "k7", "New", False, False), (5, 3, 31, None, "X", False, None), (6, 3, 32, None, "Y", False, None)],
        "seq long, group_id long, member long, connection string, display_name string, is_self boolean, on_app boolean",
    )
    said = spark.createDataFrame(
        [(1, True, 11, 12, False, 1), (1, False, 12, 11, True, 500), (2, None, None, None, False, 1), (3, False, 31, None, True, 7), (None, None, None, None, False, 1)],
        "thread long, sender_is_self boolean, sender_member long, receiver_member long, is_payment boolean, paise long",
    )
    nodes = {r.node_id: r for r in graph.counterparty_graph(contacts, book, paid, members, said).collect()}
    assert {k: r.kind for k, r in nodes.items()} == {
        "90": "CONTACT", "c@x": "CONTACT", "k2": "CONTACT", "unidentified::6": "CONTACT_UNIDENTIFIED", "unidentified::7": "CONTACT_UNIDENTIFIED", "91": "CONTACT", "92": "PHONEBOOK_ONLY",
        "88": "TXN_DERIVED", "Kim": "TXN_DERIVED", "lone@y": "TXN_DERIVED", "chat::conn::k7": "CHAT_DERIVED", "chat::thread::3": "CHAT_THREAD_ONLY",
    }
    ann = nodes["90"]
    assert (ann.name, ann.vpa, ann.connection, ann.on_app, ann.upi_state, ann.n_in, ann.n_out, ann.paise_in, ann.paise_out, ann.first_ms, ann.last_ms) == ("Ann", "a@x", "k1", True, "S", 1, 1, 10, 0, 3, 5)
    assert (ann.n_messages, ann.n_chat_payments, ann.paise_chat, ann.rank, ann.evidence) == (2, 1, 500, 2.4, "contacts,payments,chat")
    assert (nodes["91"].name, nodes["92"].name, nodes["92"].on_app, nodes["c@x"].n_out, nodes["88"].n_in, nodes["c@x"].on_app) == ("Bob", None, None, 1, 2, False)
    assert (nodes["chat::conn::k7"].name, nodes["chat::conn::k7"].on_app, nodes["chat::thread::3"].note) == ("New", False, graph.NOTE)
    assert graph.graph_summary(graph.counterparty_graph(contacts.limit(0), book.limit(0), paid.limit(0), members.limit(0), said.limit(0))).first().n_nodes == 0
