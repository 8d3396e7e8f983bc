"""The counterparty graph: a node for each contact, phonebook entry, and party that only payments or chats know."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracelens.functions.money import is_success
from tracelens.functions.values import filled, first_filled, is_true
from tracelens.operators.skew import lookup_join

#: Kinds of node, most trusted first. Fixed values.
CONTACT, UNIDENTIFIED, PHONEBOOK, PAYMENT, CHAT, THREAD = "CONTACT", "CONTACT_UNIDENTIFIED", "PHONEBOOK_ONLY", "TXN_DERIVED", "CHAT_DERIVED", "CHAT_THREAD_ONLY"
NOTE = "no connection id in the thread; counted for the thread, not for a contact"


def first_by(c: str, seq: str = "seq") -> Column:
    """The first not blank value by ``seq``."""
    value = filled(F.col(c))
    return F.min_by(c, F.when(value.isNotNull(), F.struct(F.col(seq), F.col(c).alias("v"))))


def any_true(c: str) -> Column:
    """True if any row says so, else false if any says that, else null."""
    return F.max(F.col(c).cast("boolean"))


def keyed_contacts(contacts: DataFrame) -> DataFrame:
    """Contact rows (seq, phone, vpa, connection, name, on_app, upi_state) with their ``node_id``: phone, else address, else connection; without any, one of its own."""
    return contacts.withColumn("node_id", F.coalesce(filled(F.col("phone")), filled(F.col("vpa")), filled(F.col("connection")), F.concat(F.lit("unidentified::"), F.col("seq").cast("string"))))


def contact_nodes(keyed: DataFrame) -> DataFrame:
    """One node for each key, gaps filled from its later rows; ``on_app`` is true if any row says so, false if any denies it, else unknown."""
    known = F.coalesce(filled(F.col("phone")), filled(F.col("vpa")), filled(F.col("connection"))).isNotNull()
    return keyed.groupBy("node_id").agg(
        F.when(F.max(known), CONTACT).otherwise(UNIDENTIFIED).alias("kind"), *[first_by(c).alias(c) for c in ("name", "phone", "vpa", "connection", "upi_state")], any_true("on_app").alias("on_app"),
    )


def with_phonebook(nodes: DataFrame, phonebook: DataFrame) -> DataFrame:
    """``nodes`` with names of the phonebook (seq, number, name) where they have none, and a node for each number that no node has.

    A node of the phonebook alone does not say that its person is absent from the app: ``on_app`` is null.
    """
    book = phonebook.filter(filled(F.col("number")).isNotNull()).groupBy("number").agg(first_by("name").alias("book_name"), F.min_by("name", F.struct("seq", "name")).alias("first_name"))
    named = lookup_join(nodes, book.select(F.col("number").alias("phone"), "book_name"), "phone")
    filled_in = named.withColumn("name", first_filled(F.col("name"), F.col("book_name"))).drop("book_name")
    lone = book.join(nodes.select(F.col("node_id").alias("number")), "number", "left_anti")
    return filled_in.unionByName(lone.select(F.col("number").alias("node_id"), F.lit(PHONEBOOK).alias("kind"), F.col("first_name").alias("name"), F.col("number").alias("phone")), allowMissingColumns=True)


def _first_node(keyed: DataFrame, key: str) -> DataFrame:
    """(key, node_id): the node of the first contact row with that key."""
    return keyed.filter(filled(F.col(key)).isNotNull()).groupBy(key).agg(F.min_by("node_id", F.struct("seq", "node_id")).alias("_found"))


def attribute_payments(payments: DataFrame, keyed: DataFrame) -> DataFrame:
    """``payments`` (phone, vpa, party_name, ...) with ``node_id`` and ``matched_by``; those that name nobody have null.

    Phones of contacts first; addresses of contacts only for the rest; what is still left makes its own nodes, by phone, by the least phone that
    the same address came with among the rest, by address, by name.  No tier sees what an earlier one has taken.
    """
    blank = lambda c: filled(F.col(c))
    phones = keyed.select(blank("phone").alias("_phone")).filter("_phone is not null").distinct().withColumn("_by_phone", F.lit(True))
    rows = lookup_join(payments.withColumn("_phone", blank("phone")), phones, "_phone")
    by_vpa = _first_node(keyed, "vpa").select(F.col("vpa").alias("_vpa"), F.col("_found").alias("_by_vpa"))
    rows = lookup_join(rows.withColumn("_vpa", F.when(F.col("_by_phone").isNull(), blank("vpa"))), by_vpa, "_vpa")
    left = F.col("_by_phone").isNull() & F.col("_by_vpa").isNull()
    partners = rows.filter(left & blank("phone").isNotNull() & blank("vpa").isNotNull()).groupBy(F.col("vpa").alias("_lone")).agg(F.min("phone").alias("_partner"))
    rows = lookup_join(rows.withColumn("_lone", F.when(left & blank("phone").isNull(), blank("vpa"))), partners, "_lone")
    derived = F.coalesce(blank("phone"), F.col("_partner"), blank("vpa"), blank("party_name"))
    node = F.when(F.col("_by_phone"), F.col("_phone")).otherwise(F.coalesce("_by_vpa", derived))
    by = F.when(F.col("_by_phone"), "phone").when(F.col("_by_vpa").isNotNull(), "vpa").when(derived.isNotNull(), "derived")
    return rows.select(*payments.columns, node.alias("node_id"), by.alias("matched_by"))


def attribute_messages(messages: DataFrame, members: DataFrame, keyed: DataFrame) -> DataFrame:
    """``messages`` (thread, sender_is_self, sender_member, receiver_member, ...) with ``connection``, ``node_id``, ``label`` and ``on_app``.

    ``members``: (seq, group_id, member, connection, display_name, is_self, on_app).  A message goes to the connection of its other member; without one,
    to that of the only other member of its thread; else to the thread.  Names are never keys.  Messages with neither are left out.
    """
    mine = F.col("sender_is_self")
    other = F.when(mine, F.col("receiver_member")).when(~mine, F.col("sender_member"))
    own = members.filter("member is not null").groupBy(F.col("member").alias("_other")).agg(first_by("connection").alias("_connection"), first_by("display_name").alias("_display"), F.min_by("on_app", F.when(F.col("on_app").isNotNull(), F.col("seq"))).alias("_on_app"))
    strangers = members.filter(~is_true(F.col("is_self"))).groupBy(F.col("group_id").alias("thread"))
    solo = strangers.agg(F.count(F.lit(1)).alias("n"), F.min("connection").alias("_solo"), F.min("display_name").alias("_solo_display"), any_true("on_app").alias("_solo_on_app")).filter((F.col("n") == 1) & filled(F.col("_solo")).isNotNull()).drop("n")
    rows = lookup_join(messages.withColumn("_other", other), own, "_other")
    rows = lookup_join(rows, solo, "thread")
    connection = F.coalesce(filled(F.col("_connection")), F.col("_solo"))
    nodes = _first_node(keyed, "connection").withColumnRenamed("_found", "_node")
    rows = lookup_join(rows.withColumn("connection", connection), nodes, "connection")
    node = F.coalesce("_node", F.concat(F.lit("chat::conn::"), F.col("connection")), F.concat(F.lit("chat::thread::"), F.col("thread").cast("string")))
    label = F.coalesce(filled(F.col("_display")), F.col("_solo_display"))
    return rows.select(*messages.columns, "connection", node.alias("node_id"), label.alias("label"), F.coalesce("_on_app", "_solo_on_app").alias("on_app")).filter("node_id is not null")


def counterparty_graph(contacts: DataFrame, phonebook: DataFrame, payments: DataFrame, members: DataFrame, messages: DataFrame) -> DataFrame:
    """All nodes with their payments, chats, dates, evidence and rank ``in + out + messages / 5``.

    ``payments`` also has direction, state, paise, ms; ``messages`` also has is_payment and paise.  Counts are of payments in every state, sums of successful
    ones.  Every contact and every number of the phonebook has a node, whatever else is known of it.  Parts meet as one row for each node and part.
    """
    keyed = keyed_contacts(contacts)
    base = with_phonebook(contact_nodes(keyed), phonebook).withColumn("part", F.when(F.col("kind") == PHONEBOOK, 1).otherwise(0))
    way = lambda d: F.col("direction") == d
    total = lambda d: F.coalesce(F.sum(F.when(way(d) & is_success(F.col("state")), F.col("paise"))), F.lit(0))
    # an address that stands for a known phone has that phone as its node, so only rows that name a key give the node its fields
    flows = attribute_payments(payments, keyed).filter("node_id is not null").groupBy("node_id").agg(
        F.lit(2).alias("part"), F.lit(PAYMENT).alias("kind"), F.min(filled(F.col("party_name"))).alias("name"), F.min(filled(F.col("phone"))).alias("phone"), F.min(filled(F.col("vpa"))).alias("vpa"),
        F.count_if(way("IN")).alias("n_in"), F.count_if(way("OUT")).alias("n_out"), total("IN").alias("paise_in"), total("OUT").alias("paise_out"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"),
    )
    chats = attribute_messages(messages, members, keyed).groupBy("node_id").agg(
        F.lit(3).alias("part"), F.when(F.max("connection").isNull(), THREAD).otherwise(CHAT).alias("kind"), F.coalesce(F.min("label"), F.when(F.max("connection").isNull(), F.min(F.col("thread").cast("string")))).alias("name"),
        F.max("connection").alias("connection"), any_true("on_app").alias("on_app"), F.count(F.lit(1)).alias("n_messages"), F.count_if(is_true(F.col("is_payment"))).alias("n_chat_payments"),
        F.coalesce(F.sum(F.when(F.col("is_payment"), F.col("paise"))), F.lit(0)).alias("paise_chat"),
    )
    parts = base.unionByName(flows, allowMissingColumns=True).unionByName(chats, allowMissingColumns=True)
    # the fields of a node are those of its most trusted part; the others only add what they counted
    lead = lambda c: F.min_by(c, "part").alias(c)
    added = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    seen = lambda n: F.max(F.when(F.col("part") == n, F.lit(True)))
    evidence = F.concat_ws(",", F.when(F.min("part") == 0, "contacts"), F.when(F.min("part") == 1, "phonebook"), F.when(seen(2), "payments"), F.when(seen(3), "chat"))
    nodes = parts.groupBy("node_id").agg(
        *map(lead, ("kind", "name", "phone", "vpa", "connection", "on_app", "upi_state")), *map(added, ("n_in", "n_out", "paise_in", "paise_out", "n_messages", "n_chat_payments", "paise_chat")),
        F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"), evidence.alias("evidence"),
    )
    return nodes.withColumns({"rank": F.col("n_in") + F.col("n_out") + F.col("n_messages") / 5, "note": F.when(F.col("kind") == THREAD, NOTE)})


def graph_summary(nodes: DataFrame) -> DataFrame:
    """Nodes by what is known of them, and threads that belong to nobody."""
    n = F.count_if
    return nodes.agg(
        F.count(F.lit(1)).alias("n_nodes"), n(F.col("n_in") + F.col("n_out") > 0).alias("n_with_payments"), n(F.col("n_messages") > 0).alias("n_with_chat"),
        n(F.col("kind") == THREAD).alias("n_threads_alone"), n(F.col("on_app")).alias("n_on_app"), n(F.col("on_app").isNull()).alias("n_app_unknown"),
    )
