"""Chat rows: groups, members and messages with their parties, cards and the payments they speak of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracelens.functions.identity import is_masked, psp
from tracelens.functions.payload import at, decode_json, kind_at, long_at, text_at
from tracelens.functions.values import filled, first_filled, is_true, tri_bool
from tracelens.operators.skew import lookup_join

#: Card types that ask for money. Fixed values.
MONEY_REQUESTS = ("SETTLEMENT_CARD", "EXPENSE_CARD_V2")


def member_rows(members: DataFrame, topics: DataFrame, people: DataFrame) -> DataFrame:
    """Members with ``is_self``, and name and phone recovered where they are masked or absent.

    ``members``: (seq, member, group_id, connection, app_name, merchant_name, masked_phone, on_app, deleted); ``topics``: (group_id, owner_member), one row each; ``people``: (connection, name, phone), one row each.
    """
    owners = topics.select("group_id", F.col("owner_member").alias("_own"))
    known = people.select("connection", F.col("name").alias("_name"), F.col("phone").alias("_phone"))
    rows = lookup_join(lookup_join(members, owners, "group_id"), known, "connection")
    name, masked = first_filled(F.col("app_name"), F.col("merchant_name")), F.col("masked_phone")
    return rows.select(
        "seq", "member", "group_id", "connection", name.alias("display_name"), "masked_phone", is_true(F.col("member") == F.col("_own")).alias("is_self"), tri_bool(F.col("on_app")).alias("on_app"),
        F.when(is_masked(name) | name.isNull(), F.col("_name")).alias("name_resolved"), F.when(is_masked(masked) | filled(masked).isNull(), F.col("_phone")).alias("phone_full"), F.when(is_true(tri_bool(F.col("deleted"))), "DELETED").otherwise("ACTIVE").alias("state"),
    )


def group_rows(groups: DataFrame, topics: DataFrame, members: DataFrame) -> DataFrame:
    """``groups`` (group_id, ...) with member_count and a name: the topic's, else that of the only other member who has one, else the id.

    ``topics`` also has topic_name; ``members`` as ``member_rows`` makes them.
    """
    named = ~F.col("is_self") & F.col("display_name").isNotNull()
    sizes = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("member_count"), F.count_if(named).alias("_others"), F.min(F.when(named, F.col("display_name"))).alias("_other"))
    rows = lookup_join(lookup_join(groups, topics.select("group_id", "topic_name"), "group_id"), sizes, "group_id")
    name = F.coalesce(filled(F.col("topic_name")), F.when(F.col("_others") == 1, F.col("_other")), F.col("group_id").cast("string"))
    return rows.select(*groups.columns, name.alias("name"), F.coalesce("member_count", F.lit(0)).alias("member_count"))


def card(v: Column) -> Column:
    """paise, payment_id, note, state and utr of a card, wherever its type keeps them; amounts below zero or of another kind are none."""
    whole = lambda path: F.when(long_at(v, path) >= 0, long_at(v, path))
    expense, settled, action = "expenseInfo.expenseCard", "settlementInfo", "groupAction"
    settlement = F.coalesce(F.when(long_at(v, f"{settled}.totalAmount") != 0, whole(f"{settled}.totalAmount")), whole(f"{settled}.globalSettlementAmount"), whole(f"{settled}.totalAmount"))
    said = text_at(v, f"{action}.actionType")
    done = F.coalesce(F.when(text_at(v, f"{action}.name").isNotNull(), F.concat_ws(": ", F.coalesce(said, F.lit("None")), text_at(v, f"{action}.name"))), said)
    return F.struct(
        F.coalesce(whole("amount"), whole("transactionUnit.value"), whole(f"{expense}.cardInfo.totalAmount"), settlement).alias("paise"),
        text_at(v, "transactionId", f"{expense}.expenseId", f"{settled}.globalSettlementId").alias("payment_id"), F.coalesce(text_at(v, f"{expense}.cardInfo.name"), done).alias("note"),
        text_at(v, "state", "paymentState", f"{expense}.status", f"{settled}.status").alias("state"), at(v, "utr").alias("utr"),
    )


def message_rows(messages: DataFrame, topics: DataFrame, members: DataFrame) -> DataFrame:
    """Messages with card, both parties, direction and the other party, masked names and phones recovered.

    ``messages``: (message_id, group_id, kind, created_ms, deleted, source_member, content), content as JSON whose card may lie under ``content``; ``members`` as ``member_rows`` makes them, of a member in several groups the first by seq.
    Sender and receiver are told apart by the owner's member id of the topic; without it the direction is unknown.
    """
    outer = messages.withColumn("_content", decode_json(F.col("content")))
    nested = kind_at(F.col("_content"), "content").startswith("OBJECT")
    ready = outer.withColumn("_card", F.when(is_true(nested), F.try_variant_get("_content", "$.content", "variant")).when(F.schema_of_variant("_content").startswith("OBJECT"), F.col("_content")))
    v = F.col("_card")
    ready = ready.withColumns({"sender_member": first_filled(at(F.col("_content"), "source.groupMemberId"), F.col("source_member").cast("string")), "receiver_member": text_at(v, "destination.groupMemberId"), "card": card(v)})
    who = F.struct("display_name", "name_resolved", "masked_phone", "phone_full")
    dim = members.filter("member is not null").groupBy(F.col("member").cast("string").alias("m")).agg(F.min_by(who, F.struct("seq", "group_id")).alias("who"))
    rows = lookup_join(ready, topics.select("group_id", F.col("owner_member").cast("string").alias("_own"), "topic_name"), "group_id")
    for side in ("sender", "receiver"):
        rows = lookup_join(rows, dim.select(F.col("m").alias(f"{side}_member"), F.col("who").alias(side)), f"{side}_member")
    sender, receiver = F.coalesce("sender.display_name", text_at(v, "sender.name")), F.coalesce("receiver.display_name", text_at(v, "receiver.name"))
    mine = F.col("sender_member") == F.col("_own")
    other = lambda out, back: F.when(mine, out).when(~mine, back)
    masked = other(F.col("receiver.masked_phone"), F.col("sender.masked_phone"))
    name = other(receiver, sender)
    return rows.select(
        "message_id", "group_id", "kind", "topic_name", F.coalesce("created_ms", long_at(v, "createdAt")).alias("created_ms"), (~is_true(tri_bool(F.col("deleted")))).alias("visible"), "card.*", F.when(F.col("kind") == "TEXT_MESSAGE", at(v, "message")).alias("text"),
        "sender_member", "receiver_member", sender.alias("sender_name"), receiver.alias("receiver_name"), mine.alias("sender_is_self"), other(F.lit("OUT"), F.lit("IN")).alias("_way"), name.alias("other_name"), masked.alias("other_phone"),
        F.when(is_masked(name) | filled(name).isNull(), other(F.col("receiver.name_resolved"), F.col("sender.name_resolved"))).alias("other_resolved"), F.when(is_masked(masked), other(F.col("receiver.phone_full"), F.col("sender.phone_full"))).alias("other_phone_full"),
    ).withColumn("direction", F.coalesce("_way", F.lit("UNKNOWN"))).drop("_way")


def thread_summary(messages: DataFrame) -> DataFrame:
    """Messages, payment cards and their sum, texts, and cards that ask for money."""
    pay = F.col("kind") == "PAYMENT_INFO_CARD"
    return messages.agg(
        F.count(F.lit(1)).alias("n_messages"), F.count_if(pay).alias("n_payment_cards"), F.coalesce(F.sum(F.when(pay, F.col("paise"))), F.lit(0)).alias("paise"), F.count_if(F.col("kind") == "TEXT_MESSAGE").alias("n_texts"), F.count_if(F.col("kind").isin(*MONEY_REQUESTS)).alias("n_requests"),
    )


def routed(messages: DataFrame, payments: DataFrame) -> DataFrame:
    """``messages`` (payment_id, direction, ...) beside the payment they name, with address, app and handle of the owner's and of the other side.

    ``payments``: (id, global_id, sender_vpa, receiver_vpa, sender_app_label, receiver_app_label, classification, state); an id of several payments leads to the least.
    """
    facts = F.struct("id", "sender_vpa", "receiver_vpa", "sender_app_label", "receiver_app_label", "classification", "state")
    by_id = payments.select(F.explode(F.array_distinct(F.filter(F.array("id", "global_id"), lambda x: filled(x).isNotNull()))).alias("payment_id"), facts.alias("p")).groupBy("payment_id").agg(F.min("p").alias("p"))
    rows = lookup_join(messages, by_id, "payment_id")
    out = F.col("direction") == "OUT"
    pick = lambda a, b: F.when(F.col("p").isNotNull(), F.when(out, F.col(f"p.{a}")).otherwise(F.col(f"p.{b}")))
    owner, other = pick("sender_vpa", "receiver_vpa"), pick("receiver_vpa", "sender_vpa")
    return rows.select(
        *messages.columns, F.col("p.classification").alias("classification"), F.col("p.state").alias("payment_state"), owner.alias("owner_vpa"), pick("sender_app_label", "receiver_app_label").alias("owner_app"), psp(owner).alias("owner_psp"),
        other.alias("counterparty_vpa"), pick("receiver_app_label", "sender_app_label").alias("counterparty_app"), psp(other).alias("counterparty_psp"),
    )
