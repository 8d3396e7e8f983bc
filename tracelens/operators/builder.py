"""Payments and requests built from ledger rows with a JSON payload, and the raw records behind them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from tracelens.functions import classify as rules
from tracelens.functions.identity import norm_phone
from tracelens.functions.money import paise_to_inr
from tracelens.functions.payload import Leg, at, decode_json, kind_at, long_at, provenance, text_at
from tracelens.functions.time import ist_text, ledger_ts_ms, utc_text
from tracelens.functions.values import filled
from tracelens.operators.skew import lookup_join

#: Which of several rows of one payment stands for it; other types have 0. Fixed values.
PRIORITY = {
    "SENT_PAYMENT": 100, "RECEIVED_PAYMENT": 100, "PHONE_RECHARGE": 60, "SYMPHONY": 60, "EXTERNAL_PAYMENT": 50, "USER_TO_USER_RECEIVED_REQUEST": 30,
    "RECEIVED_MANDATE_CREATE_REQUEST": 30, "SERVICE_MANDATE_CREATE": 30, "P2P_ENRICHMENT": 10,
}
#: Types that move money; the rest are mandates and requests. Fixed values.
PAYMENT_TYPES = ("SENT_PAYMENT", "RECEIVED_PAYMENT", "PHONE_RECHARGE", "EXTERNAL_PAYMENT", "SYMPHONY")
#: Requests by what they ask for. Fixed values.
AUTOPAY_TYPES, COLLECT_TYPES = ("RECEIVED_MANDATE_CREATE_REQUEST", "SERVICE_MANDATE_CREATE"), ("USER_TO_USER_RECEIVED_REQUEST",)

LEDGER = "ledger"


def _group(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"payment_key": F.coalesce(filled(F.col("global_id")), F.col("entity_id")), "_rank": F.struct(-F.coalesce(rules.mapped(F.col("type"), {k: str(v) for k, v in PRIORITY.items()}).cast("int"), F.lit(0)), F.coalesce("entity_id", F.lit("")), "row_pk")})


def canonical_rows(rows: DataFrame) -> DataFrame:
    """One row for each payment (global id, else entity id): the type of the highest priority, then the least entity id; ``n_aliases`` counts the others.

    ``rows``: (entity_id, global_id, type, state, created, error, data, row_pk).  One aggregate, combined before the shuffle.
    """
    best = _group(rows).groupBy("payment_key").agg(F.min_by(F.struct(*rows.columns), "_rank").alias("r"), (F.count(F.lit(1)) - 1).alias("n_aliases"))
    return best.select("payment_key", "r.*", "n_aliases")


def alias_rows(rows: DataFrame) -> DataFrame:
    """(alias, type, row_pk, canonical, canonical_type, payment_key) of every row that another one stands for."""
    grouped = _group(rows)
    best = grouped.groupBy("payment_key").agg(F.min(F.struct("_rank", F.col("entity_id").alias("id"), F.col("type").alias("t"), F.col("row_pk").alias("pk"))).alias("b"))
    slim = grouped.filter("payment_key is not null").select("payment_key", F.col("entity_id").alias("alias"), "type", "row_pk")
    return slim.join(best, "payment_key").filter("row_pk <> b.pk").select("alias", "type", "row_pk", F.col("b.id").alias("canonical"), F.col("b.t").alias("canonical_type"), "payment_key")


def id_map(rows: DataFrame) -> DataFrame:
    """(id, primary): every entity id, global id and alias with the entity id that stands for it; of an id of several payments the least."""
    canonical = canonical_rows(rows).select(F.col("entity_id").alias("primary"), "payment_key")
    owned = canonical.select(F.explode(F.array("primary", "payment_key")).alias("id"), "primary").unionByName(alias_rows(rows).select(F.col("alias").alias("id"), F.col("canonical").alias("primary")))
    return owned.filter("id is not null").groupBy("id").agg(F.min("primary").alias("primary"))


def _decoded(rows: DataFrame) -> DataFrame:
    ready = rows.withColumn("v", decode_json(F.col("data")))
    return ready.withColumn("v", F.when(F.schema_of_variant("v").startswith("OBJECT"), F.col("v")))


def _party(direction: Column, v: Column) -> dict[str, Column]:
    """The other side's fields, by direction, and both addresses."""
    to, frm, paid, received = Leg(v, "to"), Leg(v, "from", only_object=True), Leg(v, "paidFrom"), Leg(v, "receivedIn")
    sent = direction == "SENT"
    pick = lambda out, back: F.when(sent, out).otherwise(back)
    text = lambda c: F.coalesce(c, F.lit(""))
    theirs = pick(text(to.text("vpa", "fullVpa")), text(frm.text("vpa")))
    return {
        "counterparty_name": pick(text(to.text("name")), text(frm.text("name", "cbsName"))), "counterparty_vpa": theirs, "counterparty_full_vpa": pick(text(to.text("fullVpa", "vpa")), text(frm.text("vpa"))),
        "counterparty_phone": pick(F.coalesce(norm_phone(to.raw("phone")), norm_phone(to.raw("upiNumber"))), norm_phone(frm.raw("phone"))), "counterparty_user_id": pick(to.raw("userId"), frm.raw("userId")),
        "counterparty_cbs_name": F.when(sent, to.text("cbsName", "accountHolderName")).when(direction == "RECEIVED", frm.raw("cbsName")),
        "sender_vpa": pick(text(paid.text("vpa")), theirs), "receiver_vpa": pick(theirs, text(received.text("vpa"))),
        "bank_id": pick(paid.raw("bankId"), received.raw("bankId")), "ifsc": pick(paid.raw("ifsc"), received.raw("ifsc")), "utr": F.coalesce(paid.text("utr"), received.text("utr")),
    }


def build_payments(canonical: DataFrame, handles: DataFrame, banks: DataFrame) -> DataFrame:
    """Canonical rows of payment types as payments with every field the payload states; ``handles`` as ``classify.handle_dimension`` makes them.

    A payload that is no JSON object gives a payment with what the row itself says.  Handles and banks are dimensions: broadcast after a check of their size.
    """
    v = F.col("v")
    rows = _decoded(canonical.filter(F.col("type").isin(*PAYMENT_TYPES)))
    rows = rows.withColumns({"direction": F.coalesce(rules.direction_of_payment(F.col("type"), v), F.lit("UNKNOWN")), "paise": rules.payment_amount(v), "raw_state": F.col("state"), "ms": ledger_ts_ms(F.col("created"), F.col("global_id"))})
    rows = rows.withColumn("state", rules.payment_state(F.col("raw_state"), v))
    rows = rows.withColumns({**_party(F.col("direction"), v), "classification": rules.classify(v), "init": rules.initiation(v), "note": rules.user_note(v)})
    rows = rules.attribute_app(rules.attribute_app(rows, "sender_vpa", handles, "sender"), "receiver_vpa", handles, "receiver")
    to, frm = Leg(v, "to"), Leg(v, "from", only_object=True)
    rows = rules.attribute_app(rows.withColumn("to_vpa", to.text("vpa", "fullVpa")), "to_vpa", handles, "to")
    rows = rules.resolve_bank(rows, banks)
    mcc = F.when(to.raw("mcc") != "0", to.text("mcc"))
    first_party = F.when(to.kind("firstPartyMerchant") == "BOOLEAN", to.raw("firstPartyMerchant") == "true")
    return rows.select(
        F.col("entity_id").alias("id"), "global_id", F.lit(LEDGER).alias("data_source"), F.col("type"), "state", F.when(F.col("state") == "FAILED", F.coalesce(text_at(v, "backendErrorCode"), filled(F.col("error")))).alias("failure_reason"),
        F.coalesce(frm.raw("type") == "MERCHANT", F.lit(False)).alias("is_refund"), "direction", "paise", paise_to_inr(F.col("paise")).alias("amount_inr"), "ms", utc_text(F.col("ms")).alias("utc"), ist_text(F.col("ms")).alias("ist"),
        "classification", F.when(F.col("classification") == "MERCHANT", rules.merchant_subtype(v, F.col("to_own_handle"))).alias("merchant_subtype"), *_party(F.col("direction"), v), "sender_app_label", "sender_app_source", "receiver_app_label", "receiver_app_source",
        F.when(F.col("direction") == "RECEIVED", F.coalesce(frm.raw("type") == "INTERNAL_USER", F.lit(False))).otherwise(True).alias("sender_on_app"), F.col("receiver_own_handle").alias("receiver_on_app"), "note", "bank_name",
        mcc.alias("mcc"), at(v, "context.serviceContext.serviceType").alias("service_type"), to.raw("merchantId").alias("merchant_id"), to.raw("merchantType").alias("merchant_type"), first_party.alias("first_party_merchant"), "init.*", "n_aliases",
        provenance("ledger", "entity", F.col("row_pk"), "entity_id", F.col("entity_id"), F.col("data"), "JSON text").alias("provenance"),
    )


def build_requests(canonical: DataFrame) -> DataFrame:
    """Canonical rows of the other types: mandates and requests with name, amount and who asks.

    The name is the mandate's, else the requester's, else the receiving leg's, else a refunding merchant's; the amount the mandate's, else the payload's own.
    """
    v = F.col("v")
    rows = _decoded(canonical.filter(~F.coalesce(F.col("type").isin(*PAYMENT_TYPES), F.lit(False))))
    to, frm = Leg(v, "to"), Leg(v, "from", only_object=True)
    refund = F.coalesce(frm.raw("type") == "MERCHANT", F.lit(False))
    meta, asker = text_at(v, "metaData.name"), text_at(v, "requester.name")
    name = F.coalesce(meta, asker, to.text("name"), F.when(refund, frm.text("name", "cbsName")), F.lit(""))
    positive = lambda c: F.when(c != 0, c)
    paise = F.coalesce(positive(long_at(v, "mandateAmount.amount")), positive(long_at(v, "amount")), positive(long_at(v, "amount.amount")), F.lit(0).cast("long"))
    asked = F.when(meta.isNull() & kind_at(v, "requester").startswith("OBJECT"), at(v, "requester.type"))
    return rows.select(
        F.col("entity_id").alias("id"), "global_id", "type", "state", ledger_ts_ms(F.col("created"), F.col("global_id")).alias("ms"), name.alias("name"), paise.alias("paise"), refund.alias("is_merchant_refund"),
        asked.alias("requester_type"), "n_aliases", provenance("ledger", "entity", F.col("row_pk"), "entity_id", F.col("entity_id"), F.col("data"), "JSON text").alias("provenance"),
    )


def request_kinds(requests: DataFrame) -> DataFrame:
    """Autopay mandates (two types), collect requests, and merchants' refunds among the requests."""
    kind = F.col("type")
    return requests.agg(F.count(F.lit(1)).alias("n"), F.count_if(kind.isin(*AUTOPAY_TYPES)).alias("n_autopay"), F.count_if(kind.isin(*COLLECT_TYPES)).alias("n_collect"), F.count_if("is_merchant_refund").alias("n_merchant_refunds"))


def owner_addresses(payments: DataFrame, handles: DataFrame) -> DataFrame:
    """(vpa, n, own_handle): the owner's addresses as the legs of all payments state them, each once, and whether their handle is first-party."""
    own = F.when(F.col("direction") == "SENT", F.col("sender_vpa")).when(F.col("direction") == "RECEIVED", F.col("receiver_vpa"))
    seen = payments.select(F.lower(filled(own)).alias("vpa")).filter("vpa is not null").groupBy("vpa").agg(F.count(F.lit(1)).alias("n"))
    known = handles.filter("own_handle").select(F.col("handle").alias("_psp"), "own_handle")
    marked = lookup_join(seen.withColumn("_psp", F.substring_index("vpa", "@", -1)), known, "_psp")
    return marked.select("vpa", "n", F.coalesce("own_handle", F.lit(False)).alias("own_handle"))


def as_transactions(payments: DataFrame) -> DataFrame:
    """Payments in the form of transaction rows: IN and OUT, a verified name before the one shown, a merchant's name only for merchants."""
    name = F.coalesce(filled(F.col("counterparty_cbs_name")), filled(F.col("counterparty_name")))
    way = F.when(F.col("direction") == "SENT", "OUT").when(F.col("direction") == "RECEIVED", "IN").otherwise(F.col("direction"))
    return payments.select("id", way.alias("direction"), name.alias("counterparty"), F.when(F.col("classification") == "MERCHANT", filled(F.col("counterparty_name"))).alias("merchant"), "paise", "state", "ms", "type")


def raw_records(payments: DataFrame, requests: DataFrame, messages: DataFrame) -> DataFrame:
    """(kind, id, global_id, summary, ms, provenance) of every payment, request and message; messages have (id, kind, text, ms, provenance)."""
    money = lambda c: F.format_string("₹%.2f", c / 100)
    sides = {
        "payment": payments.select("id", "global_id", F.concat_ws(" ", "direction", money(F.col("paise")), filled(F.col("counterparty_name"))).alias("summary"), "ms", "provenance"),
        "mandate_or_request": requests.select("id", "global_id", F.concat_ws(" ", "type", filled(F.col("name")), money(F.col("paise"))).alias("summary"), "ms", "provenance"),
        "message": messages.select("id", F.lit(None).cast("string").alias("global_id"), F.concat(F.coalesce("kind", F.lit("?")), F.lit(": "), F.left(F.coalesce("text", F.lit("")), F.lit(50))).alias("summary"), "ms", "provenance"),
    }
    return _tagged(sides)


def _tagged(sides: Mapping[str, DataFrame]) -> DataFrame:
    out = None
    for kind, df in sides.items():
        part = df.withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


def record_of(records: DataFrame, ref: str) -> DataFrame:
    """The raw records with an id, or else a global id, equal to ``ref``."""
    return records.filter((F.col("id") == ref) | (F.col("global_id") == ref))


def records_view(records: DataFrame, kind: str | None = None, source: str | None = None, text: str | None = None) -> DataFrame:
    """Records of a kind and a source whose summary or provenance holds the text, in either case."""
    if kind:
        records = records.filter(F.col("kind") == kind)
    if source:
        records = records.filter(F.col("provenance.source") == source)
    if text:
        records = records.filter(F.lower(F.concat_ws(" ", "summary", "id", "global_id", F.to_json("provenance"))).contains(text.lower()))
    return records


def record_sources(records: DataFrame) -> DataFrame:
    """(kind, source, n) of the records."""
    return records.groupBy("kind", F.col("provenance.source").alias("source")).agg(F.count(F.lit(1)).alias("n"))
