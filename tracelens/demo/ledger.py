"""Queries of the payment builder over the given tables: orders as ledger rows with a JSON payload in six shapes."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from tracelens.demo.adapter import messages, table
from tracelens.demo.queries import register
from tracelens.functions import classify as rules
from tracelens.functions.payload import provenance
from tracelens.functions.time import epoch_ms
from tracelens.operators import builder

#: Types of the rows, by order key. Fixed values.
_TYPES = [*builder.PRIORITY, "ODD_TYPE"]

#: Payloads: a sent payment to a merchant's list of legs, a received one, a refund, a service receipt, text that is no JSON, and a failed one. # is the order, ~ the customer, ^ the paise.
_SHAPES = {
    0: '{"to":[{"vpa":"m~@YesCred","name":"M ~","merchantId":"X~","mcc":"5411","firstPartyMerchant":false}],"paidFrom":[{"amount":^,"vpa":"own@ybl","bankId":"HDFC","ifsc":"ICIC0001","utr":"U#"}],"context":{"transferMode":"PEER_TO_MERCHANT","upiInitiationMode":"01","message":" hi # "}}',
    1: '{"from":{"vpa":"p~@okhdfcbank","name":"P ~","cbsName":"C ~","phone":"+91 9~0000000000","type":"INTERNAL_USER","userId":"u~"},"receivedIn":{"amount":"^","vpa":"own2@ybl","ifsc":"ICIC0002"},"context":{"transferMode":"PEER_TO_PEER","initiationMode":"INTENT","refUrl":"http://x/#"}}',
    2: '{"from":{"type":"MERCHANT","cbsName":"Shop ~","vpa":"shop@hdfcbank"},"to":{"name":"me"},"amount":^,"note":"  back  "}',
    3: '{"amount":{"amount":^},"note":{"text":"paid"},"metaData":{"name":""},"requester":{"name":"Asks ~","type":"USER"}}',
    4: "not json ^",
    5: '{"to":{"fullVpa":"z~@nowhere","accountHolderName":"Z ~","type":"VPA","upiNumber":"98~"},"paidFrom":{"actualAmount":^,"bankId":"ZZZZ"},"backendErrorCode":"B#","mandateAmount":{"amount":7}}',
}


def _payload(shape: str, marks: dict[str, Column]) -> Column:
    """The shape with each mark replaced by its value, as one concatenation."""
    return F.concat(*[marks.get(part, F.lit(part)) for part in re.split(r"([#~^])", shape) if part])


def _rows(spark, sf_dir):
    o, party = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    text = o.cast("string")
    paise = F.round(F.col("o_totalprice") * 100).cast("long").cast("string")
    marks = {"#": text, "~": party, "^": paise}
    # a row's own shape only
    data = F.coalesce(*[F.when(o % 6 == k, _payload(shape, marks)) for k, shape in _SHAPES.items()])
    kind = F.element_at(F.array(*map(F.lit, _TYPES)), (F.floor(o / 6) % len(_TYPES) + 1).cast("int"))
    state = F.when(o % 6 == 5, "ERRORED").when(o % 7 != 0, F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("E"), text).alias("entity_id"), F.when(o % 5 != 0, F.concat(F.lit("G"), F.floor(o / 13).cast("string"), F.lit("-"), (o % 7).cast("string"))).alias("global_id"), kind.alias("type"), state.alias("state"),
        F.when(o % 11 != 0, epoch_ms(F.col("o_orderdate")).cast("string")).alias("created"), F.when(o % 2 == 0, "E9").alias("error"), data.alias("data"), o.alias("row_pk"),
    )


def _dimensions(spark, sf_dir):
    """Banks and handles: two banks by id, one by prefix; the fixed tables name the other handles, and two are first-party."""
    nation = table(spark, sf_dir, "nation")
    one = lambda k: nation.filter(f"n_nationkey = {k}")
    bank = lambda k, i, n, p: one(k).select(F.lit(i).alias("bank_id"), F.lit(n).alias("bank_name"), F.lit(p).alias("ifsc_prefix"))
    banks = bank(0, "HDFC", "Bank of H", "").unionByName(bank(1, "ICIC", "Bank of I", "")).unionByName(bank(2, "OTHR", "Other", "ICIC0002"))
    config = one(3).select(F.lit("okhdfcbank").alias("handle"), F.lit("Named App").alias("app_title"))
    own = one(4).select(F.lit("YBL").alias("handle")).unionByName(one(5).select(F.lit("yescred").alias("handle")))
    return rules.handle_dimension(config, banks, own), banks


_TYPE_LIST = "[" + ", ".join(f"'{t}'" for t in _TYPES) + "]"
_B = f"""raw AS (SELECT o_orderkey AS o, CAST(o_custkey AS VARCHAR) AS c, CAST(round(o_totalprice * 100) AS BIGINT) AS p, o_orderkey % 6 AS s, 'E' || o_orderkey AS entity_id, CASE WHEN o_orderkey % 5 <> 0 THEN 'G' || o_orderkey // 13 || '-' || o_orderkey % 7 END AS global_id,
    {_TYPE_LIST}[CAST(o_orderkey // 6 % {len(_TYPES)} + 1 AS INTEGER)] AS type, CASE WHEN o_orderkey % 6 = 5 THEN 'ERRORED' WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS raw_state, CASE WHEN o_orderkey % 11 <> 0 THEN epoch_ms(o_orderdate) END AS ms FROM orders),
  grouped AS (SELECT *, coalesce(global_id, entity_id) AS payment_key, CASE type """ + " ".join(f"WHEN '{t}' THEN {n}" for t, n in builder.PRIORITY.items()) + """ ELSE 0 END AS prio FROM raw),
  ranked AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY payment_key) - 1 AS n_aliases, first_value(entity_id) OVER w AS canonical, first_value(type) OVER w AS canonical_type FROM grouped WINDOW w AS (PARTITION BY payment_key ORDER BY prio DESC, entity_id)),
  can AS (SELECT * FROM ranked WHERE k = 1), ispay AS (SELECT * FROM can WHERE type IN ('SENT_PAYMENT', 'RECEIVED_PAYMENT', 'PHONE_RECHARGE', 'EXTERNAL_PAYMENT', 'SYMPHONY')),
  d AS (SELECT *, CASE s WHEN 0 THEN 'SENT' WHEN 1 THEN 'RECEIVED' WHEN 2 THEN 'RECEIVED' WHEN 5 THEN 'SENT' ELSE CASE type WHEN 'RECEIVED_PAYMENT' THEN 'RECEIVED' WHEN 'SENT_PAYMENT' THEN 'SENT' ELSE 'SERVICE' END END AS direction,
    CASE WHEN s = 5 THEN 'FAILED' ELSE coalesce(raw_state, 'UNKNOWN') END AS state FROM ispay),
  pay AS (SELECT o, entity_id AS id, global_id, type, state, CASE WHEN s = 5 THEN 'B' || o END AS failure_reason, s = 2 AS is_refund, direction, CASE WHEN s = 4 THEN 0 ELSE p END AS paise, ms, n_aliases,
    CASE s WHEN 0 THEN 'MERCHANT' WHEN 1 THEN 'PEER_TO_PEER' WHEN 2 THEN 'MERCHANT_REFUND' WHEN 5 THEN 'MANDATE' ELSE 'OTHER' END AS classification, CASE WHEN s = 0 THEN 'MERCHANT_ON_APP' END AS merchant_subtype,
    CASE s WHEN 0 THEN 'M ' || c WHEN 1 THEN 'P ' || c WHEN 2 THEN 'Shop ' || c ELSE '' END AS counterparty_name, CASE s WHEN 0 THEN 'm' || c || '@YesCred' WHEN 1 THEN 'p' || c || '@okhdfcbank' WHEN 2 THEN 'shop@hdfcbank' WHEN 5 THEN 'z' || c || '@nowhere' ELSE '' END AS counterparty_vpa,
    CASE s WHEN 1 THEN right('919' || c || '0000000000', 10) WHEN 5 THEN '98' || c END AS counterparty_phone, CASE s WHEN 1 THEN 'C ' || c WHEN 2 THEN 'Shop ' || c WHEN 5 THEN 'Z ' || c END AS counterparty_cbs_name, CASE s WHEN 1 THEN 'u' || c END AS counterparty_user_id,
    CASE s WHEN 0 THEN 'own@ybl' WHEN 1 THEN 'p' || c || '@okhdfcbank' WHEN 2 THEN 'shop@hdfcbank' ELSE '' END AS sender_vpa, CASE s WHEN 0 THEN 'm' || c || '@YesCred' WHEN 1 THEN 'own2@ybl' WHEN 5 THEN 'z' || c || '@nowhere' ELSE '' END AS receiver_vpa,
    CASE s WHEN 0 THEN 'Unknown TPAP (@ybl)' WHEN 1 THEN 'Named App' WHEN 2 THEN 'Bank of H (bank-direct)' ELSE 'No VPA' END AS sender_app_label, CASE s WHEN 0 THEN 'CRED (inference)' WHEN 1 THEN 'Unknown TPAP (@ybl)' WHEN 5 THEN 'Unknown TPAP (@nowhere)' ELSE 'No VPA' END AS receiver_app_label,
    CASE WHEN direction = 'RECEIVED' THEN s = 1 ELSE true END AS sender_on_app, s IN (0, 1) AS receiver_on_app, CASE s WHEN 0 THEN 'hi ' || o WHEN 2 THEN 'back' WHEN 3 THEN 'paid' ELSE '' END AS note, CASE s WHEN 0 THEN 'Bank of H' WHEN 1 THEN 'Bank of I' WHEN 5 THEN 'ZZZZ Bank' ELSE '' END AS bank_name,
    CASE WHEN s = 0 THEN '5411' END AS mcc, CASE WHEN s = 0 THEN 'X' || c END AS merchant_id, CASE WHEN s = 0 THEN false END AS first_party_merchant, CASE WHEN s = 0 THEN 'U' || o END AS utr, CASE WHEN s = 0 THEN 'STATIC_QR' ELSE '' END AS payment_initiation, s = 0 AS is_qr_scan, s = 1 AS is_intent,
    CASE WHEN s = 1 THEN 'http://x/' || o ELSE '' END AS intent_caller_url, CASE s WHEN 0 THEN 'PEER_TO_MERCHANT' WHEN 1 THEN 'PEER_TO_PEER' ELSE '' END AS transfer_mode FROM d),
  req AS (SELECT entity_id AS id, global_id, type, raw_state AS state, ms, CASE s WHEN 0 THEN 'M ' || c WHEN 2 THEN 'me' WHEN 3 THEN 'Asks ' || c ELSE '' END AS name, CAST(CASE s WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 4 THEN 0 WHEN 5 THEN 7 ELSE p END AS BIGINT) AS paise,
    s = 2 AS is_merchant_refund, CASE WHEN s = 3 THEN 'USER' END AS requester_type, n_aliases FROM can WHERE type NOT IN ('SENT_PAYMENT', 'RECEIVED_PAYMENT', 'PHONE_RECHARGE', 'EXTERNAL_PAYMENT', 'SYMPHONY'))"""


def _payments(spark, sf_dir):
    return builder.build_payments(builder.canonical_rows(_rows(spark, sf_dir)), *_dimensions(spark, sf_dir))


def _requests(spark, sf_dir):
    return builder.build_requests(builder.canonical_rows(_rows(spark, sf_dir)))


_SHOWN = """id, global_id, type, state, failure_reason, is_refund, direction, paise, ms, n_aliases, classification, merchant_subtype, counterparty_name, counterparty_vpa, counterparty_phone, counterparty_cbs_name, counterparty_user_id, sender_vpa,
  receiver_vpa, sender_app_label, receiver_app_label, sender_on_app, receiver_on_app, note, bank_name, mcc, merchant_id, first_party_merchant, utr, payment_initiation, is_qr_scan, is_intent, intent_caller_url, transfer_mode"""


@register(f"WITH {_B} SELECT {_SHOWN} FROM pay")
def built_payments(spark, sf_dir):
    return _payments(spark, sf_dir).select(*_SHOWN.replace("\n", "").replace(" ", "").split(","))


@register(f"WITH {_B} SELECT * FROM req")
def built_requests(spark, sf_dir):
    return _requests(spark, sf_dir).drop("provenance")


@register(f"WITH {_B} SELECT count(*) AS n, count(*) FILTER (type IN ('RECEIVED_MANDATE_CREATE_REQUEST', 'SERVICE_MANDATE_CREATE')) AS n_autopay, count(*) FILTER (type = 'USER_TO_USER_RECEIVED_REQUEST') AS n_collect, count(*) FILTER (is_merchant_refund) AS n_merchant_refunds FROM req")
def request_kinds(spark, sf_dir):
    return builder.request_kinds(_requests(spark, sf_dir))


@register(f"WITH {_B} SELECT entity_id AS alias, type, o AS row_pk, canonical, canonical_type, payment_key FROM ranked WHERE k > 1")
def alias_rows(spark, sf_dir):
    return builder.alias_rows(_rows(spark, sf_dir))


@register(f"""WITH {_B}, i AS (SELECT entity_id AS id, canonical AS "primary" FROM ranked UNION ALL SELECT payment_key, canonical FROM ranked) SELECT id, min("primary") AS "primary" FROM i GROUP BY id""")
def ids_to_primary(spark, sf_dir):
    return builder.id_map(_rows(spark, sf_dir))


@register(f"""WITH {_B} SELECT vpa, count(*) AS n, split_part(vpa, '@', -1) IN ('ybl', 'yescred') AS own_handle FROM (SELECT lower(nullif(CASE direction WHEN 'SENT' THEN sender_vpa WHEN 'RECEIVED' THEN receiver_vpa END, '')) AS vpa FROM pay) WHERE vpa IS NOT NULL GROUP BY vpa""")
def owner_addresses(spark, sf_dir):
    return builder.owner_addresses(_payments(spark, sf_dir), _dimensions(spark, sf_dir)[0])


@register(f"""WITH {_B} SELECT id, CASE direction WHEN 'SENT' THEN 'OUT' WHEN 'RECEIVED' THEN 'IN' ELSE direction END AS direction, coalesce(counterparty_cbs_name, nullif(counterparty_name, '')) AS counterparty, CASE WHEN classification = 'MERCHANT' THEN counterparty_name END AS merchant, paise, state, ms, type FROM pay""")
def transactions_of_payments(spark, sf_dir):
    return builder.as_transactions(_payments(spark, sf_dir))


_RAW = f"""WITH {_B}, rec AS (
    SELECT 'payment' AS kind, id, global_id, direction || ' ₹' || printf('%.2f', paise / 100.0) || CASE WHEN counterparty_name <> '' THEN ' ' || counterparty_name ELSE '' END AS summary, ms, 'ledger' AS source FROM pay
    UNION ALL SELECT 'mandate_or_request', id, global_id, type || CASE WHEN name <> '' THEN ' ' || name ELSE '' END || ' ₹' || printf('%.2f', paise / 100.0), ms, 'ledger' FROM req
    UNION ALL SELECT 'message', conv_id || '/' || turn, NULL, coalesce(role, '?') || ': ' || left(coalesce(text, ''), 50), NULL, 'chat' FROM conversations)"""


def _records(spark, sf_dir):
    text = F.concat_ws("/", F.col("party").cast("string"), F.col("turn").cast("string"))
    said = messages(spark, sf_dir).select(text.alias("id"), F.col("role").alias("kind"), "text", F.lit(None).cast("long").alias("ms"), provenance("chat", "messages", text, "id", text, F.col("text"), "row").alias("provenance"))
    return builder.raw_records(_payments(spark, sf_dir), _requests(spark, sf_dir), said)


@register(f"{_RAW} SELECT * FROM rec")
def raw_records(spark, sf_dir):
    return _records(spark, sf_dir).select("kind", "id", "global_id", "summary", "ms", F.col("provenance.source").alias("source"))


@register(f"{_RAW} SELECT kind, id, summary FROM rec WHERE id = 'G100-1' OR global_id = 'G100-1'")
def record_by_id(spark, sf_dir):
    return builder.record_of(_records(spark, sf_dir), "G100-1").select("kind", "id", "summary")


@register(f"{_RAW} SELECT kind, source, count(*) AS n FROM rec GROUP BY 1, 2")
def record_sources(spark, sf_dir):
    return builder.record_sources(_records(spark, sf_dir))


@register(f"{_RAW} SELECT id, summary FROM rec WHERE kind = 'payment' AND source = 'ledger' AND contains(lower(summary), 'shop')")
def records_view(spark, sf_dir):
    return builder.records_view(_records(spark, sf_dir), "payment", "ledger", "SHOP").select("id", "summary")
