"""Queries of both transaction layouts over the given tables: orders as rows with a payload, and tags beside them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelens.demo.adapter import table
from tracelens.demo.queries import register
from tracelens.functions.time import epoch_ms
from tracelens.operators import transactions

_NINE = "'9' || lpad(c, 9, '0')"

#: Dates are set on by 10^12 ms, into the range that stored milliseconds have. Leg payloads by order. # is the order, ~ the customer, ^ the paise.
_LEGS = {
    "RECEIVED_PAYMENT": '{"amount":^,"from":{"name":"****1","phone":"%n","type":"PHONE","userId":"u~"},"receivedIn":[{"accountHolderName":"Own","vpa":"own@ybl","ifsc":"I1","utr":"R#","accountNumber":"XX1"}],"context":{"transferMode":"P2P","initiationMode":"QR_SCAN"},"responseCode":"00"}',
    "SENT_PAYMENT": '{"to":[{"cbsName":"C ~","fullVpa":"V~@x","type":"MERCHANT","merchantId":"M~","name":"shop"}],"paidFrom":{"amount":"^","vpa":"own2@ybl"},"globalPaymentId":"G#"}',
    "PIEDPIPER_PAYMENT": '{"actor":"receiver","paymentPayerParty":{"accountHolderName":"Payer ~","phone":"8~"},"from":{"name":"not this"},"to":{"vpa":"own3@ybl","accountHolderName":"Own 3"}}',
    "EXPENSE_SETTLEMENT": '{"payerMemberId":"m%p","payeeMemberId":"m%q","amount":^}',
    "P2P_ENRICHMENT": '{"groupId":"g"}',
    None: '{"paidFrom":{"amount":^,"vpa":"own2@ybl"},"to":{"name":"XX12","vpa":"w~@y"},"amount":-3,"context":{"initiationMode":"INTENT"}}',
}

_O = """r AS (SELECT o_orderkey AS o, o_orderkey % 6 AS s, CAST(o_custkey AS VARCHAR) AS c, o_custkey, CAST(round(o_totalprice * 100) AS BIGINT) AS p, epoch_ms(o_orderdate) + 1000000000000 AS ms, o_orderstatus AS state, o_custkey % 7 AS payer, o_custkey % 5 + 5 AS payee FROM orders)"""
_X = f"""{_O}, own AS (SELECT * FROM (VALUES (0), (1), (2), (5)) v(m)), k AS (SELECT r.*, payer IN (SELECT m FROM own) AS po, payee IN (SELECT m FROM own) AS qo FROM r),
  d AS (SELECT *, CASE s WHEN 0 THEN 'IN' WHEN 2 THEN 'IN' WHEN 3 THEN CASE WHEN po AND NOT qo THEN 'OUT' WHEN qo AND NOT po THEN 'IN' ELSE 'OUT' END WHEN 4 THEN 'INTERNAL' ELSE 'OUT' END AS direction, CASE WHEN s = 3 AND po <> qo THEN CASE WHEN po THEN payee ELSE payer END END AS other FROM k),
  tx AS (SELECT 'T' || o AS id, CASE s WHEN 1 THEN 'G' || o WHEN 2 THEN 'PR' || o ELSE 'T' || o END AS global_id, CASE s WHEN 0 THEN 'RECEIVED_PAYMENT' WHEN 1 THEN 'SENT_PAYMENT' WHEN 2 THEN 'PIEDPIPER_PAYMENT' WHEN 3 THEN 'EXPENSE_SETTLEMENT' WHEN 4 THEN 'P2P_ENRICHMENT' ELSE 'UNKNOWN' END AS type,
    CASE WHEN o % 8 <> 0 THEN state ELSE 'UNKNOWN' END AS state, direction, CASE WHEN s <> 4 THEN p END AS paise, CASE WHEN o % 3 = 0 THEN 'cat' || o % 10 END AS category, CASE s WHEN 0 THEN {_NINE} WHEN 1 THEN 'C ' || c WHEN 2 THEN 'Payer ' || c WHEN 3 THEN n_name WHEN 4 THEN 'contact ' || c ELSE 'w' || c || '@y' END AS counterparty,
    CASE WHEN s = 0 AND o_custkey % 2 = 0 THEN 'Real ' || c WHEN s = 5 AND o_custkey % 3 = 0 THEN 'Addr ' || c END AS resolved, CASE WHEN s = 0 AND o_custkey % 2 = 0 THEN 'phone' WHEN s = 5 AND o_custkey % 3 = 0 THEN 'address' END AS resolved_by,
    CASE WHEN s = 0 AND o_custkey % 2 = 0 THEN {_NINE} END AS phone_full, CASE s WHEN 0 THEN {_NINE} WHEN 2 THEN '8' || c WHEN 3 THEN CASE WHEN n_name IS NOT NULL THEN '77' || other END END AS counterparty_phone, CASE s WHEN 1 THEN 'V' || c || '@x' WHEN 5 THEN 'w' || c || '@y' END AS counterparty_vpa,
    CASE s WHEN 0 THEN 'PEER_TO_PEER' WHEN 1 THEN 'MERCHANT' WHEN 3 THEN 'SPLIT_SETTLEMENT' END AS classification, CASE s WHEN 0 THEN 'Own' WHEN 2 THEN 'Own 3' END AS self_holder, CASE s WHEN 0 THEN 'own@ybl' WHEN 1 THEN 'own2@ybl' WHEN 2 THEN 'own3@ybl' WHEN 5 THEN 'own2@ybl' END AS self_vpa,
    CASE WHEN s = 0 THEN 'R' || o END AS utr, CASE WHEN s = 0 THEN 'P2P' WHEN o % 3 = 1 THEN 'TAG' END AS transfer_mode, CASE s WHEN 0 THEN true WHEN 5 THEN false END AS is_qr_scan, CASE s WHEN 0 THEN false WHEN 5 THEN true END AS is_intent, CASE WHEN s = 1 THEN 'M' || c END AS merchant_id, CASE WHEN s = 1 THEN 'shop' END AS merchant_name,
    CASE WHEN o % 5 = 0 THEN 'a' || o || '  b' ELSE '' END AS search_text, ms, o % 4 = 1 AS dismissed, o % 9 = 0 AS is_internal FROM d LEFT JOIN nation ON n_nationkey = other AND s = 3 AND other % 2 = 0)"""


def _text(mark, v):
    return F.concat(F.lit(mark), v.cast("string"))


def _leg_rows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    o, p = F.col("o_orderkey"), F.col("o_custkey")
    paise = F.round(F.col("o_totalprice") * 100).cast("long").cast("string")
    marks = {"#": o.cast("string"), "~": p.cast("string"), "^": paise, "%n": F.concat(F.lit("9"), F.lpad(p.cast("string"), 9, "0")), "%p": (p % 7).cast("string"), "%q": (p % 5 + 5).cast("string")}

    def put(shape):
        c = F.lit(shape)
        for mark, value in marks.items():
            c = F.replace(c, F.lit(mark), value)
        return c

    place = (o % 6 + 1).cast("int")
    rows = orders.select(
        _text("T", o).alias("id"), o.alias("ref"), F.element_at(F.array(*map(F.lit, _LEGS)), place).alias("type"), F.when(o % 8 != 0, F.col("o_orderstatus")).alias("state"), F.element_at(F.array(*map(put, _LEGS.values())), place).alias("data"),
        F.when(o % 6 == 2, F.concat(F.lit('[{"amount":"'), paise, F.lit('"}]'))).alias("instruments"), F.when(o % 6 == 4, _text("contact ", p)).alias("contact_data"), F.when(o % 6 == 2, _text("PR", o)).alias("payment_reference"),
        (epoch_ms(F.col("o_orderdate")) + 10**12).alias("created"), F.lit(None).cast("long").alias("updated"), F.when(o % 4 == 1, "0").when(o % 4 == 2, "1").alias("show_on_history"),
    )
    tag = lambda seq, name, value, when: F.when(when, F.struct(F.lit(seq).alias("seq"), F.lit(name).alias("tag"), value.alias("value")))
    facts = F.array_compact(F.array(
        tag(0, "entity.category", F.lit(" "), o % 3 == 0), tag(1, "entity.category", _text("cat", o % 10), o % 3 == 0), tag(2, "entity.category", F.lit("late"), o % 3 == 0), tag(3, "context.transferMode", F.lit("TAG"), o % 3 == 1), tag(4, "isInternalPayment", F.lit("1"), o % 9 == 0),
        tag(5, "other", F.lit("x"), o % 2 == 0),
    ))
    tags = orders.select(o.alias("ref"), F.explode(facts).alias("t")).select("ref", "t.*")
    tokens = orders.filter("o_orderkey % 5 = 0").select(o.alias("ref"), F.explode(F.array(F.lit("b"), _text(" a", o), F.lit("b "))).alias("token"))
    people, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    k, n = F.col("c_custkey"), F.col("n_nationkey")
    phone = F.concat(F.lit("9"), F.lpad(k.cast("string"), 9, "0"))
    by_phone = people.filter("c_custkey % 2 = 0").select(phone.alias("phone"), _text("Real ", k).alias("name"), phone.alias("full_phone"))
    by_address = people.filter("c_custkey % 3 = 0").select(F.concat(_text("w", k), F.lit("@y")).alias("address"), _text("Addr ", k).alias("name"), F.lit(None).cast("string").alias("full_phone"))
    by_member = nation.filter("n_nationkey % 2 = 0").select(_text("m", n).alias("member"), F.col("n_name").alias("name"), _text("77", n).alias("full_phone"))
    return rows, tags, tokens, nation.filter("n_nationkey in (0, 1, 2, 5)").select(_text("m", n).alias("member")), by_phone, by_address, by_member


_SHOWN = """id, global_id, type, state, direction, paise, category, counterparty, resolved, resolved_by, phone_full, counterparty_phone, counterparty_vpa, classification, self_holder, self_vpa, utr, transfer_mode, is_qr_scan, is_intent, merchant_id, merchant_name,
  search_text, ms, dismissed, is_internal"""


def _legs(spark, sf_dir):
    return transactions.leg_transactions(*_leg_rows(spark, sf_dir))


@register(f"WITH {_X} SELECT {_SHOWN} FROM tx")
def leg_transactions(spark, sf_dir):
    return _legs(spark, sf_dir).select(*_SHOWN.replace("\n", "").replace(" ", "").split(","))


@register(f"WITH {_X}, i AS (SELECT 'holder' AS kind, self_holder AS value FROM tx UNION ALL SELECT 'address', self_vpa FROM tx UNION ALL SELECT 'branch', CASE WHEN type = 'RECEIVED_PAYMENT' THEN 'I1' END FROM tx) SELECT kind, value, count(*) AS n FROM i WHERE value IS NOT NULL GROUP BY 1, 2")
def owner_identity(spark, sf_dir):
    return transactions.owner_identity(_legs(spark, sf_dir))


_TAGGED = {
    "RECEIVED_PAYMENT": '{"from":{"name":"F ~","phone":"90","vpa":"f@x","userId":"u~"},"to":{"vpa":"own@y"},"receivedIn":[{"amount":^,"vpa":"no@y","utr":"R#","accountHolderName":"Own"}]}',
    "SENT_PAYMENT": '{"amount":^,"to":{"cbsName":"T ~","upiNumber":"98~"},"paidFrom":[{"vpa":"own4@y"}],"responseCode":"00"}',
    "PHONE_RECHARGE": '{"amount":0,"context":{"transferMode":"BILL"}}',
    "X_CREDIT": "no json",
    None: "[]",
}


@register(f"""WITH {_O}, t AS (SELECT *, o % 5 AS z FROM r) SELECT o AS pk, CASE z WHEN 0 THEN 'RECEIVED_PAYMENT' WHEN 1 THEN 'SENT_PAYMENT' WHEN 2 THEN 'PHONE_RECHARGE' WHEN 3 THEN 'X_CREDIT' ELSE 'UNKNOWN' END AS type, CASE z WHEN 0 THEN 'IN' WHEN 1 THEN 'OUT' WHEN 2 THEN 'OUT' WHEN 3 THEN 'IN' ELSE 'UNKNOWN' END AS direction,
  CASE z WHEN 0 THEN p WHEN 1 THEN p + 1 WHEN 2 THEN 0 WHEN 3 THEN CASE WHEN o % 2 = 0 THEN p + 2 END END AS paise, CASE z WHEN 0 THEN 'F ' || c WHEN 1 THEN 'T ' || c WHEN 2 THEN '55' || c WHEN 3 THEN 'a' || c || '@b' ELSE 'Person ' || c END AS counterparty,
  CASE z WHEN 0 THEN '90' WHEN 2 THEN '55' || c END AS counterparty_phone, CASE z WHEN 0 THEN 'f@x' WHEN 1 THEN '98' || c WHEN 3 THEN 'a' || c || '@b' END AS counterparty_vpa, CASE z WHEN 0 THEN 'own@y' WHEN 1 THEN 'own4@y' END AS self_vpa, CASE WHEN z = 0 THEN 'R' || o END AS utr, CASE WHEN z = 2 THEN 'BILL' END AS transfer_mode, ms FROM t""")
def tag_transactions(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    o, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    paise = F.round(F.col("o_totalprice") * 100).cast("long")
    put = lambda shape: F.replace(F.replace(F.replace(F.lit(shape), F.lit("#"), o.cast("string")), F.lit("~"), c), F.lit("^"), paise.cast("string"))
    z, place = o % 5, (o % 5 + 1).cast("int")
    rows = orders.select(
        o.alias("pk"), _text("E", o).alias("id"), F.lit(None).cast("string").alias("global_id"), F.element_at(F.array(*map(F.lit, _TAGGED)), place).alias("type"), F.col("o_orderstatus").alias("state"), F.element_at(F.array(*map(put, _TAGGED.values())), place).alias("data"),
        F.when(z == 1, F.concat(F.lit('{"amount":"'), (paise + 1).cast("string"), F.lit('"}'))).alias("tags_data"), (epoch_ms(F.col("o_orderdate")) + 10**12).alias("created"),
    )
    sent = F.when(z == 2, F.concat(F.lit("55"), c)).when(z == 3, F.concat(F.lit("a"), c, F.lit("@b"))).when(z == 4, F.concat(F.lit("Person "), c))
    facts = F.array(F.struct(F.lit(0).alias("seq"), F.lit("sentTo").alias("tag"), F.lit("").alias("value")), F.struct(F.lit(1).alias("seq"), F.lit("sentTo").alias("tag"), sent.alias("value")), F.struct(F.lit(2).alias("seq"), F.lit("amount").alias("tag"), F.when((z == 3) & (o % 2 == 0), (paise + 2).cast("string")).alias("value")))
    tags = orders.select(o.alias("pk"), F.explode(facts).alias("t")).select("pk", "t.*")
    found = transactions.tag_transactions(rows, tags)
    return found.select("pk", "type", "direction", "paise", "counterparty", "counterparty_phone", "counterparty_vpa", "self_vpa", "utr", "transfer_mode", "ms")
