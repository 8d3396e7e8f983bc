"""Queries of corroboration, conversations and the counterparty graph over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tracelens.demo.adapter import payments, table
from tracelens.demo.queries import _T, register
from tracelens.functions.time import epoch_ms
from tracelens.operators import chats, evidence, graph


def _tag(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix), c.cast("string"))


#: References to payments. Orders name themselves twice, events chain up to a dozen orders, and one order in nine is not in the ledger.
_R = """r AS (
    SELECT 'ledger' AS source, 0 AS place, ['T' || o_orderkey, 'G' || o_orderkey] AS ids, 'ledger_row' AS kind, epoch_ms(o_orderdate) AS ms,
      CASE WHEN o_orderkey % 5 <> 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) END AS paise, CAST(o_custkey AS VARCHAR) AS party FROM orders WHERE o_orderkey % 9 <> 0
    UNION ALL SELECT 'chat', 1, [x FOR x IN ['G' || event_id * 3, CASE WHEN event_id % 2 = 0 THEN 'T' || (event_id * 3 + 1) END, CASE WHEN event_id % 10 < 5 THEN 'T' || (event_id * 3 + 3) ELSE '' END] IF x <> ''],
      CASE event_type WHEN 'click' THEN 'chat_payment_card' WHEN 'view' THEN 'group_action' ELSE 'chat_other' END, CASE WHEN event_id % 7 <> 0 THEN epoch_us(ts) // 1000 END, CAST(round(value * 100) AS BIGINT), CAST(user_id AS VARCHAR) FROM events
    UNION ALL SELECT 'rewards', 2, ['G' || l_orderkey], 'reward_link', NULL, NULL, NULL FROM lineitem WHERE l_returnflag = 'A'
    UNION ALL SELECT 'shared', 3, ['T' || l_orderkey], 'split_settlement', NULL, CAST(round(l_extendedprice * 100) AS BIGINT), NULL FROM lineitem WHERE l_returnflag = 'R'),
  e AS (SELECT ids[1] AS a, unnest(ids[2:]) AS b FROM r),
  both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
  reach AS (SELECT unnest(ids) AS id, unnest(ids) AS low FROM r UNION SELECT w.b, reach.low FROM reach JOIN both_ways w ON w.a = reach.id WHERE reach.low < w.b),
  ent AS (SELECT id, min(low) AS entity FROM reach GROUP BY id),
  idx AS (
    SELECT entity, CAST(count(DISTINCT source) AS INTEGER) AS score, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources, array_to_string(list_sort(list_distinct(list(kind))), ',') AS ref_kinds,
      bool_or(kind IN ('ledger_row', 'chat_payment_card', 'chat_receipt', 'chat_settlement', 'reward_link', 'split_settlement')) AS expects_ledger_row, count(*) AS mentions, min(ms) AS earliest_ms,
      first(paise ORDER BY place, coalesce(ms, 4611686018427387904), ids[1], paise) FILTER (paise IS NOT NULL) AS paise,
      first(party ORDER BY place, coalesce(ms, 4611686018427387904), ids[1], party) FILTER (party IS NOT NULL) AS party,
      (SELECT count(*) FROM ent n WHERE n.entity = ent.entity) AS n_aliases
    FROM r JOIN ent ON ent.id = ids[1] GROUP BY entity)"""


def _references(spark, sf_dir):
    c = F.col
    orders, events, items = (table(spark, sf_dir, t) for t in ("orders", "events", "lineitem"))
    paise = lambda v: F.round(v * 100).cast("long")
    none = F.lit(None).cast("string")
    ledger = orders.filter("o_orderkey % 9 <> 0").select(
        F.array(_tag("T", c("o_orderkey")), _tag("G", c("o_orderkey"))).alias("ids"), F.lit("ledger_row").alias("kind"), epoch_ms(c("o_orderdate")).alias("ms"),
        F.when(c("o_orderkey") % 5 != 0, paise(c("o_totalprice"))).alias("paise"), c("o_custkey").cast("string").alias("party"),
    )
    e = c("event_id")
    ids = F.array(_tag("G", e * 3), F.when(e % 2 == 0, _tag("T", e * 3 + 1)), F.when(e % 10 < 5, _tag("T", e * 3 + 3)).otherwise(""))
    kind = F.when(c("event_type") == "click", "chat_payment_card").when(c("event_type") == "view", "group_action").otherwise("chat_other")
    chat = events.select(ids.alias("ids"), kind.alias("kind"), F.when(e % 7 != 0, epoch_ms(c("ts"))).alias("ms"), paise(c("value")).alias("paise"), c("user_id").cast("string").alias("party"))
    named = lambda flag, prefix, kind, amount: items.filter(c("l_returnflag") == flag).select(F.array(_tag(prefix, c("l_orderkey"))).alias("ids"), F.lit(kind).alias("kind"), F.lit(None).cast("long").alias("ms"), amount.alias("paise"), none.alias("party"))
    return {"ledger": ledger, "chat": chat, "rewards": named("A", "G", "reward_link", F.lit(None).cast("long")), "shared": named("R", "T", "split_settlement", paise(c("l_extendedprice")))}


@register(f"WITH RECURSIVE {_R} SELECT * FROM idx")
def corroboration_folded(spark, sf_dir):
    return evidence.corroborate(_references(spark, sf_dir))


@register(f"""WITH RECURSIVE {_R} SELECT count(*) AS n_entities, CAST(sum(n_aliases) AS BIGINT) AS n_ids, max(score) AS max_score, count(*) FILTER (score = 1) AS n_single_source FROM idx""")
def corroboration_summary(spark, sf_dir):
    return evidence.corroboration_summary(evidence.corroborate(_references(spark, sf_dir)))


@register(f"""WITH RECURSIVE {_R}, w AS (SELECT min(ms) AS oldest FROM r WHERE source = 'ledger'),
  v AS (SELECT entity, score, mentions, CASE WHEN earliest_ms IS NULL THEN 'undated' WHEN earliest_ms < (SELECT oldest FROM w) THEN 'before window' ELSE 'inside window' END AS verdict
    FROM idx WHERE expects_ledger_row AND NOT list_contains(string_split(sources, ','), 'ledger'))
  SELECT *, CASE verdict WHEN 'inside window' THEN 'high' WHEN 'before window' THEN 'low' ELSE 'medium' END AS severity FROM v""")
def uncorroborated_payments(spark, sf_dir):
    sources = _references(spark, sf_dir)
    missing = evidence.missing_payments(evidence.corroborate(sources), sources["ledger"], "ledger")
    return missing.select("entity", "score", "mentions", "verdict", "severity")


#: Members of the conversations: the assistant is the device's owner, in one conversation of eleven without a connection.
_M = """m AS (SELECT conv_id AS group_id, min(turn) AS seq, role AS display_name, CASE WHEN role = 'assistant' AND conv_id % 11 <> 0 THEN 'k-owner' WHEN role = 'user' THEN 'k' || conv_id % 40 * 5 END AS connection,
    CASE role WHEN 'assistant' THEN 'XX99' WHEN 'user' THEN 'XX' || conv_id % 40 END AS masked_phone, role = 'system' AND conv_id % 2 = 0 AS deleted FROM conversations WHERE role IS NOT NULL AND NOT (conv_id % 13 = 0 AND role <> 'assistant') GROUP BY conv_id, role),
  people AS (SELECT 'k' || c_custkey AS connection, CASE WHEN c_custkey % 10 <> 0 THEN '9' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') END AS phone, c_name AS name FROM customer),
  oc AS (SELECT connection AS k FROM m WHERE connection IS NOT NULL GROUP BY 1 ORDER BY count(DISTINCT group_id) DESC, 1 LIMIT 1),
  om AS (SELECT masked_phone AS k FROM m WHERE masked_phone IS NOT NULL GROUP BY 1 ORDER BY count(DISTINCT group_id) DESC, 1 LIMIT 1),
  marked AS (SELECT *, coalesce(CASE WHEN connection IS NOT NULL THEN connection = (SELECT k FROM oc) ELSE masked_phone = (SELECT k FROM om) END, false) AS is_owner,
    connection IS DISTINCT FROM (SELECT k FROM oc) AS strange FROM m)"""


def _members(spark, sf_dir):
    c = F.col
    rows = table(spark, sf_dir, "conversations").filter("role is not null and not (conv_id % 13 = 0 and role <> 'assistant')").groupBy(c("conv_id").alias("group_id"), c("role").alias("display_name")).agg(F.min("turn").alias("seq"))
    role, conv = c("display_name"), c("group_id")
    connection = F.when((role == "assistant") & (conv % 11 != 0), "k-owner").when(role == "user", _tag("k", conv % 40 * 5))
    masked = F.when(role == "assistant", "XX99").when(role == "user", _tag("XX", conv % 40))
    return rows.withColumns({"connection": connection, "masked_phone": masked, "deleted": (role == "system") & (conv % 2 == 0)})


def _people(spark, sf_dir):
    number = F.col("c_custkey")
    phone = F.when(number % 10 != 0, F.concat(F.lit("9"), F.lpad(number.cast("string"), 9, "0")))
    return table(spark, sf_dir, "customer").select(_tag("k", number).alias("connection"), phone.alias("phone"), F.col("c_name").alias("name"))


@register(f"""WITH {_M}, k AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY CASE WHEN NOT is_owner THEN 0 WHEN strange THEN 1 ELSE 2 END, seq, connection NULLS FIRST) AS n FROM marked),
  s AS (SELECT group_id, count(*) FILTER (NOT deleted) AS n_members, count(*) FILTER (NOT is_owner) AS n_others, bool_or(is_owner) AS owner_present, max(connection) FILTER (n = 1) AS other_connection,
    max(display_name) FILTER (n = 1) AS other_display_name, max(masked_phone) FILTER (n = 1) AS other_masked_phone FROM k GROUP BY group_id)
  SELECT g.group_id, coalesce(n_members, 0) AS n_members, coalesce(n_others, 0) AS n_others, coalesce(owner_present, false) AS owner_present, other_connection, other_display_name, other_masked_phone, phone AS other_phone, name AS other_name,
    coalesce(n_members, 0) > 2 AS is_group FROM (SELECT DISTINCT conv_id AS group_id FROM conversations) g LEFT JOIN s USING (group_id) LEFT JOIN people p ON p.connection = other_connection""")
def conversations_with_owner(spark, sf_dir):
    groups = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("group_id")).distinct()
    return chats.conversations(groups, _members(spark, sf_dir), _people(spark, sf_dir))


@register(f"WITH {_M} SELECT DISTINCT group_id, phone FROM marked JOIN people USING (connection) WHERE NOT is_owner AND phone IS NOT NULL")
def conversation_phones(spark, sf_dir):
    return chats.member_phones(_members(spark, sf_dir), _people(spark, sf_dir))


#: Contacts in four shapes (two rows a phone, address only, connection only, nothing), a phonebook, payments with parts of an identity, and chats.
_G = f"""{_T}, c AS (SELECT c_custkey AS seq, CASE WHEN c_custkey % 4 < 2 THEN '9' || lpad(CAST(c_custkey - c_custkey % 2 AS VARCHAR), 9, '0') END AS phone,
    CASE WHEN c_custkey % 4 = 2 OR c_custkey % 4 < 2 AND c_custkey % 3 = 0 THEN 'v' || c_custkey || '@x' END AS vpa, CASE WHEN c_custkey % 5 = 0 OR c_custkey % 8 = 3 THEN 'k' || c_custkey END AS connection,
    CASE WHEN c_custkey % 7 <> 0 THEN c_name ELSE ' ' END AS name, CASE c_custkey % 6 WHEN 0 THEN true WHEN 1 THEN false END AS on_app, CASE WHEN c_custkey % 2 = 1 THEN 'LINKED' END AS upi_state FROM customer),
  book AS (SELECT s_suppkey AS seq, CASE WHEN s_suppkey % 3 = 0 THEN '9' || lpad(CAST(s_suppkey * 28 AS VARCHAR), 9, '0') ELSE '8' || lpad(CAST(s_suppkey // 2 AS VARCHAR), 9, '0') END AS number, CASE WHEN s_suppkey % 5 <> 0 THEN s_name END AS name FROM supplier),
  pay AS (SELECT *, CASE WHEN id % 13 = 0 THEN '7' || lpad(CAST(party % 30 AS VARCHAR), 9, '0') WHEN id % 3 = 0 THEN '9' || lpad(CAST(party - party % 2 AS VARCHAR), 9, '0') END AS phone,
    CASE WHEN id % 13 = 0 OR id % 17 = 0 THEN 'w' || party % 20 || '@y' WHEN id % 3 = 1 THEN 'v' || party || '@x' END AS vpa, CASE WHEN id % 11 <> 0 THEN 'n' || party % 50 ELSE '' END AS party_name FROM t),
  mem AS (SELECT DISTINCT conv_id AS group_id, conv_id * 10 + (role = 'user')::INT AS member, CASE WHEN role = 'user' AND conv_id % 3 <> 0 THEN 'k' || conv_id * 5 END AS connection, role AS display_name, role = 'assistant' AS is_self,
    CASE WHEN role = 'user' THEN conv_id % 2 = 0 END AS on_app FROM conversations WHERE role IN ('user', 'assistant')),
  msg AS (SELECT conv_id AS thread, CASE role WHEN 'assistant' THEN true WHEN 'user' THEN false END AS sender_is_self, conv_id * 10 + (role = 'user')::INT AS sender_member, conv_id * 10 + 1 AS receiver_member, turn % 4 = 1 AS is_payment, turn * 100 AS paise FROM conversations),
  keyed AS (SELECT *, coalesce(phone, vpa, connection, 'unidentified::' || seq) AS node_id FROM c),
  base0 AS (SELECT node_id, CASE WHEN bool_or(coalesce(phone, vpa, connection) IS NOT NULL) THEN 'CONTACT' ELSE 'CONTACT_UNIDENTIFIED' END AS kind, first(name ORDER BY seq) FILTER (trim(name) <> '') AS name, max(phone) AS phone,
    first(vpa ORDER BY seq) FILTER (vpa IS NOT NULL) AS vpa, first(connection ORDER BY seq) FILTER (connection IS NOT NULL) AS connection, first(upi_state ORDER BY seq) FILTER (upi_state IS NOT NULL) AS upi_state, bool_or(on_app) AS on_app FROM keyed GROUP BY node_id),
  bk AS (SELECT number, first(name ORDER BY seq) FILTER (name IS NOT NULL) AS book_name, first(name ORDER BY seq) AS first_name FROM book GROUP BY number),
  base AS (SELECT node_id, kind, coalesce(name, book_name) AS name, phone, vpa, connection, on_app, upi_state, 0 AS part FROM base0 LEFT JOIN bk ON number = phone
    UNION ALL SELECT number, 'PHONEBOOK_ONLY', first_name, number, NULL, NULL, NULL, NULL, 1 FROM bk WHERE number NOT IN (SELECT node_id FROM base0)),
  fv AS (SELECT vpa, arg_min(node_id, seq) AS node FROM keyed WHERE vpa IS NOT NULL GROUP BY vpa), fc AS (SELECT connection, arg_min(node_id, seq) AS node FROM keyed WHERE connection IS NOT NULL GROUP BY connection),
  p1 AS (SELECT pay.*, pay.phone IN (SELECT phone FROM c WHERE phone IS NOT NULL) IS TRUE AS by_phone, fv.node AS by_vpa FROM pay LEFT JOIN fv USING (vpa)),
  pt AS (SELECT vpa, min(phone) AS partner FROM p1 WHERE NOT by_phone AND by_vpa IS NULL AND phone IS NOT NULL AND vpa IS NOT NULL GROUP BY vpa),
  p2 AS (SELECT p1.*, CASE WHEN by_phone THEN phone WHEN by_vpa IS NOT NULL THEN by_vpa ELSE coalesce(phone, partner, vpa, nullif(party_name, '')) END AS node_id,
    CASE WHEN by_phone THEN 'phone' WHEN by_vpa IS NOT NULL THEN 'vpa' WHEN coalesce(phone, partner, vpa, nullif(party_name, '')) IS NOT NULL THEN 'derived' END AS matched_by FROM p1 LEFT JOIN pt USING (vpa)),
  fl AS (SELECT node_id, 'TXN_DERIVED' AS kind, min(nullif(party_name, '')) AS name, min(phone) AS phone, min(vpa) AS vpa, 2 AS part, count(*) FILTER (direction = 'IN') AS n_in, count(*) FILTER (direction = 'OUT') AS n_out,
    sum(paise) FILTER (direction = 'IN' AND state = 'COMPLETED') AS paise_in, sum(paise) FILTER (direction = 'OUT' AND state = 'COMPLETED') AS paise_out, min(ms) AS first_ms, max(ms) AS last_ms FROM p2 WHERE node_id IS NOT NULL GROUP BY node_id),
  solo AS (SELECT group_id AS thread, min(connection) AS connection, min(display_name) AS display_name, bool_or(on_app) AS on_app FROM mem WHERE NOT is_self GROUP BY 1 HAVING count(*) = 1 AND min(connection) IS NOT NULL),
  m1 AS (SELECT msg.*, coalesce(o.connection, solo.connection) AS connection, coalesce(o.display_name, solo.display_name) AS label, coalesce(o.on_app, solo.on_app) AS on_app
    FROM msg LEFT JOIN mem o ON o.member = CASE WHEN sender_is_self THEN receiver_member WHEN NOT sender_is_self THEN sender_member END LEFT JOIN solo USING (thread)),
  m2 AS (SELECT m1.*, coalesce(fc.node, 'chat::conn::' || m1.connection, 'chat::thread::' || thread) AS node_id FROM m1 LEFT JOIN fc ON fc.connection = m1.connection),
  ch AS (SELECT node_id, CASE WHEN max(connection) IS NULL THEN 'CHAT_THREAD_ONLY' ELSE 'CHAT_DERIVED' END AS kind, coalesce(min(label), CASE WHEN max(connection) IS NULL THEN min(CAST(thread AS VARCHAR)) END) AS name, max(connection) AS connection,
    bool_or(on_app) AS on_app, 3 AS part, count(*) AS n_messages, count(*) FILTER (is_payment) AS n_chat_payments, sum(paise) FILTER (is_payment) AS paise_chat FROM m2 GROUP BY node_id),
  allp AS (SELECT * FROM base UNION ALL BY NAME SELECT * FROM fl UNION ALL BY NAME SELECT * FROM ch),
  nodes AS (SELECT node_id, first(kind ORDER BY part) AS kind, first(name ORDER BY part) AS name, first(phone ORDER BY part) AS phone, first(vpa ORDER BY part) AS vpa, first(connection ORDER BY part) AS connection, first(on_app ORDER BY part) AS on_app,
    first(upi_state ORDER BY part) AS upi_state, """ + ", ".join(f"CAST(coalesce(sum({x}), 0) AS BIGINT) AS {x}" for x in ("n_in", "n_out", "paise_in", "paise_out", "n_messages", "n_chat_payments", "paise_chat")) + """,
    min(first_ms) AS first_ms, max(last_ms) AS last_ms, concat_ws(',', CASE WHEN min(part) = 0 THEN 'contacts' END, CASE WHEN min(part) = 1 THEN 'phonebook' END, CASE WHEN bool_or(part = 2) THEN 'payments' END, CASE WHEN bool_or(part = 3) THEN 'chat' END) AS evidence
    FROM allp GROUP BY node_id)"""


def _parties(spark, sf_dir):
    c, nine = F.col, lambda prefix, n: F.concat(F.lit(prefix), F.lpad(n.cast("string"), 9, "0"))
    k = c("c_custkey").cast("long")
    vpa = lambda n: F.concat(F.lit("v"), n.cast("string"), F.lit("@x"))
    contacts = table(spark, sf_dir, "customer").select(
        k.alias("seq"), F.when(k % 4 < 2, nine("9", k - k % 2)).alias("phone"), F.when((k % 4 == 2) | (k % 4 < 2) & (k % 3 == 0), vpa(k)).alias("vpa"), F.when((k % 5 == 0) | (k % 8 == 3), _tag("k", k)).alias("connection"),
        F.when(k % 7 != 0, c("c_name")).otherwise(" ").alias("name"), F.when(k % 6 == 0, True).when(k % 6 == 1, False).alias("on_app"), F.when(k % 2 == 1, "LINKED").alias("upi_state"),
    )
    s = c("s_suppkey").cast("long")
    book = table(spark, sf_dir, "supplier").select(s.alias("seq"), F.when(s % 3 == 0, nine("9", s * 28)).otherwise(nine("8", F.floor(s / 2))).alias("number"), F.when(s % 5 != 0, c("s_name")).alias("name"))
    i, p = c("id"), c("party")
    phone = F.when(i % 13 == 0, nine("7", p % 30)).when(i % 3 == 0, nine("9", p - p % 2))
    address = F.when((i % 13 == 0) | (i % 17 == 0), F.concat(F.lit("w"), (p % 20).cast("string"), F.lit("@y"))).when(i % 3 == 1, vpa(p))
    paid = payments(spark, sf_dir).withColumns({"phone": phone, "vpa": address, "party_name": F.when(i % 11 != 0, _tag("n", p % 50)).otherwise("")})
    talk, g, role = table(spark, sf_dir, "conversations"), c("conv_id"), c("role")
    member, user = g * 10 + (role == "user").cast("int"), role == "user"
    members = talk.filter("role in ('user', 'assistant')").select(
        member.alias("member"), g.alias("group_id"), F.when(user & (g % 3 != 0), _tag("k", g * 5)).alias("connection"), role.alias("display_name"), (role == "assistant").alias("is_self"), F.when(user, g % 2 == 0).alias("on_app"),
    ).distinct().withColumn("seq", c("member"))
    sent = F.when(role == "assistant", True).when(user, False)
    messages = talk.select(g.alias("thread"), sent.alias("sender_is_self"), member.alias("sender_member"), (g * 10 + 1).alias("receiver_member"), (c("turn") % 4 == 1).alias("is_payment"), (c("turn") * 100).alias("paise"))
    return contacts, book, paid, members, messages


@register(f"WITH {_G} SELECT *, n_in + n_out + n_messages / 5.0::DOUBLE AS rank, CASE WHEN kind = 'CHAT_THREAD_ONLY' THEN '{graph.NOTE}' END AS note FROM nodes")
def counterparty_graph(spark, sf_dir):
    return graph.counterparty_graph(*_parties(spark, sf_dir))


@register(f"""WITH {_G} SELECT count(*) AS n_nodes, count(*) FILTER (n_in + n_out > 0) AS n_with_payments, count(*) FILTER (n_messages > 0) AS n_with_chat, count(*) FILTER (kind = 'CHAT_THREAD_ONLY') AS n_threads_alone,
  count(*) FILTER (on_app) AS n_on_app, count(*) FILTER (on_app IS NULL) AS n_app_unknown FROM nodes""")
def graph_summary(spark, sf_dir):
    return graph.graph_summary(graph.counterparty_graph(*_parties(spark, sf_dir)))


@register(f"WITH {_G} SELECT id, node_id, matched_by FROM p2")
def payment_attribution(spark, sf_dir):
    contacts, _, paid, _, _ = _parties(spark, sf_dir)
    return graph.attribute_payments(paid, graph.keyed_contacts(contacts)).select("id", "node_id", "matched_by")
