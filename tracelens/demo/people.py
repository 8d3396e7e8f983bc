"""Queries of contacts and chat threads over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelens.demo.adapter import payments, table
from tracelens.demo.ledger import _B, _payments
from tracelens.demo.queries import _FLOW, _T, register
from tracelens.operators import contacts, threads

_NINE = "'9' || lpad(CAST({0} AS VARCHAR), 9, '0')"

#: Customers as contacts of three tables (two rows for some phones, whose flags disagree), suppliers as the phonebook, and looked-up numbers.
_C = f"""con AS (
    SELECT c_custkey AS seq, 'phone contacts' AS source, 'k' || c_custkey // 2 AS connection, {_NINE.format('c_custkey - c_custkey % 2')} AS phone, NULL AS vpa, CASE WHEN c_custkey // 2 % 3 = 0 AND c_custkey // 2 < (SELECT count(*) FROM supplier) THEN s_name ELSE 'bank ' || c_custkey END AS name, 'bank ' || c_custkey AS bank_name,
      CASE c_custkey % 5 WHEN 0 THEN true WHEN 1 THEN false END AS on_app, CASE c_custkey % 4 WHEN 0 THEN 'ON' WHEN 1 THEN 'OFF' END AS upi_state FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey // 2 AND s_suppkey % 3 = 0
    UNION ALL SELECT c_custkey, 'address contacts', CASE WHEN c_custkey % 2 = 0 THEN 'k' || c_custkey END, NULL, 'v' || c_custkey || '@x', CASE WHEN c_custkey % 4 = 0 THEN 'nick ' || c_custkey ELSE 'b ' || c_custkey END, 'b ' || c_custkey, NULL, NULL FROM customer WHERE c_custkey % 3 = 0
    UNION ALL SELECT c_custkey, 'payment profiles', NULL, CASE WHEN c_custkey % 10 <> 5 THEN {_NINE.format('c_custkey')} END, CASE WHEN c_custkey % 10 = 5 THEN 'v' || c_custkey || '@x' END, c_name, NULL, NULL, NULL FROM customer WHERE c_custkey % 5 = 0),
  people AS (SELECT *, coalesce(connection, phone, vpa, source || '#' || seq) AS person FROM con),
  book AS (SELECT s_suppkey AS contact_id, 'l' || s_suppkey % 50 AS lookup, '+91 ' || {_NINE.format('s_suppkey')} AS raw_number, {_NINE.format('s_suppkey')} AS number, CASE WHEN s_suppkey % 50 < 30 THEN 'meta ' || s_suppkey % 50 END AS name, CASE WHEN s_suppkey % 50 < 30 THEN CAST(s_suppkey % 50 * 3 AS BIGINT) ELSE 0 END AS image_size,
    s_suppkey % 2 = 0 AS is_valid, s_suppkey % 4 = 3 AS deleted FROM supplier),
  str AS (SELECT 'k' || n_nationkey AS connection, CASE WHEN n_nationkey % 2 = 0 THEN 'CONTACT_SEARCH' ELSE 'CHAT' END AS use_case, CASE WHEN n_nationkey % 3 <> 0 THEN {_NINE.format('n_nationkey')} END AS phone, CASE WHEN n_nationkey % 3 <> 0 THEN {_NINE.format('n_nationkey')} END AS number, n_nationkey % 2 = 1 AS known, false AS hidden, n_name AS region FROM nation)"""


def _nine(v):
    return F.concat(F.lit("9"), F.lpad(v.cast("string"), 9, "0"))


def _text(mark, v):
    return F.concat(F.lit(mark), v.cast("string"))


def _contacts(spark, sf_dir):
    k = F.col("c_custkey").cast("long")
    c = table(spark, sf_dir, "customer")
    half = F.floor(k / 2)
    phones = c.select(
        k.alias("seq"), F.concat(F.lit("+91"), _nine(k - k % 2)).alias("phone"), _text("k", half).alias("connection"), _text("bank ", k).alias("bank_name"), F.when(k % 5 == 0, "1").when(k % 5 == 1, "no").alias("on_app"), F.when(k % 4 == 0, "ON").when(k % 4 == 1, "OFF").alias("upi_state"),
    )
    addresses = c.filter("c_custkey % 3 = 0").select(k.alias("seq"), F.concat(_text("v", k), F.lit("@x")).alias("vpa"), F.when(k % 4 == 0, _text("nick ", k)).otherwise("").alias("nick_name"), _text("b ", k).alias("bank_name"), F.when(k % 2 == 0, _text("k", k)).alias("connection"))
    none = F.lit(None).cast("string")
    profiles = c.filter("c_custkey % 5 = 0").select(k.alias("seq"), F.when(k % 10 == 5, F.concat(_text("v", k), F.lit("@x"))).otherwise(_nine(k)).alias("destination"), F.col("c_name").alias("name"), none.alias("bank_name"), none.alias("connection"))
    names = table(spark, sf_dir, "supplier").filter("s_suppkey % 3 = 0").select(_text("k", F.col("s_suppkey")).alias("connection"), F.col("s_name").alias("name"))
    return contacts.contact_rows(phones, addresses, profiles, names)


def _phonebook(spark, sf_dir):
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier")
    entries = s.select(k.alias("contact_id"), _text("l", k % 50).alias("lookup"), F.concat(F.lit("+91 "), _nine(k)).alias("raw_number"), (k % 2 == 0).alias("is_valid"), (k % 4).alias("change_state"))
    metadata = s.filter("s_suppkey % 50 < 30").select(_text("l", k % 50).alias("lookup"), _text("meta ", k % 50).alias("display_name"), (k % 50 * 3).cast("long").alias("image_size"))
    return contacts.phonebook_rows(entries, metadata)


def _strangers(spark, sf_dir):
    k = F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").select(_text("k", k).alias("connection"), F.when(k % 2 == 0, "CONTACT_SEARCH").otherwise("CHAT").alias("use_case"), F.when(k % 3 == 0, "None").otherwise(_nine(k)).alias("phone"), F.when(k % 2 == 1, "true").otherwise("0").alias("known"), F.lit(None).cast("string").alias("hidden"), F.col("n_name").alias("region"))
    return contacts.stranger_rows(rows)


@register(f"WITH {_C} SELECT people.*, count(*) OVER (PARTITION BY person) AS n_rows FROM people")
def contact_rows(spark, sf_dir):
    return contacts.with_row_counts(_contacts(spark, sf_dir))


@register(f"""WITH {_C}, f AS (SELECT person, 'on_app' AS field, CAST(on_app AS VARCHAR) AS value FROM people UNION ALL SELECT person, 'upi_state', upi_state FROM people),
  s AS (SELECT person, field, array_to_string(list_sort(list_distinct(list(value))), ',') AS stated FROM f WHERE value IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT value) > 1)
  SELECT s.*, (SELECT coalesce(array_to_string(list_sort(list_distinct(list(phone))), ','), '') FROM people p WHERE p.person = s.person AND phone IS NOT NULL) AS phones FROM s""")
def contact_contradictions(spark, sf_dir):
    return contacts.contradictions(_contacts(spark, sf_dir))


@register(f"""WITH {_C}, p AS (SELECT person, bool_or(on_app) AS o, count(*) AS n FROM people GROUP BY person)
  SELECT (SELECT count(*) FROM p) AS n_people, (SELECT count(*) FROM people) AS n_rows, (SELECT count(*) FROM p WHERE o) AS n_on_app, (SELECT count(vpa) FROM people) AS n_with_address, (SELECT count(*) FROM p WHERE n > 1) AS n_several_rows,
    (SELECT count(*) FROM book) AS n_phonebook, (SELECT count(*) FROM book WHERE deleted) AS n_deleted, (SELECT count(*) FROM str) AS n_strangers, (SELECT count(phone) FROM str) AS n_strangers_with_phone, (SELECT count(*) FROM str WHERE use_case = 'CONTACT_SEARCH') AS n_looked_up""")
def contact_summary(spark, sf_dir):
    return contacts.contact_summary(_contacts(spark, sf_dir), _phonebook(spark, sf_dir), _strangers(spark, sf_dir))


@register(f"WITH {_C} SELECT * FROM book")
def phonebook_rows(spark, sf_dir):
    return _phonebook(spark, sf_dir)


@register(f"WITH {_C} SELECT * FROM str")
def stranger_rows(spark, sf_dir):
    return _strangers(spark, sf_dir)


@register(f"""WITH v AS (SELECT c_custkey AS seq, {_NINE.format('c_custkey % 700')} AS phone, c_name AS verified, CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS on_app, 'k' || c_custkey AS connection FROM customer QUALIFY row_number() OVER (PARTITION BY c_custkey % 700 ORDER BY c_custkey DESC) = 1),
  n AS (SELECT s_suppkey AS seq, {_NINE.format('s_suppkey * 11 % 900')} AS phone, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS cbs, s_suppkey % 4 = 0 AS on_app, 's' || s_suppkey AS connection, CASE WHEN s_suppkey % 5 = 0 THEN 'img' || s_suppkey ELSE '' END AS image_url FROM supplier),
  g AS (SELECT phone, first(cbs ORDER BY seq) FILTER (cbs IS NOT NULL) AS cbs, first(on_app ORDER BY seq) AS on_app, first(connection ORDER BY seq) AS connection, first(image_url ORDER BY seq) FILTER (image_url <> '') AS image_url FROM n GROUP BY phone)
  SELECT phone, verified, cbs, coalesce(v.on_app, g.on_app) AS on_app, CASE WHEN v.seq IS NOT NULL THEN v.connection ELSE g.connection END AS connection, image_url FROM v FULL OUTER JOIN g USING (phone)""")
def contact_dimension(spark, sf_dir):
    k, s = F.col("c_custkey").cast("long"), F.col("s_suppkey").cast("long")
    verified = table(spark, sf_dir, "customer").select(k.alias("seq"), _nine(k % 700).alias("phone"), F.col("c_name").alias("verified"), F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("on_app"), _text("k", k).alias("connection"))
    strangers = table(spark, sf_dir, "supplier").select(s.alias("seq"), _nine(s * 11 % 900).alias("phone"), F.when(s % 2 == 0, F.col("s_name")).alias("cbs"), (s % 4 == 0).alias("on_app"), _text("s", s).alias("connection"), F.when(s % 5 == 0, _text("img", s)).otherwise("").alias("image_url"))
    return contacts.contact_dimension(verified, strangers)


@register(f"""WITH r AS (SELECT 0 AS place, c_custkey AS seq, 'k' || c_custkey % 800 AS connection, CASE WHEN c_custkey % 3 = 0 THEN {_NINE.format('c_custkey')} END AS phone, CASE WHEN c_custkey % 4 = 0 THEN c_name ELSE '' END AS verified, NULL AS cbs FROM customer
    UNION ALL SELECT 1, s_suppkey, 'k' || s_suppkey, {_NINE.format('s_suppkey')}, NULL, s_name FROM supplier)
  SELECT connection, first(phone ORDER BY place, seq) FILTER (phone IS NOT NULL) AS phone, first(verified ORDER BY place, seq) FILTER (verified <> '') AS verified, first(cbs ORDER BY place, seq) FILTER (cbs IS NOT NULL) AS cbs FROM r GROUP BY connection""")
def connection_directory(spark, sf_dir):
    k, s, none = F.col("c_custkey").cast("long"), F.col("s_suppkey").cast("long"), F.lit(None).cast("string")
    mine = table(spark, sf_dir, "customer").select(k.alias("seq"), _text("k", k % 800).alias("connection"), F.when(k % 3 == 0, _nine(k)).alias("phone"), F.when(k % 4 == 0, F.concat(F.col("c_name"), F.lit(" "))).otherwise("").alias("verified"), none.alias("cbs"))
    theirs = table(spark, sf_dir, "supplier").select(s.alias("seq"), _text("k", s).alias("connection"), _nine(s).alias("phone"), none.alias("verified"), F.col("s_name").alias("cbs"))
    return contacts.connection_directory({"verified": mine, "strangers": theirs})


@register(f"SELECT {_NINE.format('c_custkey % 400')} AS phone, first(c_name ORDER BY c_custkey) AS name FROM customer WHERE c_custkey % 3 <> 0 GROUP BY 1")
def saved_names(spark, sf_dir):
    k = F.col("c_custkey")
    return contacts.saved_names(table(spark, sf_dir, "customer").select(k.alias("seq"), F.concat(F.lit("0"), _nine(k % 400)).alias("number"), F.when(k % 3 == 0, " ").otherwise(F.col("c_name")).alias("name")))


#: Talk of the conversations: the assistant owns the device, one conversation in six has no size, and each user's connection is in several.
_TALK = """mem AS (SELECT DISTINCT conv_id AS group_id, conv_id * 3 + (role = 'user')::INT + 2 * (role = 'system')::INT AS member, role, CASE WHEN role <> 'system' THEN 'k' || conv_id % 30 * (role = 'user')::INT END AS connection FROM conversations WHERE role IN ('user', 'assistant', 'system')),
  sizes AS (SELECT group_id, CASE WHEN group_id % 6 <> 0 THEN count(*) END AS size FROM mem GROUP BY group_id)"""


def _members(spark, sf_dir):
    g, role = F.col("conv_id"), F.col("role")
    member = g * 3 + F.when(role == "user", 1).when(role == "system", 2).otherwise(0)
    connection = F.when(role != "system", _text("k", g % 30 * (role == "user").cast("int")))
    rows = table(spark, sf_dir, "conversations").filter("role in ('user', 'assistant', 'system')").select(g.alias("group_id"), member.alias("member"), role.alias("role"), connection.alias("connection")).distinct()
    return rows.withColumn("seq", F.col("member"))


@register(f"""WITH {_C}, {_TALK}, b AS (SELECT connection, arg_min(m.group_id, coalesce(size, 99) * 1000000 + member) AS chat_group FROM mem m JOIN sizes USING (group_id) WHERE role <> 'assistant' AND connection IS NOT NULL GROUP BY connection)
  SELECT source, seq, chat_group FROM con LEFT JOIN b USING (connection)""")
def contact_chat_links(spark, sf_dir):
    members = _members(spark, sf_dir)
    sizes = members.groupBy("group_id").agg(F.when(F.col("group_id") % 6 != 0, F.count(F.lit(1))).alias("size"))
    linked = contacts.chat_links(_contacts(spark, sf_dir), members.withColumn("is_self", F.col("role") == "assistant"), sizes)
    return linked.select("source", "seq", "chat_group")


@register(f"WITH {_T}, g AS (SELECT party, {_FLOW} FROM t GROUP BY party) SELECT c_custkey AS party, c_name AS name, coalesce(n_in, 0) AS n_in, coalesce(paise_in, 0) AS paise_in, coalesce(n_out, 0) AS n_out, coalesce(paise_out, 0) AS paise_out FROM customer LEFT JOIN g ON party = c_custkey")
def contacts_with_activity(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("party"), F.col("c_name").alias("name"))
    return contacts.contact_activity(people, payments(spark, sf_dir), "party")


@register(f"""WITH {_C}, {_T}, p AS (SELECT * FROM t WHERE contains(lower(CAST(party AS VARCHAR)), '00') OR contains('tok' || id || ' x00y', '0099')), g AS (SELECT conv_id FROM (SELECT DISTINCT conv_id FROM conversations) WHERE contains('chat ' || conv_id || '00', '00')),
  f AS (SELECT {_FLOW} FROM t WHERE contains('v' || party || '@00', '00') AND id % 3 = 0 OR contains(CAST(party AS VARCHAR), '00') OR contains('tok' || id, '00'))
  SELECT (SELECT count(*) FROM t WHERE id % 3 = 0 OR contains(CAST(party AS VARCHAR), '00') OR contains('tok' || id, '00')) AS n_payments, f.*, paise_in - paise_out AS net,
    (SELECT count(*) FROM con WHERE contains(lower(coalesce(phone, '')), '00') OR contains(lower(coalesce(name, '')), '00') OR contains(lower(coalesce(vpa, '')), '00') OR contains(lower(coalesce(bank_name, '')), '00')) + (SELECT count(*) FROM book WHERE contains(number, '00') OR contains(lower(coalesce(name, '')), '00') OR contains(raw_number, '00')) AS n_contacts,
    (SELECT count(*) FROM conversations WHERE conv_id % 7 = 0) AS n_messages, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'A' AND l_orderkey IN (SELECT id FROM t WHERE id % 3 = 0 OR contains(CAST(party AS VARCHAR), '00') OR contains('tok' || id, '00'))) AS n_rewards FROM f""")
def counterparty_profile(spark, sf_dir):
    i = F.col("id")
    paid = payments(spark, sf_dir).withColumns({"phone": F.lit(None).cast("string"), "vpa": F.when(i % 3 == 0, F.concat(_text("v", F.col("party")), F.lit("@00"))), "search_tokens": F.array(_text("TOK", i), F.lit("x"))})
    g = F.col("conv_id")
    talk = table(spark, sf_dir, "conversations").select(g.alias("group_id"), "turn")
    groups = talk.select("group_id").distinct().select("group_id", F.when(F.col("group_id") % 7 == 0, "Club 00").otherwise("Other").alias("name"))
    rewards = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("payment"))
    return contacts.profile("00", _contacts(spark, sf_dir), _phonebook(spark, sf_dir), paid, groups, talk, rewards)["summary"]


#: Conversation rows as chat messages: cards of five types by turn, some nested under content, and members whose names are masked for one connection in four.
_M = f"""{_TALK}, mr AS (SELECT group_id, member, role, connection, CASE WHEN role = 'user' AND group_id % 4 = 0 THEN '****' || group_id ELSE role || ' ' || group_id END AS display_name, CASE WHEN role = 'user' THEN '******' || group_id END AS masked_phone, role = 'assistant' AND group_id % 9 <> 0 AS is_self,
    CASE WHEN role = 'user' AND group_id % 4 = 0 AND group_id % 30 < 25 THEN 'real k' || group_id % 30 END AS name_resolved, CASE WHEN role = 'user' AND group_id % 30 < 25 THEN {_NINE.format('group_id % 30')} WHEN role = 'assistant' THEN {_NINE.format('0')} END AS phone_full, CASE WHEN role = 'system' THEN 'DELETED' ELSE 'ACTIVE' END AS state FROM mem),
  oth AS (SELECT group_id, count(*) AS n, min(display_name) AS other FROM mr WHERE NOT is_self GROUP BY group_id),
  x AS (SELECT conv_id, turn, role, text, conv_id % 9 <> 0 AS owned, turn % 6 AS k, CASE role WHEN 'assistant' THEN conv_id * 3 WHEN 'user' THEN conv_id * 3 + 1 ELSE conv_id * 3 + 2 END AS src FROM conversations WHERE role IN ('user', 'assistant', 'system')),
  msg AS (SELECT conv_id || '/' || turn AS message_id, conv_id AS group_id, CASE k WHEN 0 THEN 'PAYMENT_INFO_CARD' WHEN 1 THEN 'TRANSACTION_RECEIPT' WHEN 2 THEN 'EXPENSE_CARD_V2' WHEN 3 THEN 'SETTLEMENT_CARD' WHEN 4 THEN 'GROUP_ACTION' ELSE 'TEXT_MESSAGE' END AS kind,
    CASE k WHEN 0 THEN turn * 100 WHEN 1 THEN turn * 10 WHEN 2 THEN turn WHEN 3 THEN turn + 7 END AS paise, CASE k WHEN 0 THEN 'T' || conv_id WHEN 1 THEN 'T' || conv_id WHEN 2 THEN 'X' || conv_id WHEN 3 THEN 'S' || conv_id END AS payment_id, CASE k WHEN 2 THEN 'dinner' WHEN 4 THEN 'ADD: someone' END AS note,
    CASE k WHEN 0 THEN 'COMPLETED' WHEN 2 THEN 'OPEN' WHEN 3 THEN 'DONE' END AS state, CASE WHEN k = 1 THEN 'U' || turn END AS utr, CASE WHEN k = 5 THEN 'hello ' || turn END AS text, CASE WHEN owned THEN CASE x.role WHEN 'assistant' THEN 'OUT' ELSE 'IN' END ELSE 'UNKNOWN' END AS direction,
    CASE WHEN owned THEN CASE WHEN x.role = 'assistant' THEN coalesce(u.display_name, CASE WHEN k = 1 THEN 'R' END) ELSE s.display_name END END AS other_name, CASE WHEN owned THEN CASE WHEN x.role = 'assistant' THEN u.masked_phone ELSE s.masked_phone END END AS other_phone,
    CASE WHEN owned THEN CASE WHEN x.role = 'assistant' THEN u.name_resolved ELSE s.name_resolved END END AS other_resolved, CASE WHEN owned THEN CASE WHEN x.role = 'assistant' THEN u.phone_full WHEN x.role = 'user' THEN s.phone_full END END AS other_phone_full
    FROM x LEFT JOIN mr s ON s.member = src LEFT JOIN mr u ON u.member = conv_id * 3 + 1)"""


def _talk(spark, sf_dir):
    """(topics, member rows, message rows)"""
    g, role = F.col("group_id"), F.col("role")
    raw = _members(spark, sf_dir)
    topics = raw.select("group_id").distinct().select("group_id", F.when(g % 9 != 0, g * 3).alias("owner_member"), F.when(g % 5 == 0, _text("topic ", g)).alias("topic_name"))
    app_name = F.when((role == "user") & (g % 4 == 0), _text("****", g)).when(role != "system", F.concat(role, F.lit(" "), g.cast("string")))
    members = raw.select("seq", "member", "group_id", "connection", app_name.alias("app_name"), F.concat(role, F.lit(" "), g.cast("string")).alias("merchant_name"), F.when(role == "user", _text("******", g)).alias("masked_phone"), F.lit("1").alias("on_app"), (role == "system").cast("string").alias("deleted"))
    people = table(spark, sf_dir, "nation").select(_text("k", F.col("n_nationkey")).alias("connection"), _text("real k", F.col("n_nationkey")).alias("name"), _nine(F.col("n_nationkey")).alias("phone"))
    rows = threads.member_rows(members, topics, people)
    t, c = F.col("turn").cast("string"), F.col("conv_id").cast("string")
    put = lambda shape: F.replace(F.replace(F.lit(shape), F.lit("#"), t), F.lit("~"), c)
    k = F.col("turn") % 6
    to = F.concat(F.lit('"destination":{"groupMemberId":"'), (F.col("conv_id") * 3 + 1).cast("string"), F.lit('"},'))
    inner = (
        F.when(k == 0, put('"amount":"#00","transactionId":"T~","paymentState":"COMPLETED"')).when(k == 1, put('"transactionUnit":{"value":#0},"transactionId":"T~","utr":"U#","receiver":{"name":"R"}'))
        .when(k == 2, put('"amount":-5,"expenseInfo":{"expenseCard":{"cardInfo":{"totalAmount":#,"name":"dinner"},"status":"OPEN","expenseId":"X~"}}'))
        .when(k == 3, F.concat(F.lit('"settlementInfo":{"totalAmount":0,"globalSettlementAmount":'), (F.col("turn") + 7).cast("string"), put(',"status":"DONE","globalSettlementId":"S~"}')))
        .when(k == 4, F.lit('"groupAction":{"actionType":"ADD","name":"someone"}')).otherwise(put('"message":"hello #"'))
    )
    card = F.concat(F.lit("{"), to, inner, F.lit("}"))
    source = F.col("conv_id") * 3 + F.when(F.col("role") == "user", 1).when(F.col("role") == "system", 2).otherwise(0)
    content = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit('{"source":{"groupMemberId":"'), source.cast("string"), F.lit('"},"content":'), card, F.lit("}"))).otherwise(card)
    kind = F.element_at(F.array(*map(F.lit, ("PAYMENT_INFO_CARD", "TRANSACTION_RECEIPT", "EXPENSE_CARD_V2", "SETTLEMENT_CARD", "GROUP_ACTION", "TEXT_MESSAGE"))), (k + 1).cast("int"))
    said = table(spark, sf_dir, "conversations").filter("role in ('user', 'assistant', 'system')").select(
        F.concat_ws("/", c, t).alias("message_id"), F.col("conv_id").alias("group_id"), kind.alias("kind"), F.col("turn").alias("created_ms"), F.lit("0").alias("deleted"), source.alias("source_member"), content.alias("content"),
    )
    return topics, rows, threads.message_rows(said, topics, rows)


@register(f"WITH {_M} SELECT group_id, member, connection, display_name, masked_phone, is_self, name_resolved, phone_full, state FROM mr")
def chat_members(spark, sf_dir):
    return _talk(spark, sf_dir)[1].drop("seq", "on_app")


@register(f"""WITH {_M} SELECT group_id, CASE WHEN group_id % 5 = 0 THEN 'topic ' || group_id WHEN n = 1 THEN other ELSE CAST(group_id AS VARCHAR) END AS name, count(*) AS member_count FROM mr JOIN oth USING (group_id) GROUP BY group_id, n, other
  UNION ALL SELECT group_id, CASE WHEN group_id % 5 = 0 THEN 'topic ' || group_id ELSE CAST(group_id AS VARCHAR) END, count(*) FROM mr WHERE group_id NOT IN (SELECT group_id FROM oth) GROUP BY group_id""")
def chat_groups(spark, sf_dir):
    topics, members, _ = _talk(spark, sf_dir)
    return threads.group_rows(topics.select("group_id"), topics, members)


_MESSAGE = "message_id, group_id, kind, paise, payment_id, note, state, utr, text, direction, other_name, other_phone, other_resolved, other_phone_full"


@register(f"WITH {_M} SELECT {_MESSAGE} FROM msg")
def chat_messages(spark, sf_dir):
    return _talk(spark, sf_dir)[2].select(*_MESSAGE.split(", "))


@register(f"""WITH {_M} SELECT count(*) AS n_messages, count(*) FILTER (kind = 'PAYMENT_INFO_CARD') AS n_payment_cards, CAST(coalesce(sum(paise) FILTER (kind = 'PAYMENT_INFO_CARD'), 0) AS BIGINT) AS paise, count(*) FILTER (kind = 'TEXT_MESSAGE') AS n_texts,
  count(*) FILTER (kind IN ('SETTLEMENT_CARD', 'EXPENSE_CARD_V2')) AS n_requests FROM msg""")
def thread_summary(spark, sf_dir):
    return threads.thread_summary(_talk(spark, sf_dir)[2])


@register(f"""WITH {_B}, i AS (SELECT id AS ref, * FROM pay UNION ALL SELECT global_id, * FROM pay WHERE global_id IS NOT NULL), one AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY ref ORDER BY id) = 1),
  e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'OUT' ELSE 'IN' END AS direction, CASE WHEN event_id % 2 = 0 THEN 'E' || event_id ELSE 'G' || event_id // 13 || '-' || event_id % 7 END AS payment_id FROM events)
  SELECT event_id, classification, CASE WHEN direction = 'OUT' THEN sender_vpa ELSE receiver_vpa END AS owner_vpa, CASE WHEN direction = 'OUT' THEN receiver_vpa ELSE sender_vpa END AS counterparty_vpa,
    CASE WHEN direction = 'OUT' THEN sender_app_label ELSE receiver_app_label END AS owner_app, lower(nullif(split_part(CASE WHEN direction = 'OUT' AND contains(receiver_vpa, '@') THEN receiver_vpa WHEN direction <> 'OUT' AND contains(sender_vpa, '@') THEN sender_vpa END, '@', -1), '')) AS counterparty_psp
  FROM (SELECT event_id, e.direction, classification, sender_vpa, receiver_vpa, sender_app_label, receiver_app_label FROM e LEFT JOIN one ON ref = payment_id)""")
def routed_messages(spark, sf_dir):
    e = F.col("event_id")
    ref = F.when(e % 2 == 0, _text("E", e)).otherwise(F.concat(_text("G", F.floor(e / 13)), F.lit("-"), (e % 7).cast("string")))
    said = table(spark, sf_dir, "events").select("event_id", F.when(e % 3 == 0, "OUT").otherwise("IN").alias("direction"), ref.alias("payment_id"))
    return threads.routed(said, _payments(spark, sf_dir)).select("event_id", "classification", "owner_vpa", "counterparty_vpa", "owner_app", "counterparty_psp")
