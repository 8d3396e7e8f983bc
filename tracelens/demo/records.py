"""Queries of files, nested documents, delivered messages, identities and shared expenses over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelens.demo.adapter import table
from tracelens.demo.queries import register
from tracelens.functions.time import epoch_ms
from tracelens.operators import nested, shared
from tracelens.session import fresh_path
from tracelens.sources import files

_EXT = r"CASE WHEN regexp_matches(split_part({0}, '/', -1), '(?s)^.+\.[^.]*$') THEN lower(regexp_extract(split_part({0}, '/', -1), '(?s)^.+(\.[^.]*)$', 1)) ELSE '(noext)' END"


def _pages(spark, sf_dir):
    html = F.col("html")
    return table(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.octet_length(html).cast("long").alias("length"), html.cast("binary").alias("content"), "page_id")


@register(f"SELECT url AS path, split_part(url, '/', -1) AS name, {_EXT.format('url')} AS ext, CAST(strlen(html) AS BIGINT) AS size, sha256(html) AS sha256 FROM pages")
def page_files(spark, sf_dir):
    return files.file_inventory(_pages(spark, sf_dir)).drop("encrypted")


@register(f"SELECT {_EXT.format('url')} AS ext, count(*) AS n, CAST(sum(strlen(html)) AS BIGINT) AS bytes FROM pages GROUP BY 1")
def page_extensions(spark, sf_dir):
    return files.extension_counts(_pages(spark, sf_dir))


#: Containers of parts: one in three begins with the plain header.
@register("""SELECT 'db/' || p_partkey || '.Db' AS path, CASE WHEN p_partkey % 3 <> 0 THEN true ELSE false END AS encrypted FROM part WHERE p_partkey % 4 <> 0 UNION ALL SELECT 'db/' || p_partkey || '.log', NULL FROM part WHERE p_partkey % 4 = 0""")
def encrypted_containers(spark, sf_dir):
    p = F.col("p_partkey")
    path = F.concat(F.lit("db/"), p.cast("string"), F.when(p % 4 != 0, ".Db").otherwise(".log"))
    content = F.concat(F.when(p % 3 == 0, F.lit(files.PLAIN_HEADER)).otherwise(F.lit(b"salted bytes of ")), F.col("p_name").cast("binary"))
    rows = table(spark, sf_dir, "part").select(path.alias("path"), content.alias("content")).withColumn("length", F.octet_length("content"))
    return files.file_inventory(rows).select("path", "encrypted")


@register("""WITH d AS (SELECT 'events/' || event_id || '.json' AS path, event_id, CASE WHEN event_id % 7 = 0 THEN 'x' || props WHEN event_id % 11 = 0 THEN ' {"k": ' ELSE '  ' || props END AS content, props FROM events)
  SELECT path, CAST(strlen(content) AS BIGINT) AS size, CASE WHEN strlen(content) > 10 THEN 'over size cap' WHEN event_id % 7 = 0 THEN 'not json' WHEN event_id % 11 = 0 THEN 'undecodable' ELSE 'parsed' END AS status,
    CASE WHEN strlen(content) <= 10 AND event_id % 7 <> 0 AND event_id % 11 <> 0 THEN CAST(props->>'$.k' AS BIGINT) END AS k FROM d""")
def json_documents(spark, sf_dir):
    e, props = F.col("event_id"), F.col("props")
    content = F.when(e % 7 == 0, F.concat(F.lit("x"), props)).when(e % 11 == 0, ' {"k": ').otherwise(F.concat(F.lit("  "), props)).cast("binary")
    docs = table(spark, sf_dir, "events").select(F.concat(F.lit("events/"), e.cast("string"), F.lit(".json")).alias("path"), content.alias("content")).withColumn("length", F.octet_length("content"))
    return files.read_json_docs(docs, 10).select("path", "size", "status", F.try_variant_get("doc", "$.k", "bigint").alias("k"))


@register("""SELECT path AS name, size, kind, NULL::VARCHAR AS qr_payload FROM (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'ui/Bundles/' ELSE 'files/' END || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.png' WHEN 1 THEN '.JPeG' ELSE '.txt' END AS path,
    CAST(p_partkey * 10 AS BIGINT) AS size, CASE WHEN p_partkey % 2 = 0 THEN 'asset' ELSE 'media' END AS kind FROM part WHERE p_partkey % 3 <> 2)
  UNION ALL SELECT 'owner code ' || s_suppkey, 0, 'code', 'upi://pay?pa=' || s_suppkey FROM supplier""")
def media_files(spark, sf_dir):
    p, s = F.col("p_partkey"), F.col("s_suppkey").cast("string")
    path = F.concat(F.when(p % 2 == 0, "ui/Bundles/").otherwise("files/"), p.cast("string"), F.when(p % 3 == 0, ".png").when(p % 3 == 1, ".JPeG").otherwise(".txt"))
    listing = table(spark, sf_dir, "part").select(path.alias("path"), (p * 10).alias("length"))
    codes = table(spark, sf_dir, "supplier").select(F.concat(F.lit("owner code "), s).alias("filename"), F.concat(F.lit("upi://pay?pa="), s).alias("qr_payload"))
    return files.media_rows(listing, codes)


#: Maps in one preference file, about 4 MB. Fixed value.
PREFS_ROWS = 10_000


@register("""WITH c AS (SELECT c_custkey AS k, c_name AS n, c_acctbal AS b FROM customer)
  SELECT 'name' || k AS key, n AS value, 'string' AS value_type FROM c UNION ALL SELECT 'seq' || k, CAST(k AS VARCHAR), 'int' FROM c UNION ALL SELECT 'odd' || k, CASE WHEN k % 2 = 1 THEN 'true' ELSE 'false' END, 'boolean' FROM c
  UNION ALL SELECT 'big' || k, CASE WHEN k % 5 <> 0 THEN CAST(k * 1000000000 AS VARCHAR) END, 'long' FROM c UNION ALL SELECT 'tags' || k, '["a' || k || '","b"]', 'set' FROM c""")
def preferences(spark, sf_dir):
    """Customers as preference files, written to the shared folder and read as XML."""
    c = F.col("c_custkey")
    k = c.cast("string")
    entry = lambda name, value: F.array(F.struct(F.concat(F.lit(name), k).alias("_name"), value.alias("_value")))
    big = F.when(c % 5 != 0, F.concat(k, F.lit("000000000"))).otherwise("none")
    odd = F.when(c % 2 == 1, "true").otherwise("false")
    nameless = F.array(F.struct(F.concat(F.lit("seq"), k).alias("_name"), k.alias("_value")), F.struct(F.lit(None).cast("string").alias("_name"), F.lit("9").alias("_value")))
    rows = table(spark, sf_dir, "customer").select(
        F.array(F.struct(F.concat(F.lit("name"), k).alias("_name"), F.col("c_name").alias("text"))).alias("string"), nameless.alias("int"), entry("odd", odd).alias("boolean"), entry("big", big).alias("long"),
        F.array(F.struct(F.concat(F.lit("tags"), k).alias("_name"), F.array(F.concat(F.lit("a"), k), F.lit("b")).alias("string"))).alias("set"),
    )
    path = fresh_path(spark)
    # the reader gives a file to one task, whatever its length
    rows.write.format("xml").option("rootTag", "prefs").option("rowTag", "map").option("valueTag", "text").option("maxRecordsPerFile", PREFS_ROWS).save(path)
    return files.prefs_table(files.read_prefs_xml(spark, path)).select("key", "value", "value_type")


@register("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'ARRAY<BIGINT>' WHEN event_id % 3 = 1 THEN 'OBJECT<k: BIGINT>' ELSE 'STRING' END AS kind,
    CASE WHEN event_id % 3 = 0 THEN event_id WHEN event_id % 3 = 1 THEN CAST(props->>'$.k' AS BIGINT) END AS value, event_type FROM events""")
def decoded_columns(spark, sf_dir):
    e = F.col("event_id")
    text = F.when(e % 3 == 0, F.concat(F.lit("["), e.cast("string"), F.lit("]"))).when(e % 3 == 1, F.col("props")).otherwise(F.concat(F.lit("{not json "), e.cast("string"), F.lit("}")))
    rows = nested.decode_json_columns(table(spark, sf_dir, "events").select("event_id", text.alias("doc"), "event_type"))
    first = F.coalesce(F.try_variant_get("doc", "$[0]", "bigint"), F.try_variant_get("doc", "$.k", "bigint"))
    return rows.select("event_id", F.schema_of_variant("doc").alias("kind"), first.alias("value"), F.try_variant_get("event_type", "$", "string").alias("event_type"))


def _profiles(spark, sf_dir):
    """A nested document for each customer: phones at two depths, one of them masked, addresses in a list, and prose."""
    k = F.col("c_custkey")
    nine = F.concat(F.lit("9"), F.lpad(k.cast("string"), 9, "0"))
    vpa = F.concat(F.lit("V"), k.cast("string"), F.lit("@bank"))
    text = F.concat(F.lit("call +91-7"), F.lpad(k.cast("string"), 9, "0"), F.lit(" or write"))
    doc = F.struct(
        k.alias("id"), F.col("c_name").alias("name"), F.struct(F.struct(nine.alias("phone"), F.concat(F.lit("XXXXXX"), F.right(nine, F.lit(4))).alias("shown")).alias("main"), F.array(vpa, F.lit("none")).alias("vpas")).alias("contact"),
        F.array(F.struct(F.when(k % 3 == 0, text).alias("note"))).alias("notes"),
    )
    return table(spark, sf_dir, "customer").select("c_custkey", F.to_variant_object(doc).alias("doc"))


_PROFILE = """p AS (SELECT c_custkey, c_name, '9' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS phone, 'V' || c_custkey || '@bank' AS vpa,
  CASE WHEN c_custkey % 3 = 0 THEN 'call +91-7' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') || ' or write' END AS note FROM customer)"""


@register(f"""WITH {_PROFILE} SELECT c_custkey, 'id' AS path, CAST(c_custkey AS VARCHAR) AS value FROM p UNION ALL SELECT c_custkey, 'name', c_name FROM p UNION ALL SELECT c_custkey, 'contact.main.phone', phone FROM p
  UNION ALL SELECT c_custkey, 'contact.main.shown', 'XXXXXX' || right(phone, 4) FROM p UNION ALL SELECT c_custkey, 'contact.vpas.0', vpa FROM p UNION ALL SELECT c_custkey, 'contact.vpas.1', 'none' FROM p UNION ALL SELECT c_custkey, 'notes.0.note', note FROM p""")
def document_leaves(spark, sf_dir):
    return nested.leaves(_profiles(spark, sf_dir), "doc", 6).select("c_custkey", "path", F.try_variant_get("leaf", "$", "string").alias("value"))


@register(f"""WITH {_PROFILE} SELECT c_custkey, 'phone' AS kind, phone AS value FROM p UNION ALL SELECT c_custkey, 'phone', '7' || right(phone, 9) FROM p WHERE note IS NOT NULL UNION ALL SELECT c_custkey, 'address', lower(vpa) FROM p""")
def values_seen(spark, sf_dir):
    return nested.values_seen(nested.leaves(_profiles(spark, sf_dir), "doc", 6), ["c_custkey"])


#: Names and addresses of nations' people from three sources, most trusted first; one name in four of the first is masked.
@register("""WITH r AS (
    SELECT c_nationkey AS who, 'name' AS attribute, CASE WHEN c_custkey % 4 = 0 THEN '***' || c_custkey WHEN c_custkey % 4 = 1 THEN c_name ELSE '' END AS value, 'account' AS source, 0 AS place, c_custkey AS seq FROM customer WHERE c_nationkey % 5 <> 0
    UNION ALL SELECT s_nationkey, 'name', s_name, 'users', 1, s_suppkey FROM supplier UNION ALL SELECT c_nationkey, 'upi', CASE WHEN c_custkey % 6 = 0 THEN 'v' || c_custkey || '@x' END, 'prefs', 2, c_custkey FROM customer
    UNION ALL SELECT n_nationkey, 'name', n_name, 'prefs', 2, n_nationkey FROM nation)
  SELECT who, attribute, value, source FROM r WHERE trim(value) <> '' QUALIFY row_number() OVER (PARTITION BY who, attribute ORDER BY contains(value, '*'), place, seq, value) = 1""")
def subject_identity(spark, sf_dir):
    c, s, n = (table(spark, sf_dir, t) for t in ("customer", "supplier", "nation"))
    k = F.col("c_custkey")
    name = F.when(k % 4 == 0, F.concat(F.lit("***"), k.cast("string"))).when(k % 4 == 1, F.col("c_name")).otherwise("")
    long = lambda df, who, attribute, value, seq: df.select(F.col(who).alias("who"), F.lit(attribute).alias("attribute"), value.alias("value"), F.col(seq).cast("long").alias("seq"))
    upi = long(c, "c_nationkey", "upi", F.when(k % 6 == 0, F.concat(F.lit("v"), k.cast("string"), F.lit("@x"))), "c_custkey")
    sources = {
        "account": long(c.filter("c_nationkey % 5 <> 0"), "c_nationkey", "name", name, "c_custkey"), "users": long(s, "s_nationkey", "name", F.col("s_name"), "s_suppkey"),
        "prefs": upi.unionByName(long(n, "n_nationkey", "name", F.col("n_name"), "n_nationkey")),
    }
    return nested.first_by_source(sources, ["who"])


def _envelopes(spark, sf_dir):
    """Events as stored envelopes: instructions, notices in several placements, links in two forms, broken and absent payloads."""
    e = F.col("event_id").cast("string")
    put = lambda text: F.replace(F.lit(text), F.lit("#"), e)
    kind = F.col("event_id") % 6
    payload = (
        F.when(kind == 0, put('{"system":"catalog","operation":"sync","key":"k#","data":{"placements":[{"template":{"templateParams":{"value":{"title":"hidden"}}}}]}}'))
        .when(kind == 1, put('{"sentAt":#,"data":{"placements":[7,{"template":{"templateId":"t1","templateParams":{"value":{"subTitle":"sub #","title":""}}}},{"template":{"templateId":"t2","templateParams":{"value":{"title":"Title #","body":"old","message":"new #"}},"nav":{"params":{"deepLinkIOS":"app://#"}}}},{"template":{"templateParams":{"value":{"title":"late","subTitle":"late"}}}}]}}'))
        .when(kind == 2, put('{"type":"INBOX","data":{"placements":[{"template":{"templateParams":{"value":{"body":"only body #"}},"nav":{"params":{"redirection_data":{"data":[{"key":"x","value":"no"},{"key":"url","value":"http://#"}]}}}}}]}}'))
        .when(kind == 3, put('{"data":{}}')).when(kind == 4, "{broken")
    )
    coded = F.rtrim(F.regexp_replace(F.base64(payload.cast("binary")), r"\s", ""), F.lit("="))
    ms = epoch_ms(F.col("ts")).cast("string")
    message = F.concat(F.lit('{"message":{"topicId":"'), F.col("event_type"), F.lit('","created":'), ms, F.when(F.col("event_id") % 4 != 0, F.concat(F.lit(',"id":"m'), e, F.lit('"'))).otherwise(""), F.coalesce(F.concat(F.lit(',"payload":"'), coded, F.lit('"')), F.lit("")), F.lit("}}"))
    return table(spark, sf_dir, "events").select("event_id", message.alias("data"))


_D = """d AS (SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN 'm' || event_id ELSE CAST(event_id AS VARCHAR) END AS message_id, event_type AS topic_id, epoch_us(ts) // 1000 AS created_ms, event_id % 6 AS x FROM events),
  m AS (SELECT message_id, topic_id, CASE x WHEN 0 THEN 'catalog/sync' WHEN 1 THEN 'NOTIFICATION' WHEN 2 THEN 'INBOX' ELSE 'unclassified' END AS kind, CASE x WHEN 0 THEN 'k' || event_id END AS sync_key, CASE x WHEN 1 THEN 'Title ' || event_id END AS title,
    CASE x WHEN 1 THEN 'sub ' || event_id END AS subtitle, CASE x WHEN 1 THEN 'new ' || event_id WHEN 2 THEN 'only body ' || event_id END AS body, CASE x WHEN 1 THEN 'app://' || event_id WHEN 2 THEN 'http://' || event_id END AS deeplink,
    CASE x WHEN 1 THEN 't1' END AS template, created_ms, CASE x WHEN 1 THEN event_id END AS sent_ms, x IN (1, 2) AS is_notification, x = 4 AS payload_undecodable FROM d)"""


@register(f"WITH {_D} SELECT * FROM m")
def delivered_messages(spark, sf_dir):
    return nested.delivered_messages(_envelopes(spark, sf_dir), "event_id", "data").drop("server_id")


@register(f"WITH {_D} SELECT kind, count(*) AS n, count(*) FILTER (is_notification) AS n_seen, count(*) FILTER (payload_undecodable) AS n_undecodable, min(created_ms) AS first_ms, max(created_ms) AS last_ms FROM m GROUP BY kind")
def message_kinds(spark, sf_dir):
    return nested.message_summary(nested.delivered_messages(_envelopes(spark, sf_dir), "event_id", "data"))


#: Orders as shared expenses of the suppliers in their lines; lines flagged A say who paid, and settled orders name a payment.
_S = """mem AS (SELECT l_orderkey AS expense, l_suppkey AS member, l_partkey AS seq, l_returnflag = 'A' AS is_payer, CAST(round(l_extendedprice * 100) AS BIGINT) % 100000 AS paise FROM lineitem),
  payer AS (SELECT expense, member AS payer, paise AS paid FROM mem WHERE is_payer QUALIFY row_number() OVER (PARTITION BY expense ORDER BY seq, member, paise) = 1),
  sums AS (SELECT expense, sum(paise) AS shares, count(*) AS n_members FROM mem GROUP BY expense),
  x AS (SELECT o_orderkey AS expense, coalesce(n_members, 0) AS n_members, payer, CAST(CASE WHEN payer IS NOT NULL THEN paid ELSE coalesce(shares, 0) END AS BIGINT) AS total, CASE WHEN o_orderstatus = 'F' THEN 'p' || o_orderkey END AS settlement
    FROM orders LEFT JOIN sums ON sums.expense = o_orderkey LEFT JOIN payer ON payer.expense = o_orderkey),
  owed AS (SELECT member AS debtor, payer AS creditor, paise FROM mem JOIN payer USING (expense) WHERE NOT is_payer AND paise <> 0 AND member <> payer),
  nets AS (SELECT member, other, CAST(sum(v) AS BIGINT) AS net FROM (SELECT creditor AS member, debtor AS other, paise AS v FROM owed UNION ALL SELECT debtor, creditor, -paise FROM owed) GROUP BY 1, 2),
  bal AS (SELECT member, CAST(sum(greatest(-net, 0)) AS BIGINT) AS to_give, CAST(sum(greatest(net, 0)) AS BIGINT) AS to_receive, CAST(sum(net) AS BIGINT) AS net FROM nets GROUP BY member)"""


def _shares(spark, sf_dir):
    paise = F.round(F.col("l_extendedprice") * 100).cast("long") % 100_000
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("expense"), F.col("l_suppkey").alias("member"), F.col("l_partkey").alias("seq"), (F.col("l_returnflag") == "A").alias("is_payer"), paise.alias("paise"))


def _expenses(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("expense"), "o_orderstatus")
    settled = orders.filter("o_orderstatus = 'F'").select("expense", F.concat(F.lit("p"), F.col("expense").cast("string")).alias("payment"))
    return shared.expenses(orders.select("expense"), _shares(spark, sf_dir), settled)


@register(f"WITH {_S} SELECT * FROM x")
def shared_expenses(spark, sf_dir):
    return _expenses(spark, sf_dir)


@register(f"WITH {_S} SELECT * FROM nets")
def shared_nets(spark, sf_dir):
    return shared.pairwise_nets(shared.debts(_shares(spark, sf_dir)))


@register(f"WITH {_S} SELECT * FROM bal")
def shared_balances(spark, sf_dir):
    return shared.balances(shared.debts(_shares(spark, sf_dir)))


@register(f"WITH {_S} SELECT count(*) AS n_expenses, CAST(sum(total) AS BIGINT) AS total, count(settlement) AS n_settled, (SELECT count(*) FROM bal WHERE net <> 0) AS n_with_balance FROM x")
def shared_summary(spark, sf_dir):
    return shared.ledger_summary(_expenses(spark, sf_dir), shared.debts(_shares(spark, sf_dir)))


@register("""SELECT l_orderkey AS expense, l_partkey AS seq, coalesce(CASE WHEN l_suppkey % 4 <> 0 THEN s_name END, CASE WHEN l_suppkey % 8 <> 0 THEN 'own ' || l_suppkey END, 'k' || l_suppkey) AS name FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey""")
def shared_names(spark, sf_dir):
    k = F.col("l_suppkey")
    members = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("expense"), F.col("l_partkey").alias("seq"), k.alias("member"), F.concat(F.lit("k"), k.cast("string")).alias("connection"), F.when(k % 8 != 0, F.concat(F.lit("own "), k.cast("string"))).alias("own_name"))
    names = table(spark, sf_dir, "supplier").filter("s_suppkey % 4 <> 0").select(F.concat(F.lit("k"), F.col("s_suppkey").cast("string")).alias("connection"), F.col("s_name").alias("name"))
    return shared.named_members(members, names).select("expense", "seq", "name")
