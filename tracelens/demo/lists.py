"""Queries of filters, pages, enrichment and exports over the given tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tracelens import verbs
from tracelens.demo.adapter import payments, table
from tracelens.demo.queries import _T, register
from tracelens.demo.records import _D, _envelopes, _pages
from tracelens.functions.time import epoch_ms
from tracelens.operators import enrich, exports, nested, reports, views
from tracelens.session import fresh_path, materialise

_LINE = f"""{_T}, l AS (SELECT 'payment' AS source, 'P' || id AS ref, ms, type AS what FROM t UNION ALL SELECT 'event', 'E' || event_id, epoch_us(ts) // 1000, event_type FROM events)"""


def _timeline(spark, sf_dir):
    p, e = payments(spark, sf_dir), table(spark, sf_dir, "events")
    tag = lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string"))
    paid = p.select(F.lit("payment").alias("source"), tag("P", "id").alias("ref"), "ms", F.col("type").alias("what"))
    return paid.unionByName(e.select(F.lit("event").alias("source"), tag("E", "event_id").alias("ref"), epoch_ms(F.col("ts")).alias("ms"), F.col("event_type").alias("what")))


@register(f"""WITH {_LINE}, f AS (SELECT * FROM l WHERE source = 'event' AND (contains(lower(concat_ws(' ', source, ref, ms, what)), 'e7') OR contains(lower(what), 'e7')))
  SELECT *, (SELECT count(*) FROM l) AS total, (SELECT count(*) FROM f) AS matched, (SELECT count(*) FROM f) > 100 AS truncated FROM f ORDER BY ms DESC NULLS LAST, ref LIMIT 100""")
def timeline_view(spark, sf_dir):
    line = _timeline(spark, sf_dir)
    return views.counted_view(line, views.matching(line, " E7 ", {"source": "EVENT"}), [F.col("ms").desc_nulls_last(), F.col("ref")], 100)


@register(f"WITH {_D} SELECT message_id, title, body, (SELECT count(*) FROM m) AS total, (SELECT count(*) FROM m WHERE is_notification) AS matched, (SELECT count(*) FROM m WHERE is_notification) > 3000 AS truncated FROM m WHERE is_notification ORDER BY created_ms DESC NULLS LAST, message_id LIMIT 3000")
def notifications_view(spark, sf_dir):
    # written: the counts, the test and the page would each decode every payload
    messages = materialise(nested.delivered_messages(_envelopes(spark, sf_dir), "event_id", "data").select("message_id", "title", "body", "created_ms", "is_notification"))
    page = views.counted_view(messages, F.col("is_notification"), [F.col("created_ms").desc_nulls_last(), F.col("message_id")], 3000)
    return page.select("message_id", "title", "body", "total", "matched", "truncated")


@register("""WITH e AS (SELECT event_id, CASE WHEN user_id % 9 <> 0 THEN user_id END AS who FROM events), o AS (SELECT *, row_number() OVER (ORDER BY who DESC NULLS LAST, event_id) AS n FROM e),
  p AS (SELECT n FROM o WHERE event_id = 10) SELECT event_id, who, (SELECT max(n) FROM o) > (SELECT n FROM p) + 200 AS has_more FROM o, p WHERE o.n > p.n AND o.n <= p.n + 200""")
def next_page(spark, sf_dir):
    """The page after event 10 in the order of users, found by its key and not by an offset."""
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("user_id") % 9 != 0, F.col("user_id")).alias("who"))
    last = rows.filter("event_id = 10").first()
    return views.key_page(rows, [("who", True), ("event_id", False)], 200, (last["who"], last["event_id"]) if last else None)


@register("SELECT c_custkey, c_name FROM customer WHERE contains(lower(concat_ws(' ', c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment)), 'building') AND contains(lower(c_name), '#0000') AND contains(CAST(c_custkey AS VARCHAR), '1')")
def filter_table(spark, sf_dir):
    return views.filter_table(table(spark, sf_dir, "customer"), "Building ", {"c_name": "#0000", "c_custkey": "1"}).select("c_custkey", "c_name")


@register(f"""WITH {_T} SELECT id, paise FROM t WHERE direction = 'IN' AND state = 'COMPLETED' AND contains(type, 'LOW') AND paise BETWEEN 5000000 AND 40000000 AND CAST(epoch_ms(ms) + INTERVAL 330 MINUTE AS DATE) BETWEEN DATE '1993-03-01' AND DATE '1997-08-31'
  AND (contains(CAST(party AS VARCHAR), '7') OR contains(lower(type), '7'))""")
def payment_filters(spark, sf_dir):
    df = payments(spark, sf_dir)
    wanted = views.payment_tests(df, equal={"direction": "in", "state": "completed"}, part={"type": "LOW"}, anywhere=(["party", "type"], "7"), first=date(1993, 3, 1), last=date(1997, 8, 31), zone="Asia/Kolkata", least=5_000_000, most=40_000_000)
    return df.filter(wanted).select("id", "paise")


@register(f"WITH {_T} SELECT id, party FROM t WHERE (type = '1-URGENT' OR state = '1-URGENT' OR type = 'x') AND direction = 'OUT' AND contains(CAST(id AS VARCHAR) || '|' || CAST(party AS VARCHAR) || '|' || CAST(paise AS VARCHAR) || '|' || CAST(ms AS VARCHAR), '99')")
def payment_filters_exact(spark, sf_dir):
    df = payments(spark, sf_dir)
    return df.filter(views.payment_tests(df, text="99", same={"direction": "OUT"}, either=(["type", "state"], "1-URGENT"))).select("id", "party")


@register(f"WITH {_T}, k AS (SELECT id, CASE WHEN id % 6 <> 0 THEN paise END AS paise, CASE WHEN id % 4 <> 0 THEN CASE WHEN id % 2 = 0 THEN 'B' ELSE 'a' END || party END AS party FROM t) SELECT id, party FROM k ORDER BY lower(coalesce(party, '')), id LIMIT 4000")
def payments_by_party(spark, sf_dir):
    i = F.col("id")
    party = F.when(i % 4 != 0, F.concat(F.when(i % 2 == 0, "B").otherwise("a"), F.col("party").cast("string")))
    df = payments(spark, sf_dir).withColumns({"paise": F.when(i % 6 != 0, F.col("paise")), "party": party})
    return views.sort_payments(df, "counterparty", "id", 4000).select("id", "party")


@register(f"WITH {_T} SELECT id, CASE WHEN id % 6 <> 0 THEN paise END AS paise FROM t ORDER BY 2 NULLS LAST, id LIMIT 14000")
def payments_by_amount(spark, sf_dir):
    df = payments(spark, sf_dir).withColumn("paise", F.when(F.col("id") % 6 != 0, F.col("paise")))
    return views.sort_payments(df, "amount_asc", "id", 14_000).select("id", "paise")


@register("""SELECT c_custkey, c_name < 'Customer#000000500' AS early, c_custkey > 700 AS high, false AS mixed FROM customer""")
def compare_by_kind(spark, sf_dir):
    """Text with text, numbers with numbers, and a number with text, which is never true."""
    number, name = F.col("c_custkey"), F.col("c_name")
    mixed = verbs.compare(number, "<", "abc") | verbs.compare(number, ">", "abc") | verbs.compare(name, "<", 5) | verbs.compare(name, ">=", 5)
    return table(spark, sf_dir, "customer").select("c_custkey", verbs.compare(name, "<", "Customer#000000500").alias("early"), verbs.compare(number, ">", "700").alias("high"), mixed.alias("mixed"))


@register("SELECT p_partkey FROM part WHERE regexp_matches(p_name, '(?i)e.*e$')")
def named_group_matches(spark, sf_dir):
    """A pattern with named groups, a reference and the end of the text in Python's form; patterns that one dialect lacks match nothing."""
    name = F.col("p_name")
    odd = verbs.matches(name, "(a)?(?(1)b|c)") | verbs.matches(name, "[") | verbs.matches(name, "\\p{L}")
    return verbs.where(table(spark, sf_dir, "part"), verbs.matches(name, "(?P<x>e).*(?P=x)\\Z") | odd).select("p_partkey")


@register("SELECT c_nationkey AS c_custkey, c_name FROM customer")
def rename_over(spark, sf_dir):
    """A name that another column has is taken over by the renamed one; an absent column renames nothing."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_name")
    return verbs.rename(verbs.rename(verbs.rename(rows, "c_nationkey", "c_custkey"), "absent", "c_name"), "c_name", "c_name")


_NINE = "'9' || lpad(CAST({0} AS VARCHAR), 9, '0')"
#: Payments with gaps, and chats, conversations, contacts and a phonebook that fill some of them.
_E = f"""pay AS (SELECT 'p' || o_orderkey AS id, 'g' || o_orderkey AS global_id, CASE WHEN o_orderkey % 4 = 0 THEN 'card' ELSE 'ledger' END AS data_source, CASE o_orderkey % 3 WHEN 0 THEN 'RECEIVED' WHEN 1 THEN 'SENT' ELSE 'UNKNOWN' END AS direction,
    CASE WHEN o_orderkey % 2 = 0 THEN 'own ' || o_custkey ELSE ' ' END AS name, CASE WHEN o_orderkey % 5 = 0 THEN 'k' || o_custkey END AS connection, CASE WHEN o_orderkey % 7 = 0 THEN 'ver ' || o_custkey END AS verified, CASE WHEN o_orderkey % 6 = 1 THEN 'cbs ' || o_custkey END AS cbs,
    CASE o_orderkey % 4 WHEN 1 THEN {_NINE.format('o_custkey')} WHEN 2 THEN '******' || right({_NINE.format('o_custkey')}, 4) END AS phone, CASE WHEN o_orderkey % 8 = 0 THEN 'note' END AS note, CASE WHEN o_orderkey % 50 = 0 THEN 'saved' END AS saved FROM orders),
  ref AS (SELECT event_id AS seq, unnest(['p' || event_id * 2, 'g' || event_id * 3]) AS id, CASE WHEN event_id % 5 <> 0 THEN user_id END AS group_id, CASE event_type WHEN 'click' THEN 'IN' WHEN 'view' THEN 'out' ELSE '' END AS way, CASE WHEN event_id % 2 = 1 THEN 'chat ' || user_id END AS other_name,
    '******' || user_id AS other_phone, CASE WHEN event_id % 3 = 0 THEN '  n ' || event_id END AS note FROM events),
  fc AS (SELECT * FROM ref QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) = 1), fg AS (SELECT id, arg_min(group_id, seq) AS group_id FROM ref WHERE group_id IS NOT NULL GROUP BY id),
  conv AS (SELECT c_custkey AS group_id, 'k' || c_custkey AS connection, CASE WHEN c_custkey % 3 = 0 THEN 'cv ' || c_custkey END AS verified, CASE WHEN c_custkey % 4 = 0 THEN 'cc ' || c_custkey END AS cbs, CASE WHEN c_custkey % 2 = 0 THEN 'disp ' || c_custkey END AS display_name,
    CASE WHEN c_custkey % 5 = 0 THEN {_NINE.format('c_custkey')} END AS phone, CASE WHEN c_custkey % 7 = 0 THEN {_NINE.format('c_custkey + 1')} END AS member_phone, CASE WHEN c_custkey % 11 <> 0 THEN '******' || c_custkey END AS masked_phone FROM customer),
  con AS (SELECT {_NINE.format('c_custkey')} AS phone, c_name AS verified, CASE WHEN c_custkey % 3 = 0 THEN 'pc ' || c_custkey END AS cbs FROM customer WHERE c_custkey % 2 = 0), book AS (SELECT {_NINE.format('c_custkey')} AS phone, 'book ' || c_custkey AS name FROM customer WHERE c_custkey % 9 = 0),
  tails AS (SELECT right(phone, 4) AS tail, cbs FROM pay WHERE data_source = 'ledger' AND phone IS NOT NULL AND cbs IS NOT NULL QUALIFY row_number() OVER (PARTITION BY right(phone, 4) ORDER BY id, cbs) = 1),
  a AS (SELECT pay.*, CASE WHEN x.id IS NOT NULL THEN x.way ELSE y.way END AS way, CASE WHEN x.id IS NOT NULL THEN x.other_name ELSE y.other_name END AS other_name, CASE WHEN x.id IS NOT NULL THEN x.other_phone ELSE y.other_phone END AS other_phone,
      CASE WHEN x.id IS NOT NULL THEN x.note ELSE y.note END AS said, coalesce(xg.group_id, yg.group_id) AS group_id
    FROM pay LEFT JOIN fc x ON x.id = pay.id LEFT JOIN fc y ON y.id = pay.global_id LEFT JOIN fg xg ON xg.id = pay.id LEFT JOIN fg yg ON yg.id = pay.global_id),
  b AS (SELECT a.*, c.connection AS c_connection, c.verified AS c_verified, c.cbs AS c_cbs, c.display_name, c.phone AS c_phone, c.member_phone, c.masked_phone, coalesce(a.phone, c.phone, c.member_phone, c.masked_phone, a.other_phone) AS got FROM a LEFT JOIN conv c USING (group_id)),
  d AS (SELECT b.*, con.verified AS p_verified, con.cbs AS p_cbs, book.name AS b_name FROM b LEFT JOIN con ON con.phone = got LEFT JOIN book ON book.phone = got),
  en AS (SELECT id, global_id, data_source, group_id, coalesce(CASE WHEN direction <> 'UNKNOWN' THEN direction END, CASE upper(way) WHEN 'IN' THEN 'RECEIVED' WHEN 'OUT' THEN 'SENT' END) AS direction, CASE WHEN direction <> 'UNKNOWN' THEN 'own' WHEN way <> '' THEN 'chat' END AS direction_by,
    coalesce(nullif(name, ' '), other_name, display_name) AS name, CASE WHEN name <> ' ' THEN 'own' WHEN other_name IS NOT NULL THEN 'chat' WHEN display_name IS NOT NULL THEN 'conversation' END AS name_by,
    coalesce(connection, c_connection) AS connection, CASE WHEN connection IS NOT NULL THEN 'own' WHEN c_connection IS NOT NULL THEN 'conversation' END AS connection_by,
    coalesce(verified, c_verified, p_verified) AS verified, CASE WHEN verified IS NOT NULL THEN 'own' WHEN c_verified IS NOT NULL THEN 'conversation' WHEN p_verified IS NOT NULL THEN 'contact' END AS verified_by,
    coalesce(d.cbs, c_cbs, p_cbs, CASE WHEN NOT contains(got, '*') THEN tails.cbs END) AS cbs, CASE WHEN d.cbs IS NOT NULL THEN 'own' WHEN c_cbs IS NOT NULL THEN 'conversation' WHEN p_cbs IS NOT NULL THEN 'contact' WHEN NOT contains(got, '*') AND tails.cbs IS NOT NULL THEN 'same tail' END AS cbs_by,
    got AS phone, CASE WHEN phone IS NOT NULL THEN 'own' WHEN c_phone IS NOT NULL THEN 'conversation' WHEN member_phone IS NOT NULL THEN 'member' WHEN masked_phone IS NOT NULL THEN 'masked member' WHEN other_phone IS NOT NULL THEN 'masked chat' END AS phone_by,
    coalesce(note, trim(said)) AS note, CASE WHEN note IS NOT NULL THEN 'own' WHEN said IS NOT NULL THEN 'chat' END AS note_by, coalesce(saved, b_name) AS saved, CASE WHEN saved IS NOT NULL THEN 'own' WHEN b_name IS NOT NULL THEN 'phonebook' END AS saved_by
    FROM d LEFT JOIN tails ON tails.tail = right(got, 4))"""


def _gaps(spark, sf_dir):
    c, text = F.col, lambda mark, v: F.concat(F.lit(mark), v.cast("string"))
    nine = lambda v: F.concat(F.lit("9"), F.lpad(v.cast("string"), 9, "0"))
    o, p = c("o_orderkey"), c("o_custkey")
    paid = table(spark, sf_dir, "orders").select(
        text("p", o).alias("id"), text("g", o).alias("global_id"), F.when(o % 4 == 0, "card").otherwise("ledger").alias("data_source"), F.when(o % 3 == 0, "RECEIVED").when(o % 3 == 1, "SENT").otherwise("UNKNOWN").alias("direction"),
        F.when(o % 2 == 0, text("own ", p)).otherwise(" ").alias("name"), F.when(o % 5 == 0, text("k", p)).alias("connection"), F.when(o % 7 == 0, text("ver ", p)).alias("verified"), F.when(o % 6 == 1, text("cbs ", p)).alias("cbs"),
        F.when(o % 4 == 1, nine(p)).when(o % 4 == 2, F.concat(F.lit("******"), F.right(nine(p), F.lit(4)))).alias("phone"), F.when(o % 8 == 0, "note").alias("note"), F.when(o % 50 == 0, "saved").alias("saved"),
    )
    e, u = c("event_id"), c("user_id")
    way = F.when(c("event_type") == "click", "IN").when(c("event_type") == "view", "out").otherwise("")
    said = table(spark, sf_dir, "events").select(
        e.alias("seq"), F.array(text("p", e * 2), text("g", e * 3)).alias("ids"), F.when(e % 5 != 0, u).alias("group_id"), way.alias("way"), F.when(e % 2 == 1, text("chat ", u)).alias("other_name"),
        text("******", u).alias("other_phone"), F.when(e % 3 == 0, text("  n ", e)).alias("note"),
    )
    people, k = table(spark, sf_dir, "customer"), c("c_custkey")
    talk = people.select(
        k.cast("long").alias("group_id"), text("k", k).alias("connection"), F.when(k % 3 == 0, text("cv ", k)).alias("verified"), F.when(k % 4 == 0, text("cc ", k)).alias("cbs"), F.when(k % 2 == 0, text("disp ", k)).alias("display_name"),
        F.when(k % 5 == 0, nine(k)).alias("phone"), F.when(k % 7 == 0, nine(k + 1)).alias("member_phone"), F.when(k % 11 != 0, text("******", k)).alias("masked_phone"),
    )
    contacts = people.filter("c_custkey % 2 = 0").select(nine(k).alias("phone"), c("c_name").alias("verified"), F.when(k % 3 == 0, text("pc ", k)).alias("cbs"))
    return paid, said, talk, contacts, people.filter("c_custkey % 9 = 0").select(nine(k).alias("phone"), text("book ", k).alias("name"))


@register(f"WITH {_E} SELECT * FROM en")
def enriched_payments(spark, sf_dir):
    return enrich.enrich_payments(*_gaps(spark, sf_dir))


@register(f"WITH {_E} " + " UNION ALL ".join(f"SELECT '{f}' AS field, {f}_by AS tier, count(*) AS n FROM en WHERE {f}_by <> 'own' GROUP BY 2" for f in enrich.FIELDS))
def enrichment_counts(spark, sf_dir):
    return enrich.patch_counts(enrich.enrich_payments(*_gaps(spark, sf_dir)), enrich.FIELDS)


@register(f"""WITH {_E}, g AS (SELECT c_custkey AS group_id, CASE c_custkey % 6 WHEN 0 THEN c_name WHEN 1 THEN '****' || c_custkey ELSE ' ' END AS name FROM customer),
  paid AS (SELECT id, group_id, phone, CASE WHEN regexp_matches(id, '[05]$') THEN 'cl' || substr(id, 2) END AS cluster FROM en WHERE group_id IS NOT NULL),
  pp AS (SELECT group_id, first(phone ORDER BY id) FILTER (phone IS NOT NULL AND NOT contains(phone, '*')) AS p_phone, first(cluster ORDER BY id) FILTER (cluster IS NOT NULL) AS p_cluster FROM paid GROUP BY group_id),
  x AS (SELECT g.*, conv.display_name, conv.masked_phone, coalesce(conv.phone, p_phone) AS full_phone, coalesce(p_cluster, CASE WHEN g.group_id % 4 = 0 THEN 'kc' || g.group_id END) AS c1 FROM g LEFT JOIN conv USING (group_id) LEFT JOIN pp USING (group_id)),
  y AS (SELECT *, coalesce(c1, CASE WHEN full_phone IS NOT NULL AND right(full_phone, 1) IN ('1', '3', '5') THEN 'pc' || full_phone END) AS cluster FROM x),
  z AS (SELECT y.*, CASE WHEN right(cluster, 1) IN ('0', '4') THEN 'cl name ' || cluster WHEN cluster IS NOT NULL THEN '(unknown)' END AS k_name, book.name AS b_name FROM y LEFT JOIN book ON book.phone = full_phone)
  SELECT group_id, name, full_phone, cluster, CASE WHEN group_id % 6 = 0 THEN name WHEN k_name <> '(unknown)' THEN k_name WHEN b_name IS NOT NULL THEN b_name WHEN full_phone IS NOT NULL THEN full_phone WHEN name <> ' ' THEN name WHEN display_name IS NOT NULL THEN display_name ELSE masked_phone END AS label,
    CASE WHEN group_id % 6 = 0 THEN 'group' WHEN k_name <> '(unknown)' THEN 'cluster' WHEN b_name IS NOT NULL THEN 'phonebook' WHEN full_phone IS NOT NULL THEN 'phone' WHEN name <> ' ' THEN 'masked name' WHEN display_name IS NOT NULL THEN 'member' WHEN masked_phone IS NOT NULL THEN 'masked phone' END AS label_by FROM z""")
def labelled_groups(spark, sf_dir):
    paid, said, talk, contacts, book = _gaps(spark, sf_dir)
    k = F.col("c_custkey")
    groups = table(spark, sf_dir, "customer").select(k.cast("long").alias("group_id"), F.when(k % 6 == 0, F.col("c_name")).when(k % 6 == 1, F.concat(F.lit("****"), k.cast("string"))).otherwise(" ").alias("name"))
    rich = enrich.enrich_payments(paid, said, talk, contacts, book)
    cluster = F.when(F.col("id").rlike("[05]$"), F.concat(F.lit("cl"), F.substring("id", 2, 20)))
    g = F.col("group_id").cast("string")
    by_connection = talk.filter("group_id % 4 = 0").select(F.concat(F.lit("cid:k"), g).alias("identifier"), F.concat(F.lit("kc"), g).alias("cluster"))
    phones = rich.select("phone").unionByName(talk.select("phone")).filter("phone is not null and not contains(phone, '*') and right(phone, 1) in ('1', '3', '5')").distinct()
    identifiers = by_connection.unionByName(phones.select(F.concat(F.lit("ph:"), "phone").alias("identifier"), F.concat(F.lit("pc"), "phone").alias("cluster")))
    owned = rich.select("id", "group_id", "phone", cluster.alias("cluster"))
    all_clusters = owned.select("cluster").unionByName(identifiers.select("cluster")).filter("cluster is not null").distinct()
    shown = F.when(F.right("cluster", F.lit(1)).isin("0", "4"), F.concat(F.lit("cl name "), "cluster")).otherwise("(unknown)")
    return enrich.label_groups(groups, talk, owned, all_clusters.withColumn("display_name", shown), identifiers, book)


@register(f"WITH {_T} SELECT CAST(id AS VARCHAR) AS id, CAST(paise AS VARCHAR) AS paise, CASE WHEN id % 3 = 0 THEN '''=cmd' || id ELSE type || ', \"x\"' END AS note FROM t WHERE CAST(epoch_ms(ms) AS DATE) BETWEEN DATE '1994-01-01' AND DATE '1995-12-31'")
def scoped_export(spark, sf_dir):
    """Payments of two years, written with a manifest and read back against it."""
    i = F.col("id")
    df = payments(spark, sf_dir).withColumn("note", F.when(i % 3 == 0, F.concat(F.lit("=cmd"), i.cast("string"))).otherwise(F.concat(F.col("type"), F.lit(', "x"'))))
    path = fresh_path(spark)
    exports.write_export(df.filter(views.payment_tests(df, first=date(1994, 1, 1), last=date(1995, 12, 31))), path, ["id", "paise", "note"], "1994-01-01..1995-12-31")
    return exports.read_export(spark, path)


@register(f"WITH {_T} SELECT id, paise, CASE WHEN id % 4 <> 0 THEN 'row ' || id END AS decoded, CASE WHEN id % 4 <> 0 THEN 'orders' END AS provenance FROM t WHERE state = 'FAILED'")
def raw_export(spark, sf_dir):
    """Failed payments beside their raw records as JSON lines, written with a manifest and read back."""
    df = payments(spark, sf_dir)
    raw = df.filter("id % 4 <> 0").select("id", F.lit("orders").alias("provenance"), F.concat(F.lit("row "), F.col("id").cast("string")).alias("decoded"))
    path = fresh_path(spark)
    exports.write_export(exports.with_raw(df.filter("state = 'FAILED'").select("id", "paise"), raw, "id"), path, ["summary", "raw"], "failed", "json")
    back = exports.read_export(spark, path)
    return back.select("summary.id", "summary.paise", "raw.decoded", "raw.provenance")


@register("""WITH f AS (SELECT url || '#' || page_id AS path, strlen(html) AS size, sha256(html) AS h FROM pages), g AS (SELECT left(sha256(path), 2) AS g, sha256(string_agg(path || ':' || h, chr(10) ORDER BY path)) AS h, count(*) AS n, sum(size) AS b FROM f GROUP BY 1)
  SELECT 'given tables' AS "case", CAST(sum(n) AS BIGINT) AS n_files, CAST(sum(b) AS BIGINT) AS bytes, sha256(string_agg(h, chr(10) ORDER BY g)) AS root, 2::BIGINT AS n_warnings, 'customer: schema gap: c_alias; wallet: absent' AS warnings FROM g""")
def custody_record(spark, sf_dir):
    pages = _pages(spark, sf_dir).withColumn("path", F.concat("path", F.lit("#"), F.col("page_id").cast("string")))
    from tracelens.sources.files import file_inventory

    tables = {"customer": table(spark, sf_dir, "customer"), "events": table(spark, sf_dir, "events"), "wallet": None}
    health = reports.health(tables, {"customer": {"c_custkey": "long", "c_alias": "string"}, "events": {"event_id": "long"}, "wallet": {}})
    return exports.custody_record(file_inventory(pages), health, {"case": "given tables"})
