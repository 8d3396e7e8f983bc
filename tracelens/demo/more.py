"""Queries of identities and reports over the given tables, registered beside the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelens.demo.adapter import ledger_rows, messages, payments, table
from tracelens.demo.queries import _FLOW, _L, _T, register
from tracelens.operators import identities as ident, reports
from tracelens.operators.payments import flow_totals


def _connections(spark, sf_dir):
    """Names of connections, one in five masked, and phones that two of three connections own alone."""
    c = table(spark, sf_dir, "customer")
    number = F.col("c_custkey").cast("long")
    name = F.when(number % 5 == 0, F.concat(F.lit("XX"), F.lpad((number % 10_000).cast("string"), 4, "0"))).otherwise(F.upper("c_name"))
    group = F.when(number % 3 == 0, number - 1).otherwise(number)
    return c.select((number - number % 2).alias("connection"), name.alias("name"), F.concat(F.lit("9"), F.lpad(group.cast("string"), 9, "0")).alias("phone"), number.alias("seq"))


def _directory(spark, sf_dir):
    own = _connections(spark, sf_dir).select("connection", "name")
    book = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 2).cast("long").alias("connection"), F.col("s_name").alias("name"))
    return ident.identity_directory({"contacts": own, "phonebook": book})


_I = """c AS (SELECT CAST(c_custkey - c_custkey % 2 AS BIGINT) AS connection, CASE WHEN c_custkey % 5 = 0 THEN 'XX' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') ELSE upper(c_name) END AS name,
    '9' || lpad(CAST(CASE WHEN c_custkey % 3 = 0 THEN c_custkey - 1 ELSE c_custkey END AS VARCHAR), 9, '0') AS phone, CAST(c_custkey AS BIGINT) AS seq FROM customer),
  d AS (SELECT connection, name, origin, priority FROM (SELECT connection, name, 'contacts' AS origin, 0 AS priority FROM c WHERE name NOT LIKE 'XX%' UNION ALL SELECT s_suppkey * 2, s_name, 'phonebook', 1 FROM supplier)
    QUALIFY row_number() OVER (PARTITION BY connection, lower(name) ORDER BY priority, name) = 1),
  names AS (SELECT connection, name FROM d QUALIFY row_number() OVER (PARTITION BY connection ORDER BY priority, name) = 1),
  idx AS (SELECT phone, min(connection) AS connection FROM c WHERE connection IN (SELECT connection FROM names) GROUP BY phone HAVING count(DISTINCT connection) = 1)"""


@register(f"WITH {_I} SELECT connection, name, origin, priority FROM d")
def identity_directory(spark, sf_dir):
    return _directory(spark, sf_dir)


@register(f"WITH {_I} SELECT phone, connection FROM idx")
def reverse_index(spark, sf_dir):
    return ident.reverse_index(_connections(spark, sf_dir), "phone", ident.first_names(_directory(spark, sf_dir)))


@register(f"""WITH {_I}, r AS (SELECT phone, n.name AS found FROM idx JOIN names n USING (connection))
  SELECT seq, CASE WHEN name LIKE 'XX%' THEN coalesce(found, name) ELSE name END AS name, CASE WHEN name LIKE 'XX%' AND found IS NOT NULL THEN 'phone' END AS matched_by FROM c LEFT JOIN r USING (phone)""")
def masked_recovery(spark, sf_dir):
    people, names = _connections(spark, sf_dir), ident.first_names(_directory(spark, sf_dir))
    recovered = ident.recover_masked(people, "name", {"phone": ident.reverse_index(people, "phone", names)}, names)
    return recovered.select("seq", "name", "matched_by")


@register("""WITH m AS (SELECT '9' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS phone, c_custkey AS cluster FROM customer), f AS (SELECT right(phone, 4) AS tail, min(cluster) AS cluster FROM m GROUP BY 1)
  SELECT o_orderkey AS id, cluster FROM orders LEFT JOIN f ON tail = lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0')""")
def weak_link(spark, sf_dir):
    members = table(spark, sf_dir, "customer").select(F.concat(F.lit("9"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("phone"), F.col("c_custkey").alias("cluster"))
    mask = F.concat(F.lit("XXXXXX"), F.lpad((F.col("o_custkey") % 10_000).cast("string"), 4, "0"))
    lone = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), mask.alias("phone"))
    return ident.weak_links(lone, members.withColumn("seq", F.col("cluster")), "seq").select("id", "cluster")


@register("""WITH r AS (SELECT c_nationkey AS cluster, c_custkey % 3 AS trust, c_name || repeat('x', CAST(c_custkey % 4 AS INTEGER)) AS name FROM customer)
  SELECT cluster, count(*) AS n, count(DISTINCT name) AS n_names, first(name ORDER BY trust, -length(name), name) AS display_name FROM r GROUP BY cluster""")
def cluster_attributes(spark, sf_dir):
    name = F.concat(F.col("c_name"), F.expr("repeat('x', CAST(c_custkey % 4 AS INT))"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("cluster"), (F.col("c_custkey") % 3).alias("trust"), name.alias("name"))
    return ident.cluster_attributes(rows, "cluster", F.col("trust"))


@register()
def resolve_counterparties(spark, sf_dir):
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    df = payments(spark, sf_dir).withColumn("day", F.col("ms") / 86_400_000)
    return ident.resolve_counterparties(df, "id", F.array_compact(F.array(F.when(F.col("party") % 3 != 0, tag("uid:", "party")), F.when(F.col("paise") % 7 == 0, tag("ph:", "paise")))))


@register(f"WITH {_T} SELECT 'pmt:' || l_orderkey AS ref, l_linenumber AS line, party AS cluster FROM lineitem LEFT JOIN t ON id = l_orderkey")
def stale_redirect(spark, sf_dir):
    refs = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("pmt:"), F.col("l_orderkey").cast("string")).alias("ref"), F.col("l_linenumber").alias("line"))
    return ident.current_clusters(refs, "ref", payments(spark, sf_dir).select(F.col("id").alias("payment"), F.col("party").alias("cluster")))


@register("""WITH p AS (SELECT s_suppkey AS id, s_nationkey % 3 = 0 AS o, s_suppkey % 2 = 0 AS i, s_name FROM supplier)
  SELECT id, o AND i AS is_self, CASE WHEN o AND i THEN 'SELF' WHEN o THEN 'OUT' WHEN i THEN 'IN' ELSE 'UNKNOWN' END AS direction, CASE WHEN o AND i THEN 'the OWNER' WHEN o OR i THEN s_name END AS other FROM p""")
def self_direction(spark, sf_dir):
    sender = F.when(F.col("s_nationkey") % 3 == 0, "The  owner ").otherwise(F.col("s_name"))
    receiver = F.when(F.col("s_suppkey") % 2 == 0, "the OWNER").otherwise(F.col("s_name"))
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), sender.alias("sender"), receiver.alias("receiver"))
    return ident.tag_self(rows, F.lit("The Owner")).drop("sender", "receiver")


@register(f"WITH {_T} SELECT strftime(epoch_ms(ms), '%Y-%m') AS month, {_FLOW} FROM t GROUP BY 1")
def monthly_volume(spark, sf_dir):
    return reports.monthly(payments(spark, sf_dir))


@register(f"""WITH {_T} SELECT count(*) AS n, CAST(sum(paise) FILTER (direction = 'IN') AS BIGINT) AS paise_in, CAST(sum(paise) FILTER (direction = 'OUT') AS BIGINT) AS paise_out,
  count(*) FILTER (state = 'FAILED') AS n_failed FROM t""")
def headline_stats(spark, sf_dir):
    return reports.headline(payments(spark, sf_dir))


@register(f"WITH {_T} SELECT id, party, paise, ms FROM t WHERE state = 'FAILED'")
def failures_list(spark, sf_dir):
    return reports.failures(payments(spark, sf_dir)).select("id", "party", "paise", "ms")


@register(f"WITH {_T}, x AS (SELECT unnest([type, CASE WHEN id % 3 = 0 THEN 'No VPA' ELSE state END]) AS app FROM t) SELECT app, count(*) AS n FROM x WHERE app <> 'No VPA' GROUP BY app")
def app_usage(spark, sf_dir):
    return reports.usage(payments(spark, sf_dir).withColumn("other", F.when(F.col("id") % 3 == 0, "No VPA").otherwise(F.col("state"))), ["type", "other"])


@register(f"WITH {_T}, y AS (SELECT party, CAST(year(epoch_ms(ms)) AS INTEGER) AS year, {_FLOW} FROM t GROUP BY 1, 2) SELECT *, paise_in - paise_out AS net FROM y")
def party_dossier(spark, sf_dir):
    return reports.dossier(payments(spark, sf_dir), "party")


@register(f"WITH {_T}, {_L} SELECT id, paise, 'payment' AS kind FROM t WHERE type = '5-LOW' UNION ALL SELECT grp, paise, 'merchant request' FROM l WHERE kind = 'R'")
def refunds_union(spark, sf_dir):
    returned = ledger_rows(spark, sf_dir).filter("kind = 'R'").select(F.col("grp").alias("id"), "paise")
    return reports.refunds(payments(spark, sf_dir).filter("type = '5-LOW'").select("id", "paise"), returned)


@register("""SELECT conv_id AS party, any_value(n) AS n, any_value(text) AS preview FROM (SELECT conv_id, text, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS k FROM conversations)
  WHERE k = 1 GROUP BY conv_id""")
def conversation_list(spark, sf_dir):
    return reports.conversation_list(messages(spark, sf_dir), "party", ["turn", "role", "text"], "text")


@register("SELECT role, count(*) AS n, count(DISTINCT conv_id) AS n_conversations, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS chars FROM conversations GROUP BY role")
def chat_summary(spark, sf_dir):
    return reports.chat_summary(messages(spark, sf_dir), "role", "party")


@register("""WITH r AS (SELECT l_orderkey AS position, l_returnflag AS shape, CAST(l_quantity >= 25 AS INTEGER) AS clean_text, CAST(l_linenumber % 3 AS INTEGER) AS fields FROM lineitem),
  k AS (SELECT * FROM r QUALIFY rank() OVER (PARTITION BY position ORDER BY clean_text DESC, fields DESC) = 1)
  SELECT position, max(clean_text) AS clean_text, max(fields) AS fields, array_to_string(list_sort(list_distinct(list(shape))), ',') AS shapes, count(DISTINCT shape) > 1 AS ambiguous FROM k GROUP BY position""")
def best_readings(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("position"), F.col("l_returnflag").alias("shape"), (F.col("l_quantity") >= 25).cast("int").alias("clean_text"), (F.col("l_linenumber") % 3).cast("int").alias("fields"))
    return reports.best_readings(rows, "position")


_COLUMNS = ("l_linenumber", "l_quantity", "l_orderkey")


@register("WITH x AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS v FROM lineitem" for c in _COLUMNS) + """)
  SELECT "column", array_to_string(list_sort(list_distinct(list(CAST(v AS BIGINT)))), ',') AS domain FROM x GROUP BY 1 HAVING count(v) >= 4 AND max(abs(v)) <= 16 AND count(DISTINCT v) <= 8""")
def learned_domains(spark, sf_dir):
    return reports.learn_domains(table(spark, sf_dir, "lineitem"), _COLUMNS).withColumn("domain", F.array_join(F.col("domain").cast("array<string>"), ","))


@register("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey % 4 <> 0 AND b.l_partkey = a.l_partkey AND b.l_suppkey = a.l_suppkey)
  AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey % 4 <> 0 AND b.l_suppkey = a.l_suppkey AND b.l_quantity = a.l_quantity AND b.l_returnflag = a.l_returnflag AND b.l_tax = a.l_tax AND b.l_discount = a.l_discount)""")
def not_live(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_tax", "l_discount")
    c = F.col
    left = reports.not_live(li, li.filter("l_orderkey % 4 <> 0"), [[c("l_partkey"), c("l_suppkey")], [c("l_suppkey"), c("l_quantity"), c("l_returnflag"), c("l_tax"), c("l_discount")]])
    return left.select("l_orderkey", "l_linenumber", "l_partkey")


@register("""SELECT 'customer' AS source, 'c_alias' AS detail, 'schema gap' AS status, count(*) AS n FROM customer UNION ALL SELECT 'events', NULL, 'ok', count(*) FROM events
  UNION ALL SELECT 'wallet', NULL, 'absent', NULL""")
def health_rows(spark, sf_dir):
    tables = {"customer": table(spark, sf_dir, "customer"), "events": table(spark, sf_dir, "events"), "wallet": None}
    return reports.health(tables, {"customer": {"c_custkey": "long", "c_alias": "string"}, "events": {"event_id": "long"}, "wallet": {}})


@register(f"""WITH {_T}, f AS (SELECT party, {_FLOW} FROM t GROUP BY party), s AS (SELECT o_custkey AS party, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS paise_in FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 1 AND o_orderpriority <> '5-LOW' GROUP BY 1)
  SELECT party, f.paise_in AS found_paise_in, s.paise_in AS stated_paise_in FROM f FULL OUTER JOIN s USING (party) WHERE f.paise_in IS DISTINCT FROM s.paise_in""")
def ledger_cross_check(spark, sf_dir):
    df = payments(spark, sf_dir)
    stated = df.filter("state = 'COMPLETED' AND direction = 'IN' AND type <> '5-LOW'").groupBy("party").agg(F.sum("paise").alias("paise_in"))
    return reports.cross_check(df.groupBy("party").agg(*flow_totals()).select("party", "paise_in"), stated, ["party"], ["paise_in"])


@register("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(NULL AS VARCHAR) AS c_alias FROM customer")
def export_rows(spark, sf_dir):
    return reports.export_rows(table(spark, sf_dir, "customer"), ["c_custkey", "c_name", "c_alias"])
