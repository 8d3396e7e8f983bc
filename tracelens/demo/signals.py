"""Queries of findings, ranked counterparties and one-to-one matches over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelens.demo.adapter import payments, table
from tracelens.demo.queries import _T, register
from tracelens.demo.recovery import _GRADED, _graded
from tracelens.demo.relations import _R, _references
from tracelens.functions.money import sms_paise
from tracelens.functions.time import epoch_ms
from tracelens.operators import evidence, findings
from tracelens.operators.match import match_one_to_one, match_summary
from tracelens.sources.files import file_inventory

MINUTE = 60_000


def _banked(spark, sf_dir):
    """Orders as payments, and as bank messages some minutes off; one in seven has none, one in eleven states no amount."""
    o = table(spark, sf_dir, "orders")
    i, ms = F.col("o_orderkey"), epoch_ms(F.col("o_orderdate"))
    paise = F.round(F.col("o_totalprice") * 100).cast("long")
    paid = o.select(paise.alias("key"), ms.alias("ts_ms"), i.alias("pos"))
    amount = F.format_number((paise / 100).cast("decimal(18,2)"), 2)
    body = F.when(i % 11 != 0, F.concat(F.lit("Rs."), amount, F.lit(" debited from a/c"))).otherwise("your statement is ready")
    said = o.filter("o_orderkey % 7 <> 0").select(sms_paise(body).alias("key"), (ms + (i % 90 - 45) * MINUTE).alias("ts_ms"), i.alias("pos")).filter("key is not null")
    return paid, said


_SMS = """m AS (SELECT count(*) FILTER (o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND abs(o_orderkey % 90 - 45) <= 30) AS confirmed, count(*) AS n_left, count(*) FILTER (o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0) AS n_right FROM orders)"""


def _sms_summary(spark, sf_dir):
    paid, said = _banked(spark, sf_dir)
    return match_summary(paid, said, match_one_to_one(paid, said, 30 * MINUTE))


@register(f"WITH {_SMS} SELECT confirmed, n_left - confirmed AS uncorroborated, n_right - confirmed AS only_right, n_right FROM m")
def sms_corroboration(spark, sf_dir):
    return _sms_summary(spark, sf_dir)


@register()
def shipments_matched(spark, sf_dir):
    """Orders and lines of like amount within ten days, nearest first, each once; many sessions have several rows on both sides."""
    o, i = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    left = o.select((F.round("o_totalprice").cast("long") % 500).alias("key"), epoch_ms(F.col("o_orderdate")).alias("ts_ms"), F.col("o_orderkey").alias("pos"))
    line = F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    right = i.select((F.round("l_extendedprice").cast("long") % 500).alias("key"), epoch_ms(F.col("l_shipdate")).alias("ts_ms"), line.alias("pos"))
    return match_one_to_one(left, right, 10 * 24 * 60 * MINUTE)


_ODD = f"""{_T}, o AS (SELECT id, paise, party, CASE WHEN id % 97 = 0 THEN 'on hold' WHEN id % 89 = 0 THEN ' Settling' ELSE state END AS state FROM t), u AS (SELECT *, upper(trim(coalesce(state, ''))) AS s FROM o)"""
_BY = "SELECT '[' || string_agg('{{\"key\":\"' || s || '\",\"n\":' || n || '}}', ',' ORDER BY n DESC, s) || ']' FROM (SELECT s, count(*) AS n FROM u WHERE {0} GROUP BY s)"
_BAD, _UNKNOWN, _LARGE = "s IN ('FAILED', 'PENDING')", "s NOT IN ('', 'COMPLETED', 'FAILED', 'PENDING')", "s = 'COMPLETED' AND paise >= 5000000"


def _odd_states(spark, sf_dir):
    i = F.col("id")
    return payments(spark, sf_dir).withColumn("state", F.when(i % 97 == 0, "on hold").when(i % 89 == 0, " Settling").otherwise(F.col("state")))


_PAYMENT_FINDINGS = f"""SELECT 'medium' AS severity, 'failed_transactions' AS category, count(*) AS n, '{{"by_state":' || ({_BY.format(_BAD)}) || ',"sample_ids":[' || (SELECT string_agg('"' || id || '"', ',' ORDER BY id) FROM (SELECT id FROM u WHERE {_BAD} ORDER BY id LIMIT 5)) || ']}}' AS detail FROM u WHERE {_BAD} HAVING count(*) > 0
  UNION ALL SELECT 'medium', 'unrecognised_transaction_state', count(*), '{{"by_state":' || ({_BY.format(_UNKNOWN)}) || ',"known_success":4,"known_failed":14}}' FROM u WHERE {_UNKNOWN} HAVING count(*) > 0
  UNION ALL SELECT 'info', 'high_value_transactions', count(*), '{{"biggest":' || max(paise) || ',"sample":[' || (SELECT string_agg('{{"id":"' || id || '","paise":' || paise || ',"party":"' || party || '"}}', ',' ORDER BY paise DESC, CAST(id AS VARCHAR)) FROM (SELECT * FROM u WHERE {_LARGE} ORDER BY paise DESC, CAST(id AS VARCHAR) LIMIT 5)) || ']}}' FROM u WHERE {_LARGE} HAVING count(*) > 0"""


@register(f"WITH {_ODD} {_PAYMENT_FINDINGS}")
def payment_findings(spark, sf_dir):
    return findings.payment_findings(_odd_states(spark, sf_dir))


@register(f"WITH {_ODD} SELECT id, s = 'COMPLETED' AS ok, s = 'FAILED' AS failed, s = 'PENDING' AS pending, {_UNKNOWN} AS unknown FROM u")
def state_predicates_odd(spark, sf_dir):
    """The state predicates over rows of which some have a state that nobody knows."""
    from tracelens.functions import money

    s = F.col("state")
    return _odd_states(spark, sf_dir).select("id", money.is_success(s).alias("ok"), money.is_failed(s).alias("failed"), money.is_pending(s).alias("pending"), money.is_unknown(s).alias("unknown"))


_STORES = """SELECT s_name AS store, CASE WHEN s_suppkey % 10 <> 0 THEN s_suppkey % 40 ELSE 0 END AS free_pages, CASE WHEN s_suppkey % 10 <> 0 THEN 100 ELSE 0 END AS total_pages FROM supplier"""


def _stores(spark, sf_dir):
    k = F.col("s_suppkey").cast("long")
    some = k % 10 != 0
    return table(spark, sf_dir, "supplier").select(F.col("s_name").alias("store"), F.when(some, k % 40).otherwise(0).alias("free_pages"), F.when(some, F.lit(100)).otherwise(0).alias("total_pages"))


@register(f"WITH s AS ({_STORES}) SELECT store, free_pages, CASE WHEN free_pages > 20 THEN 'high' WHEN free_pages > 5 THEN 'medium' WHEN total_pages > 0 THEN 'low' END AS intensity FROM s")
def deletion_intensity(spark, sf_dir):
    return findings.deletion_intensity(_stores(spark, sf_dir)).select("store", "free_pages", "intensity")


@register(f"""WITH RECURSIVE {_R}, {_SMS}, st AS ({_STORES}), w AS (SELECT min(ms) AS oldest FROM r WHERE source = 'ledger'),
  v AS (SELECT entity, CASE WHEN earliest_ms IS NULL THEN 'undated' WHEN earliest_ms < (SELECT oldest FROM w) THEN 'before' ELSE 'inside' END AS verdict FROM idx WHERE score = 1 AND expects_ledger_row AND NOT list_contains(string_split(sources, ','), 'ledger')),
  c AS (SELECT count(*) AS k, count(*) FILTER (verdict = 'before') AS b, count(*) FILTER (verdict = 'inside') AS i, count(*) FILTER (verdict = 'undated') AS d FROM v)
  SELECT 'high' AS severity, 'data_deletion' AS category, 1::BIGINT AS n, '{{"store":"' || store || '","free_pages":' || free_pages || ',"total_pages":' || total_pages || '}}' AS detail FROM st WHERE free_pages > 20
  UNION ALL SELECT 'info', 'analytics_loss', count(*), '{{"count":' || count(*) || '}}' FROM events WHERE event_id % 5 >= 3 HAVING count(*) > 0
  UNION ALL SELECT CASE WHEN i + d > 0 THEN 'medium' ELSE 'info' END, 'uncorroborated_transactions', k, '{{"before_window":' || b || ',"inside_window":' || i || ',"undated":' || d || ',"sample_inside_window":[' || coalesce((SELECT string_agg('"' || entity || '"', ',' ORDER BY entity) FROM (SELECT entity FROM v WHERE verdict = 'inside' ORDER BY entity LIMIT 5)), '') || ']}}' FROM c WHERE k > 0
  UNION ALL SELECT 'info', 'wallet_balance', count(*), '{{"paise":' || sum(CAST(round(c_acctbal * 100) AS BIGINT)) || '}}' FROM customer WHERE round(c_acctbal * 100) > 0 HAVING count(*) > 0
  UNION ALL SELECT 'high', 'rooted_device', 1, '{{"model":"' || n_name || '"}}' FROM nation WHERE n_nationkey % 9 = 4
  UNION ALL SELECT 'info', 'encrypted_databases', count(*), '{{"names":[' || (SELECT string_agg('"' || p || '"', ',' ORDER BY p) FROM (SELECT p_partkey || '.db' AS p FROM part WHERE p_partkey % 50 = 0 ORDER BY p LIMIT 5)) || ']}}' FROM part WHERE p_partkey % 50 = 0 HAVING count(*) > 0
  UNION ALL SELECT 'info', 'sms_corroboration', n_right, '{{"confirmed":' || confirmed || ',"uncorroborated":' || n_left - confirmed || ',"only_right":' || n_right - confirmed || '}}' FROM m WHERE n_left > confirmed AND n_right > 0""")
def all_findings(spark, sf_dir):
    sources = _references(spark, sf_dir)
    missing = evidence.missing_payments(evidence.corroborate(sources), sources["ledger"], "ledger")
    wallets = table(spark, sf_dir, "customer").select(F.round(F.col("c_acctbal") * 100).cast("long").alias("paise"))
    devices = table(spark, sf_dir, "nation").select(F.col("n_name").alias("model"), F.when(F.col("n_nationkey") % 9 != 0, F.col("n_nationkey") % 9 == 4).alias("is_rooted"))
    p = F.col("p_partkey")
    locked = table(spark, sf_dir, "part").select(F.concat(p.cast("string"), F.lit(".db")).alias("path"), F.lit(20).alias("length"), F.when(p % 50 == 0, F.lit(b"unreadable")).otherwise(F.lit(b"SQLite format 3\x00")).alias("content"))
    return findings.detect_findings(
        findings.store_findings(_stores(spark, sf_dir)), findings.upload_findings(table(spark, sf_dir, "events").select((F.col("event_id") % 5).alias("failure_count"))), findings.missing_payment_findings(missing),
        findings.wallet_findings(wallets), findings.device_findings(devices), findings.container_findings(file_inventory(locked)), findings.message_findings(_sms_summary(spark, sf_dir)),
    )


@register(f"""{_GRADED}, b AS (SELECT coalesce("table", '(ambiguous)') AS k, count(*) AS n FROM g GROUP BY 1)
  SELECT 'high' AS severity, 'recovered_deleted_records' AS category, count(*) AS n, '{{"by_table":[' || (SELECT string_agg('{{"key":"' || k || '","n":' || n || '}}', ',' ORDER BY n DESC, k) FROM (SELECT * FROM b ORDER BY n DESC, k LIMIT 3)) || '],"high_confidence":' || count(*) FILTER (extent = 'high') || ',"ambiguous":' || count(*) FILTER (ambiguous) || '}}' AS detail FROM g HAVING count(*) > 0""")
def recovery_findings(spark, sf_dir):
    return findings.recovery_findings(_graded(spark, sf_dir), table(spark, sf_dir, "nation"))


@register(f"""WITH {_T}, p AS (SELECT id AS seq, direction, state, paise, CASE WHEN id % 5 = 0 THEN 'u' || party % 300 ELSE '' END AS user_id, CASE WHEN id % 7 = 0 THEN '******' || party WHEN id % 5 = 1 THEN '+91-9' || lpad(CAST(party % 200 AS VARCHAR), 9, '0') END AS phone,
    CASE WHEN id % 5 = 2 THEN 'V' || party % 100 || '@x' END AS vpa, CASE WHEN id % 5 = 4 AND id % 3 = 0 THEN NULL WHEN id % 6 = 0 THEN '****' || party WHEN id % 6 = 1 THEN '+91' || party ELSE 'Name ' || party % 90 END AS name, CASE WHEN id % 40 = 0 THEN 'Real ' || party END AS resolved, id % 60 = 0 AS is_merchant FROM t),
  k AS (SELECT *, CASE WHEN user_id <> '' THEN 'uid' WHEN phone IS NOT NULL AND NOT contains(phone, '*') THEN 'ph' WHEN vpa IS NOT NULL THEN 'vpa' WHEN name IS NOT NULL THEN 'name' END AS grouped_by,
    CASE WHEN user_id <> '' THEN user_id WHEN phone IS NOT NULL AND NOT contains(phone, '*') THEN right(replace(phone, '-', ''), 10) WHEN vpa IS NOT NULL THEN lower(vpa) ELSE lower(name) END AS key, CASE WHEN NOT contains(phone, '*') THEN right(replace(phone, '-', ''), 10) END AS ph,
    coalesce(contains(name, '*') OR regexp_matches(name, '^[+0-9]*$'), true) AS weak FROM p WHERE state = 'COMPLETED'),
  g AS (SELECT direction, grouped_by, key, CAST(sum(paise) AS BIGINT) AS paise, count(*) AS n, CASE WHEN bool_or(is_merchant) THEN 'Merchant' ELSE 'Peer' END AS kind, coalesce(first(resolved ORDER BY seq) FILTER (resolved IS NOT NULL), first(name ORDER BY seq) FILTER (NOT weak), last(name ORDER BY seq) FILTER (name IS NOT NULL), key) AS label,
    count(DISTINCT nullif(user_id, '')) AS n_uid, count(DISTINCT ph) AS n_ph, count(DISTINCT lower(vpa)) AS n_vpa FROM k WHERE key IS NOT NULL GROUP BY direction, grouped_by, key)
  SELECT direction, CAST(row_number() OVER w AS INTEGER) AS place, label, kind, n, paise, grouped_by, key, n_uid, n_ph, n_vpa FROM g WINDOW w AS (PARTITION BY direction ORDER BY paise DESC, n DESC, label, grouped_by, key) QUALIFY row_number() OVER w <= 20""")
def ranked_counterparties(spark, sf_dir):
    i, p, text = F.col("id"), F.col("party"), lambda mark, v: F.concat(F.lit(mark), v.cast("string"))
    phone = F.when(i % 7 == 0, text("******", p)).when(i % 5 == 1, F.concat(F.lit("+91-9"), F.lpad((p % 200).cast("string"), 9, "0")))
    name = F.when((i % 5 == 4) & (i % 3 == 0), None).when(i % 6 == 0, text("****", p)).when(i % 6 == 1, text("+91", p)).otherwise(text("Name ", p % 90))
    rows = payments(spark, sf_dir).select(
        i.alias("seq"), "direction", "state", "paise", F.when(i % 5 == 0, text("u", p % 300)).otherwise("").alias("user_id"), phone.alias("phone"), F.when(i % 5 == 2, F.concat(F.lit("V"), (p % 100).cast("string"), F.lit("@x"))).alias("vpa"),
        name.alias("name"), F.when(i % 40 == 0, text("Real ", p)).alias("resolved"), (i % 60 == 0).alias("is_merchant"),
    )
    return findings.rank_counterparties(rows)
