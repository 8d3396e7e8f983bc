"""Queries over many tables at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelens.demo.adapter import payments, table
from tracelens.demo.ledger import _B, _payments, _requests
from tracelens.demo.queries import _FLOW, _T, register
from tracelens.demo.signals import _STORES, _stores
from tracelens.functions.time import epoch_ms
from tracelens.operators import catalog, findings
from tracelens.session import fresh_path

_TABLES = {
    "region": "r_regionkey,r_name", "nation": "n_nationkey,n_name,n_regionkey", "supplier": "s_suppkey,s_name,s_nationkey,s_acctbal", "conversations": "conv_id,turn,role,text", "labels": "doc_id,quality,toxic", "benchmark": "item_id,text",
}


@register(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n_rows, {c.count(',') + 1} AS n_columns, '{c}' AS columns, {'true' if t in ('supplier', 'conversations') else 'false'} AS covered FROM {t}" for t, c in _TABLES.items()))
def table_inventory(spark, sf_dir):
    return catalog.table_inventory({t: catalog.read_table(spark, f"{sf_dir}/{t}.parquet").select(*c.split(",")) for t, c in _TABLES.items()}, ["supplier", "conversations"])


@register("SELECT c_custkey, c_name, c_acctbal FROM customer")
def read_formats(spark, sf_dir):
    """Customers written as CSV and as JSON and read back, the even ones from one and the odd ones from the other."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    csv, json = fresh_path(spark), fresh_path(spark)
    rows.filter("c_custkey % 2 = 0").write.option("header", True).csv(csv)
    rows.filter("c_custkey % 2 = 1").write.json(json)
    return catalog.read_table(spark, csv, "csv", schema).unionByName(catalog.read_table(spark, json, "json", schema))


@register("""SELECT 'customer' AS "table", count(*) FILTER (contains(lower(concat_ws(' ', c_custkey, c_name, c_nationkey, c_mktsegment)), 'r#00000001')) AS n FROM customer
  UNION ALL SELECT 'part', count(*) FILTER (contains(lower(concat_ws(' ', p_partkey, p_name)), 'r#00000001')) FROM part UNION ALL SELECT 'supplier', count(*) FILTER (contains(lower(concat_ws(' ', s_suppkey, s_name)), 'r#00000001')) FROM supplier""")
def search_everywhere(spark, sf_dir):
    tables = {"customer": ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"], "part": ["p_partkey", "p_name"], "supplier": ["s_suppkey", "s_name"]}
    return catalog.search_everywhere({t: table(spark, sf_dir, t).select(*c) for t, c in tables.items()}, "R#00000001", 3).select("table", "n")


#: Payments, requests, lines, events, messages with the time in their ids, and the newest 500 of a queue.
_LINE = f"""{_B}, tl AS (
    SELECT 'payment' AS source, id AS ref, ms, type AS title, 'row' AS dated_by FROM pay WHERE ms IS NOT NULL UNION ALL SELECT 'request', id, ms, type, 'row' FROM req WHERE ms IS NOT NULL
    UNION ALL SELECT 'line', l_orderkey || '-' || l_linenumber || '-' || l_partkey, epoch_ms(l_shipdate), l_returnflag, 'row' FROM lineitem WHERE l_shipdate IS NOT NULL
    UNION ALL SELECT 'event', 'T' || strftime(ts, '%y%m%d%H%M%S') || event_id, CASE WHEN event_id % 3 = 0 THEN epoch_ms(date_trunc('second', ts)) ELSE epoch_us(ts) // 1000 END, event_type, CASE WHEN event_id % 3 = 0 THEN 'id' ELSE 'row' END FROM events
    UNION ALL (SELECT 'queue', CAST(event_id AS VARCHAR), epoch_us(ts) // 1000 AS ms, props, 'row' FROM events ORDER BY ms DESC, CAST(event_id AS VARCHAR) LIMIT 500))"""


def _timeline(spark, sf_dir):
    c = F.col
    events, lines = table(spark, sf_dir, "events"), table(spark, sf_dir, "lineitem")
    ms, eid = epoch_ms(c("ts")), c("event_id")
    ref = F.concat(F.lit("T"), F.date_format("ts", "yyMMddHHmmss"), eid.cast("string"))
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey")
    return catalog.unified_timeline({
        "payment": catalog.Dated(_payments(spark, sf_dir), c("id"), c("ms"), c("type")), "request": catalog.Dated(_requests(spark, sf_dir), c("id"), c("ms"), c("type")),
        "line": catalog.Dated(lines, key, epoch_ms(c("l_shipdate")), c("l_returnflag")), "event": catalog.Dated(events, ref, F.when(eid % 3 != 0, ms), c("event_type"), embedded=ref),
        "queue": catalog.Dated(events, eid, ms, c("props"), newest=500),
    })


@register(f"WITH {_LINE} SELECT * FROM tl")
def unified_timeline(spark, sf_dir):
    return _timeline(spark, sf_dir)


@register(f"WITH {_LINE} SELECT source, count(*) AS n, min(ms) AS first_ms, max(ms) AS last_ms, count(*) FILTER (dated_by = 'id') AS n_by_id FROM tl GROUP BY source")
def timeline_counts(spark, sf_dir):
    return catalog.timeline_counts(_timeline(spark, sf_dir))


def _known(spark, sf_dir):
    """Built payments, of which some come from a card alone or from both sides."""
    n = F.substring("id", 2, 20).cast("long")
    source = F.when(n % 10 == 5, "card").when(n % 10 < 4, "both").otherwise("ledger")
    return _payments(spark, sf_dir).withColumns({"data_source": source, "state": F.when(F.col("state") == "F", "COMPLETED").otherwise(F.col("state"))})


_K = f"{_B}, kn AS (SELECT * REPLACE (CASE WHEN state = 'F' THEN 'COMPLETED' ELSE state END AS state), CASE WHEN o % 10 = 5 THEN 'card' WHEN o % 10 < 4 THEN 'both' ELSE 'ledger' END AS data_source FROM pay)"


@register(f"""WITH {_K} SELECT count(*) AS n, count(*) FILTER (data_source = 'ledger') AS n_ledger, count(*) FILTER (data_source = 'both') AS n_both, count(*) FILTER (data_source = 'card') AS n_card, CAST(coalesce(sum(paise) FILTER (direction = 'RECEIVED'), 0) AS BIGINT) AS paise_received,
  CAST(coalesce(sum(paise) FILTER (direction = 'SENT'), 0) AS BIGINT) AS paise_sent, count(*) FILTER (state = 'FAILED') AS n_failed, count(*) FILTER (state = 'FAILED' AND data_source <> 'card') AS n_failed_ledger, count(*) FILTER (state = 'FAILED' AND data_source = 'card') AS n_failed_chat_only,
  count(*) FILTER (is_refund) AS n_refunds, count(*) FILTER (is_qr_scan) AS n_qr, count(*) FILTER (is_intent) AS n_intent FROM kn""")
def payment_headline(spark, sf_dir):
    return catalog.payment_headline(_known(spark, sf_dir))


@register(f"""WITH {_K}, u AS (SELECT 'app' AS kind, sender_app_label AS value FROM kn UNION ALL SELECT 'app', receiver_app_label FROM kn UNION ALL SELECT 'initiation', nullif(payment_initiation, '') FROM kn UNION ALL SELECT 'way', CASE WHEN is_qr_scan THEN 'QR' END FROM kn
    UNION ALL SELECT 'way', CASE WHEN is_intent THEN 'INTENT' END FROM kn) SELECT kind, value, count(*) AS n FROM u WHERE value IS NOT NULL AND value <> 'No VPA' GROUP BY 1, 2""")
def payment_usage(spark, sf_dir):
    return catalog.app_usage(_known(spark, sf_dir))


@register(f"WITH {_K} SELECT id, paise, ms, counterparty_name, failure_reason, data_source = 'card' AS chat_only FROM kn WHERE state = 'FAILED'")
def failures_with_reason(spark, sf_dir):
    return catalog.failures(_known(spark, sf_dir))


@register(f"""WITH {_K}, per_cluster AS (SELECT counterparty_vpa, count(*) AS n, count(*) FILTER (data_source = 'ledger') AS n_ledger, count(*) FILTER (data_source = 'both') AS n_both, count(*) FILTER (data_source = 'card') AS n_card,
    CAST(coalesce(sum(paise) FILTER (state = 'COMPLETED' AND direction = 'RECEIVED'), 0) AS BIGINT) AS paise_received, CAST(coalesce(sum(paise) FILTER (state = 'COMPLETED' AND direction = 'SENT'), 0) AS BIGINT) AS paise_sent, min(ms) AS first_ms, max(ms) AS last_ms FROM kn GROUP BY counterparty_vpa)
  SELECT *, paise_received - paise_sent AS net FROM per_cluster""")
def cluster_dossier(spark, sf_dir):
    return catalog.dossier(_known(spark, sf_dir), "counterparty_vpa")


@register(f"""WITH {_T}, st AS ({_STORES}) SELECT count(*) AS n_payments, {_FLOW}, (SELECT count(*) FROM customer) AS n_contacts, (SELECT count(*) FROM conversations) AS n_messages, (SELECT count(ts) FROM events) AS n_dated, (SELECT count(*) FROM st WHERE free_pages > 20) AS n_findings,
  (SELECT count(*) FROM st WHERE free_pages > 20) AS n_serious, CAST(coalesce(sum(paise) FILTER (direction = 'IN' AND state = 'COMPLETED'), 0) - coalesce(sum(paise) FILTER (direction = 'OUT' AND state = 'COMPLETED'), 0) AS BIGINT) AS net FROM t""")
def dashboard(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    line = catalog.unified_timeline({"event": catalog.Dated(e, F.col("event_id"), epoch_ms(F.col("ts")), F.col("event_type"))})
    return catalog.dashboard(payments(spark, sf_dir), table(spark, sf_dir, "customer"), table(spark, sf_dir, "conversations"), line, findings.store_findings(_stores(spark, sf_dir)))
