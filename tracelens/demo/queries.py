"""One query for each operator over the given tables, with the same query as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracelens import verbs
from tracelens.demo.adapter import cards, ledger_rows, messages, payments, table
from tracelens.functions import identity, money, text, time, values
from tracelens.operators import payments as pay
from tracelens.operators.components import connected_components

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_T = """t AS (SELECT o_orderkey AS id, o_custkey AS party, CAST(round(o_totalprice * 100) AS BIGINT) AS paise,
  CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'PENDING' WHEN 'P' THEN 'FAILED' END AS state,
  CASE WHEN o_orderkey % 2 = 0 THEN 'OUT' ELSE 'IN' END AS direction, o_orderpriority AS type, epoch_ms(o_orderdate) AS ms FROM orders)"""
_L = "l AS (SELECT l_orderkey AS grp, l_partkey AS row, l_returnflag AS kind, CAST(round(l_extendedprice * 100) AS BIGINT) AS paise, epoch_ms(l_shipdate) AS ms FROM lineitem)"
_C = "c AS (SELECT event_id AS card, event_id * 3 AS first_id, event_id * 3 + 1 AS second_id, CAST(round(value * 100) AS BIGINT) AS paise FROM events)"
_FLOW = """count(*) FILTER (direction = 'IN') AS n_in, CAST(coalesce(sum(paise) FILTER (direction = 'IN' AND state = 'COMPLETED'), 0) AS BIGINT) AS paise_in,
  count(*) FILTER (direction = 'OUT') AS n_out, CAST(coalesce(sum(paise) FILTER (direction = 'OUT' AND state = 'COMPLETED'), 0) AS BIGINT) AS paise_out"""


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@register(f"WITH {_T} SELECT party, CAST(sum(paise) AS BIGINT) AS paise, count(*) AS n FROM t WHERE direction = 'OUT' AND state = 'COMPLETED' GROUP BY party ORDER BY 2 DESC, 1 LIMIT 10")
def top_counterparties(spark, sf_dir):
    return pay.amount_rank(payments(spark, sf_dir), "OUT", 10)


@register(f"WITH {_T} SELECT id, paise FROM t WHERE NOT (party = 10 OR type = '5-LOW') AND paise >= 20000000 AND NOT coalesce(state = 'FAILED', false)")
def where_twovalued(spark, sf_dir):
    c = F.col
    p = ~(verbs.eq(c("party"), "10.0") | verbs.eq(c("type"), "5-LOW")) & verbs.compare(c("paise"), ">=", "2e7") & verbs.ne(c("state"), "FAILED")
    return verbs.where(payments(spark, sf_dir), p).select("id", "paise")


@register("SELECT c_custkey, c_name FROM customer WHERE lower(c_name) GLOB 'customer#*[1-3]?'")
def glob_like(spark, sf_dir):
    return verbs.where(table(spark, sf_dir, "customer"), verbs.like(F.col("c_name"), "CUSTOMER#*[1-3]?")).select("c_custkey", "c_name")


@register("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(?i)^(red|small).*t$')")
def regex_matches(spark, sf_dir):
    return verbs.where(table(spark, sf_dir, "part"), verbs.matches(F.col("p_name"), "^(RED|small).*t$")).select("p_partkey", "p_name")


@register("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'ing') AND starts_with(lower(p_name), 's') OR ends_with(lower(p_type), 'mic')")
def text_contains(spark, sf_dir):
    name, kind = F.col("p_name"), F.col("p_type")
    return verbs.where(table(spark, sf_dir, "part"), (verbs.contains(name, "ING") & verbs.startswith(name, "S")) | verbs.endswith(kind, "MIC")).select("p_partkey")


@register(f"WITH {_T} SELECT id, state FROM t WHERE state IN ('FAILED') OR state IS NULL")
def in_list(spark, sf_dir):
    return verbs.where(payments(spark, sf_dir), verbs.is_in(F.col("state"), ["FAILED", None])).select("id", "state")


@register("SELECT c_custkey, c_mktsegment FROM customer WHERE contains(lower(c_name), '77') OR contains(lower(c_mktsegment), '77') OR contains(CAST(c_custkey AS VARCHAR), '77')")
def search_rows(spark, sf_dir):
    return verbs.search(table(spark, sf_dir, "customer"), "77", ["c_custkey", "c_name", "c_mktsegment"]).select("c_custkey", "c_mktsegment")


@register("""SELECT 'customer' AS _index, c_name AS name FROM customer WHERE contains(lower(c_name), '#00000001')
  UNION ALL SELECT 'supplier', s_name FROM supplier WHERE contains(lower(s_name), '#00000001') UNION ALL SELECT 'nation', n_name FROM nation WHERE contains(lower(n_name), '#00000001')""")
def search_all(spark, sf_dir):
    names = {t: table(spark, sf_dir, t).select(F.col(f"{t[0]}_name").alias("name")) for t in ("customer", "supplier", "nation")}
    return verbs.search_all(names, "#00000001")


@register(f"WITH {_T} SELECT id, CASE WHEN id % 7 = 0 THEN NULL ELSE paise END AS v FROM t ORDER BY v DESC NULLS LAST, id LIMIT 100")
def sort_head(spark, sf_dir):
    df = payments(spark, sf_dir).select("id", F.when(F.col("id") % 7 != 0, F.col("paise")).alias("v"))
    return verbs.head(verbs.sort(df, "v", "id", desc=True), 100)


@register(f"WITH {_T} SELECT id, paise FROM t ORDER BY id DESC LIMIT 25")
def tail(spark, sf_dir):
    return verbs.tail(payments(spark, sf_dir).select("id", "paise"), 25, "id")


@register(f"WITH {_T} SELECT party, count(*) AS count FROM t GROUP BY party ORDER BY 2 DESC, min(id) LIMIT 20")
def top_values(spark, sf_dir):
    return verbs.top(payments(spark, sf_dir), 20, "party", "id")


@register(f"WITH {_T} SELECT party, count(*) AS count FROM t GROUP BY party ORDER BY 2, min(id) DESC LIMIT 20")
def rare_values(spark, sf_dir):
    return verbs.rare(payments(spark, sf_dir), 20, "party", "id")


@register(f"""WITH {_T} SELECT count(*) AS count, CAST(sum(paise) AS DOUBLE) AS "sum(paise)", CAST(min(paise) AS DOUBLE) AS "min(paise)", CAST(max(paise) AS DOUBLE) AS "max(paise)",
  count(DISTINCT paise) AS "distinct_count(paise)", CAST(NULL AS DOUBLE) AS "sum(type)" FROM t""")
def stats_global(spark, sf_dir):
    parts = [("count", None), ("sum", "paise"), ("min", "paise"), ("max", "paise"), ("distinct_count", "paise"), ("sum", "type")]
    return payments(spark, sf_dir).agg(*[verbs.aggregate(fn, f) for fn, f in parts])


@register(f'WITH {_T} SELECT type, CAST(sum(paise) AS DOUBLE) AS "sum(paise)" FROM t GROUP BY type')
def stats_by(spark, sf_dir):
    return verbs.stats(payments(spark, sf_dir), "sum", "paise", "type")


@register(f"WITH {_T} SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY party ORDER BY id) = 1")
def dedup_first(spark, sf_dir):
    return verbs.dedup(payments(spark, sf_dir), "party", "id")


@register(f"WITH {_T} SELECT id, party AS type, CAST(NULL AS VARCHAR) AS note FROM t")
def table_rename(spark, sf_dir):
    """Listed columns, of which one is absent, and one takes the name of another."""
    return verbs.rename(verbs.table(payments(spark, sf_dir), ["id", "type", "party", "note"]), "party", "type")


@register(f"WITH {_T} SELECT * FROM t WHERE direction = 'IN' AND state = 'COMPLETED' AND paise BETWEEN 10000000 AND 30000000")
def filter_transactions(spark, sf_dir):
    return pay.filter_payments(payments(spark, sf_dir), direction="IN", state="COMPLETED", least=10_000_000, most=30_000_000)


@register(f"WITH {_T} " + " UNION ALL ".join(f"SELECT '{f}' AS field, {f} AS value, count(*) AS n FROM t GROUP BY {f}" for f in ("direction", "state", "type")))
def facets(spark, sf_dir):
    return pay.facets(payments(spark, sf_dir), ["direction", "state", "type"])


@register(f"WITH {_T} SELECT {_FLOW} FROM t WHERE type = '1-URGENT'")
def filtered_totals(spark, sf_dir):
    return pay.filter_payments(payments(spark, sf_dir), kind="1-URGENT").agg(*pay.flow_totals())


_PRIO = "CASE kind WHEN 'A' THEN 100 WHEN 'N' THEN 60 ELSE 30 END"


def _priority():
    return F.when(F.col("kind") == "A", 100).when(F.col("kind") == "N", 60).otherwise(30)


@register(f"""WITH {_L}, r AS (SELECT grp, row, kind, row_number() OVER (PARTITION BY grp ORDER BY {_PRIO} DESC, row) AS k, count(*) OVER (PARTITION BY grp) - 1 AS n_aliases FROM l)
  SELECT grp, row, kind, n_aliases FROM r WHERE k = 1""")
def canonical_rows(spark, sf_dir):
    return pay.canonicalise(ledger_rows(spark, sf_dir).select("grp", "row", "kind"), "grp", "row", _priority())


@register(f"""WITH {_L} SELECT row AS id, first_value(row) OVER (PARTITION BY grp ORDER BY {_PRIO} DESC, row) AS "primary" FROM l""")
def id_map(spark, sf_dir):
    return pay.id_map(ledger_rows(spark, sf_dir).select("grp", "row", "kind"), "grp", "row", _priority())


_K = f"""{_T}, {_C}, k AS (SELECT c.*, coalesce(a.id, b.id) AS match FROM c LEFT JOIN t a ON a.id = first_id LEFT JOIN t b ON b.id = second_id),
  u AS (SELECT t.id, t.paise, CASE WHEN t.id IN (SELECT match FROM k WHERE match IS NOT NULL) THEN 'both' ELSE 'ledger' END AS data_source FROM t
    UNION ALL SELECT first_id, arg_min(paise, card), 'card' FROM k WHERE match IS NULL GROUP BY first_id)"""


def _reconciled(spark, sf_dir):
    ledger = payments(spark, sf_dir)
    known = pay.known_cards(cards(spark, sf_dir), ledger, "card", ["first_id", "second_id"], "id")
    return pay.reconcile(ledger, known, "id", "card", "paise")


@register(f"WITH {_K} SELECT * FROM u")
def reconcile_union(spark, sf_dir):
    return _reconciled(spark, sf_dir)


@register(f"""WITH {_K} SELECT count(*) FILTER (data_source <> 'card') AS ledger, count(*) FILTER (data_source <> 'ledger') AS cards, count(*) FILTER (data_source = 'both') AS overlap,
  count(*) FILTER (data_source = 'card') AS card_only, count(*) FILTER (data_source = 'ledger') AS ledger_only, count(*) AS combined FROM u""")
def coverage(spark, sf_dir):
    return pay.coverage(_reconciled(spark, sf_dir))


@register("""WITH n AS (SELECT s_suppkey * 5 AS k, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_name END AS name FROM supplier), o AS (SELECT c_custkey AS k, c_name AS name FROM customer)
  SELECT k, coalesce(nullif(n.name, ''), o.name) AS name FROM o FULL OUTER JOIN n USING (k)""")
def upsert_merge(spark, sf_dir):
    new = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 5).alias("k"), F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.col("s_name")).alias("name"))
    return pay.upsert(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")), new, "k")


@register(f"""WITH {_T}, {_L} SELECT 'payment' AS source, CAST(id AS VARCHAR) AS ref, ms FROM t WHERE ms IS NOT NULL UNION ALL SELECT 'ledger', CAST(grp AS VARCHAR), ms FROM l WHERE ms IS NOT NULL
  UNION ALL SELECT 'event', CAST(event_id AS VARCHAR), epoch_us(ts) // 1000 FROM events WHERE ts IS NOT NULL""")
def timeline_union(spark, sf_dir):
    p, led, e = payments(spark, sf_dir), ledger_rows(spark, sf_dir), table(spark, sf_dir, "events")
    return pay.timeline({"payment": (p, F.col("id"), F.col("ms")), "ledger": (led, F.col("grp"), F.col("ms")), "event": (e, F.col("event_id"), time.epoch_ms(F.col("ts")))})


@register(f"""WITH {_T} SELECT count(*) AS n, count(*) FILTER (state = 'COMPLETED') AS n_success, count(*) FILTER (state = 'FAILED') AS n_failed, count(*) FILTER (state = 'PENDING') AS n_pending,
  CAST(0 AS BIGINT) AS n_unknown, {_FLOW}, count(DISTINCT party) AS n_parties, min(ms) AS first_ms, max(ms) AS last_ms FROM t""")
def transaction_summary(spark, sf_dir):
    return pay.summary(payments(spark, sf_dir))


@register(f"WITH {_T}, y AS (SELECT CAST(year(epoch_ms(ms)) AS INTEGER) AS year, {_FLOW} FROM t GROUP BY 1) SELECT *, paise_in - paise_out AS net FROM y")
def yearly_volume(spark, sf_dir):
    return pay.yearly(payments(spark, sf_dir))


@register(f"WITH {_T}, g AS (SELECT party, {_FLOW} FROM t GROUP BY party) SELECT c_custkey AS party, c_name AS name, coalesce(n_in, 0) AS n_in, coalesce(paise_in, 0) AS paise_in, coalesce(n_out, 0) AS n_out, coalesce(paise_out, 0) AS paise_out FROM customer LEFT JOIN g ON party = c_custkey")
def contact_activity(spark, sf_dir):
    flows = payments(spark, sf_dir).groupBy("party").agg(*pay.flow_totals())
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("party"), F.col("c_name").alias("name"))
    return people.join(flows, "party", "left").fillna(0)


@register("SELECT l_orderkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1")
def unambiguous_index_whole(spark, sf_dir):
    """Over all rows, of which every l_partkey has several suppliers."""
    return pay.unambiguous(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey")


@register()
def component_clusters(spark, sf_dir):
    """Orders and the suppliers' days of shipping over all rows; orders and suppliers alone are one component."""
    order = F.concat(F.lit("order:"), F.col("l_orderkey").cast("string"))
    shipping = F.concat(F.lit("shipping:"), F.col("l_suppkey").cast("string"), F.lit(":"), F.col("l_shipdate").cast("date").cast("string"))
    return connected_components(table(spark, sf_dir, "lineitem").select(order.alias("src"), shipping.alias("dst")))


@register(f"""WITH {_T}, g AS (SELECT party, {_FLOW}, min(ms) AS first_ms, max(ms) AS last_ms FROM t GROUP BY party), m AS (SELECT conv_id AS party, count(*) AS n_messages FROM conversations GROUP BY 1)
  SELECT party, coalesce(n_in, 0) AS n_in, coalesce(paise_in, 0) AS paise_in, coalesce(n_out, 0) AS n_out, coalesce(paise_out, 0) AS paise_out, first_ms, last_ms, coalesce(n_messages, 0) AS n_messages,
    (coalesce(n_in, 0) + coalesce(n_out, 0)) * 5 + coalesce(n_messages, 0) AS score FROM g FULL OUTER JOIN m USING (party)""")
def social_graph(spark, sf_dir):
    return pay.social_graph(payments(spark, sf_dir), messages(spark, sf_dir))


@register(f"""WITH {_T}, {_L}, {_C}, r AS (SELECT id AS ref, 'payment' AS source FROM t UNION ALL SELECT grp, 'ledger' FROM l UNION ALL SELECT first_id, 'card' FROM c)
  SELECT ref, count(DISTINCT source) AS score, count(*) AS mentions FROM r GROUP BY ref""")
def corroboration_score(spark, sf_dir):
    return pay.corroboration({"payment": (payments(spark, sf_dir), "id"), "ledger": (ledger_rows(spark, sf_dir), "grp"), "card": (cards(spark, sf_dir), "first_id")})


@register(f"""WITH {_T}, {_L} SELECT CASE WHEN l.ms IS NULL THEN 'undated' WHEN l.ms < (SELECT min(ms) FROM t WHERE id % 2 = 0) THEN 'before window' ELSE 'inside window' END AS verdict, count(*) AS n
  FROM l WHERE grp NOT IN (SELECT id FROM t WHERE id % 2 = 0) GROUP BY 1""")
def retention_verdict(spark, sf_dir):
    kept = payments(spark, sf_dir).filter("id % 2 = 0")
    missing = ledger_rows(spark, sf_dir).join(kept.select(F.col("id").alias("grp")), "grp", "left_anti")
    return pay.retention_verdict(missing, kept)


@register(f"""WITH {_T}, h AS (SELECT paise, unnest([CASE WHEN state = 'FAILED' THEN 'failed' END, CASE WHEN state = 'PENDING' THEN 'pending' END, CASE WHEN state = 'COMPLETED' AND paise >= 5000000 THEN 'high value' END]) AS rule FROM t)
  SELECT rule, count(*) AS n, CAST(sum(paise) AS BIGINT) AS paise FROM h WHERE rule IS NOT NULL GROUP BY rule""")
def findings(spark, sf_dir):
    return pay.findings(payments(spark, sf_dir))


@register(f"WITH {_T} SELECT id, CAST(CAST(paise / 100.0 AS DECIMAL(18,2)) AS VARCHAR) AS inr FROM t")
def paise_to_inr(spark, sf_dir):
    return payments(spark, sf_dir).select("id", money.paise_to_inr(F.col("paise")).cast("string").alias("inr"))


@register(f"WITH {_T} SELECT id, state = 'COMPLETED' AS ok, state = 'FAILED' AS failed, state = 'PENDING' AS pending, false AS unknown FROM t")
def state_predicates(spark, sf_dir):
    s = F.col("state")
    return payments(spark, sf_dir).select("id", money.is_success(s).alias("ok"), money.is_failed(s).alias("failed"), money.is_pending(s).alias("pending"), money.is_unknown(s).alias("unknown"))


@register("SELECT c_custkey, right('91' || lpad(CAST(c_custkey AS VARCHAR), 10, '9'), 10) AS phone, c_custkey % 2 = 0 AS masked FROM customer")
def phone_rules(spark, sf_dir):
    number = F.concat(F.lit("+91-"), F.lpad(F.col("c_custkey").cast("string"), 10, "9"))
    shown = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("XX"), F.right(number, F.lit(4)))).otherwise(number)
    return table(spark, sf_dir, "customer").select("c_custkey", identity.norm_phone(number).alias("phone"), identity.is_masked(shown).alias("masked"))


@register("SELECT c_custkey, lower(split_part(c_name, '#', 1)) || '.' || c_nationkey AS handle FROM customer")
def psp_of_address(spark, sf_dir):
    address = F.concat(F.col("c_custkey").cast("string"), F.lit("@"), F.split_part(F.col("c_name"), F.lit("#"), F.lit(1)), F.lit("."), F.col("c_nationkey").cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.lower(identity.psp(address)).alias("handle"))


@register("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS utc, strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S') AS ist FROM events")
def time_text(spark, sf_dir):
    ms = time.epoch_ms(F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", time.utc_text(ms).alias("utc"), time.ist_text(ms).alias("ist"))


@register("SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events")
def json_path(spark, sf_dir):
    from tracelens.functions.payload import decode_json, long_at

    return table(spark, sf_dir, "events").select("event_id", long_at(decode_json(F.col("props")), "k").alias("k"))


@register("SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages")
def web_hosts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.host(F.col("url")).alias("host"))


@register("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '''=' || s_name ELSE CAST(s_acctbal AS VARCHAR) END AS cell FROM supplier")
def guarded_cells(spark, sf_dir):
    cell = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("="), F.col("s_name"))).otherwise(F.col("s_acctbal").cast("string"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.guard_cell(cell).alias("cell"))


@register("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS flag FROM orders")
def tri_state(spark, sf_dir):
    word = F.element_at(F.array(*map(F.lit, ("Yes", "0", "2", "maybe"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", values.tri_bool(word).alias("flag"))


@register("SELECT count(*) AS n FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE source = 'src0' AND text IS NOT NULL) AND text IS NOT NULL")
def live_anti_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text is not null").select("source", F.md5("text").alias("print"))
    return docs.join(docs.filter("source = 'src0'").select("print"), "print", "left_anti").agg(F.count(F.lit(1)).alias("n"))


@register("SELECT md5(text) AS print, min(doc_id) AS doc_id, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1")
def fingerprint_dedupe(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("text is not null").groupBy(F.md5("text").alias("print")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
