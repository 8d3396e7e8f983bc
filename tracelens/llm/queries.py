"""The registered queries of the subpackage: thin contracts over the operators' general interfaces."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracelens.llm.conversation_repair import damaged, repair_conversations
from tracelens.llm.decontaminate import contamination, hit_words, is_contaminated
from tracelens.llm.embedding_forest import near_embeddings
from tracelens.llm.filter_audit import audit_filters
from tracelens.llm.jaccard_join import jaccard_classes
from tracelens.llm.labelled import held_out
from tracelens.llm.license_scan import STATEMENTS, scan_licenses
from tracelens.llm.license_texts import scan_license_texts
from tracelens.llm.packing import pack_documents
from tracelens.llm.quality_knn import fit_quality, quality_scores
from tracelens.llm.secret_scan import fit_grammars, listed, secret_spans
from tracelens.llm.substring_dedup import deduplicate_substrings
from tracelens.llm.token_counts import count_tokens
from tracelens.llm.toxicity import fit_toxicity, toxicity_scores
from tracelens.llm.url_filter import judge_urls, rule_table
from tracelens.session import tune

#: The vocabulary that op8 and the pipeline cut texts with.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

#: The score from which a document is toxic.
TOXIC_FROM = 0.7
#: The score from which a document is good.
QUALITY_FROM = 0.3

#: Arrow batches small enough for several numpy copies of their text in a worker.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    for key, value in BATCH.items():
        spark.conf.set(key, value)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate_substrings(table(spark, sf_dir, "documents"), with_text=False).drop("kept_text")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hits = hit_words()
    return found.select(
        "doc_id", F.col("_words").alias("n_words"), hits.alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"), is_contaminated(hits, F.col("_words")).alias("contaminated"),
    )


def op5_embedding_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(table(spark, sf_dir, "embeddings"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"), TOKENIZER, with_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def toxic_held_out() -> Column:
    """Rows that the toxicity model never learns from."""
    return held_out(F.col("doc_id"), 3, 1)


def op6_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, held = table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 5, 0)
    scores = quality_scores(documents, fit_quality(documents, table(spark, sf_dir, "labels"), held))
    return scores.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= QUALITY_FROM).cast("int").alias("predicted"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    spans = secret_spans(documents, fit_grammars(documents))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda x: x["kind"] != "format")
    return spans.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scores = toxicity_scores(documents, fit_toxicity(documents, table(spark, sf_dir, "labels"), toxic_held_out()))
    return scores.select("doc_id", toxic_held_out().alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


#: Rules of op9: verdict, host, path. Fixed values.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op2_license_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_license_texts(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = judge_urls(pages, rule_table(pages, URL_RULES))
    return judged.select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"))


#: Tokens of a text that fits a training window.
TOKEN_LIMIT = 1024


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(tune(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("lang"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_tokens(table(tune(spark), sf_dir, "documents"), TOKENIZER)
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(table(tune(spark), sf_dir, "conversations"), damaged)


_LICENSES = " UNION ALL ".join(f"SELECT '{name}' AS license, '{text}' AS statement" for name, text in STATEMENTS)
_WORDS = r"\p{L}+(?:-\p{L}+)*|[0-9]+(?:\.[0-9]+)*"

ORACLE_SQL: dict[str, str] = {
    "op11_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS w FROM documents),
f AS (
  SELECT part, coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1), false) AS good, coalesce(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1), false) AS toxic,
    concat(CASE WHEN len(w) < 100 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' END, CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' END,
      CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END, CASE WHEN min(doc_id) OVER (PARTITION BY t) < doc_id THEN 'E' END) AS fails FROM d),
m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS x, filter_order[1:step - 1] AS earlier FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
g AS (
  SELECT part, filter_order, step, x, sum(n) FILTER (NOT gone AND NOT failing) AS kept, sum(n) FILTER (NOT gone AND failing) AS removed, sum(n) FILTER (gone AND failing) AS redundant,
    sum(n) FILTER (fails = x) AS unique_fails, sum(n_good) FILTER (NOT gone AND failing) AS good_lost, sum(n_toxic) FILTER (NOT gone AND failing) AS toxic_lost
  FROM (SELECT *, translate(fails, earlier, '') <> fails AS gone, contains(fails, x) AS failing FROM m, s) GROUP BY part, filter_order, step, x)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, x), 0) AS BIGINT) AS shapley FROM g""",
    "op2_license_scan": f"""
WITH templates AS (
  SELECT license, len(w) AS length, list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS pairs
  FROM (SELECT license, regexp_extract_all(lower(statement), '{_WORDS}') AS w FROM ({_LICENSES}))),
docs AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{_WORDS}') AS w FROM documents),
windows AS (
  SELECT doc_id, license, pairs, s - 1 AS start, list_distinct([w[i] || ' ' || w[i + 1] for i in range(s, s + length - 1)]) AS own
  FROM docs, templates, unnest(range(1, len(w) - length + 2)) AS t(s)),
found AS (SELECT doc_id, license, start, len(list_intersect(own, pairs)) AS n, len(pairs) AS m FROM windows)
SELECT doc_id, license, min(start) AS first_word, count(DISTINCT start) AS n_windows, max(n) AS n_pairs, max(m) AS of_pairs
FROM found WHERE n >= 0.8 * m GROUP BY doc_id, license""",
    "op9_url_filter": """
WITH urls AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(verdict, rule_host, rule_path) AS (VALUES """ + ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES) + """),
best AS (
  SELECT u.*, (SELECT max(struct_pack(n := length(rule_host || rule_path), rule := rule_host || rule_path, verdict := r.verdict)) FROM rules r
    WHERE (u.host = rule_host OR ends_with(u.host, '.' || rule_host)) AND starts_with(u.path, rule_path)) AS b FROM urls u)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.verdict, 'allow') AS verdict FROM best""",
}

QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_license_scan, op2_license_texts, op3_jaccard_join, op4_decontaminate, op5_embedding_forest,
        op6_quality_knn, op7_secret_scan, op8_packing, op9_url_filter, op10_toxicity, op11_filter_audit, op12_token_counts, op13_conversation_repair,
    )
}
