"""Many tables at once: reading them, an inventory, searchable views, a timeline of all, and the dashboard's figures."""

from __future__ import annotations

from collections.abc import Collection, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracelens.functions.money import is_failed, is_success
from tracelens.functions.time import decode_id_ts
from tracelens.functions.values import filled, is_true
from tracelens.operators.payments import flow_totals
from tracelens.operators.reports import flatten_times
from tracelens.operators.views import matching

#: Readers by format, with what makes them keep whole values. Fixed values.
READERS = {"parquet": {}, "orc": {}, "json": {"multiLine": "false"}, "csv": {"header": "true", "escape": '"', "multiLine": "true"}, "text": {}}


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """A table of one of the readable formats; ValueError for another. CSV and JSON may be given their schema, so that they are read once."""
    if fmt not in READERS:
        raise ValueError(f"no reader for {fmt}: one of {', '.join(READERS)}")
    reader = spark.read.format(fmt).options(**READERS[fmt])
    return (reader.schema(schema) if schema else reader).load(path)


def table_inventory(catalog: Mapping[str, DataFrame], covered: Collection[str]) -> DataFrame:
    """(table, n_rows, n_columns, columns, covered): every table, and whether some normaliser reads it.

    Counts need no column of a columnar table, so that only file footers are read.
    """
    parts = []
    for name, df in catalog.items():
        counted = df.agg(F.count(F.lit(1)).alias("n_rows"))
        parts.append(counted.select(F.lit(name).alias("table"), "n_rows", F.lit(len(df.columns)).alias("n_columns"), F.lit(",".join(df.columns)).alias("columns"), F.lit(name in covered).alias("covered")))
    return reduce(DataFrame.unionByName, parts)


def build_indexes(catalog: Mapping[str, DataFrame], prefix: str = "idx_") -> list[str]:
    """Temporary views of all tables with time structs flattened; their names. A view is a plan, nothing is copied."""
    names = []
    for name, df in catalog.items():
        flatten_times(df).createOrReplaceTempView(f"{prefix}{name}")
        names.append(f"{prefix}{name}")
    return names


def search_everywhere(catalog: Mapping[str, DataFrame], text: str, per_table: int) -> DataFrame:
    """(table, n, sample): for each table how many rows hold the text in any column, and the first of them as JSON, ``per_table`` at most."""
    parts = []
    for name, df in catalog.items():
        hit = matching(df, text)
        rows = df.filter(hit).select(F.to_json(F.struct("*")).alias("j")).orderBy("j").limit(per_table)
        sample = rows.agg(F.array_sort(F.collect_list("j"))).scalar()
        parts.append(df.agg(F.count_if(hit).alias("n")).select(F.lit(name).alias("table"), "n", sample.alias("sample")))
    return reduce(DataFrame.unionByName, parts)


@dataclass(frozen=True)
class Dated:
    """A source of the timeline: its table, and columns for reference, time, title, and an id that may hold the time when the row does not."""

    rows: DataFrame
    ref: Column
    ms: Column
    title: Column
    embedded: Column | None = None
    newest: int | None = None


def unified_timeline(sources: Mapping[str, Dated]) -> DataFrame:
    """(source, ref, ms, title, dated_by) of every row of the sources that has a time, its own or the one in its id.

    The table is not sorted: take a page of it, or sort where it is written.  ``newest`` keeps that many rows of a source whose queue may be endless.
    """
    parts = []
    for name, s in sources.items():
        own = s.ms.cast("long")
        inside = decode_id_ts(s.embedded) if s.embedded is not None else F.lit(None).cast("long")
        part = s.rows.select(F.lit(name).alias("source"), s.ref.cast("string").alias("ref"), F.coalesce(own, inside).alias("ms"), s.title.alias("title"), F.when(own.isNotNull(), "row").when(inside.isNotNull(), "id").alias("dated_by")).filter("ms is not null")
        parts.append(part if s.newest is None else part.orderBy(F.col("ms").desc(), "ref").limit(s.newest))
    return reduce(DataFrame.unionByName, parts)


def timeline_counts(timeline: DataFrame) -> DataFrame:
    """Rows, first and last time of each source, and how many are dated by their id alone."""
    return timeline.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"), F.count_if(F.col("dated_by") == "id").alias("n_by_id"))


def payment_headline(payments: DataFrame) -> DataFrame:
    """One row of counts and sums of payments in all states: by source, refunds, scans of a code, hand-offs by another app, failures of the ledger and of chats alone."""
    n, c = F.count_if, F.col
    failed = is_failed(c("state"))
    amount = lambda way: F.coalesce(F.sum(F.when(c("direction") == way, c("paise"))), F.lit(0))
    return payments.agg(
        F.count(F.lit(1)).alias("n"), n(c("data_source") == "ledger").alias("n_ledger"), n(c("data_source") == "both").alias("n_both"), n(c("data_source") == "card").alias("n_card"), amount("RECEIVED").alias("paise_received"), amount("SENT").alias("paise_sent"),
        n(failed).alias("n_failed"), n(failed & (c("data_source") != "card")).alias("n_failed_ledger"), n(failed & (c("data_source") == "card")).alias("n_failed_chat_only"), n(is_true(c("is_refund"))).alias("n_refunds"), n(is_true(c("is_qr_scan"))).alias("n_qr"), n(is_true(c("is_intent"))).alias("n_intent"),
    )


def app_usage(payments: DataFrame) -> DataFrame:
    """(kind, value, n): the apps of both legs without those that have no address, and the ways in which payments began, in one pass."""
    entry = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))
    began = filled(F.col("payment_initiation"))
    pairs = F.array(entry("app", F.col("sender_app_label")), entry("app", F.col("receiver_app_label")), entry("initiation", began), entry("way", F.when(F.col("is_qr_scan"), "QR")), entry("way", F.when(F.col("is_intent"), "INTENT")))
    return payments.select(F.explode(pairs).alias("p")).filter("p.value is not null and p.value <> 'No VPA'").groupBy("p.kind", "p.value").agg(F.count(F.lit(1)).alias("n"))


def failures(payments: DataFrame) -> DataFrame:
    """Failed payments with their reason, and whether only a chat card knows them."""
    return payments.filter(is_failed(F.col("state"))).select("id", "paise", "ms", "counterparty_name", "failure_reason", (F.col("data_source") == "card").alias("chat_only"))


def dossier(payments: DataFrame, cluster: str) -> DataFrame:
    """One row for each cluster: counts by source, completed sums and net, first and last date."""
    good = is_success(F.col("state"))
    amount = lambda way: F.coalesce(F.sum(F.when(good & (F.col("direction") == way), F.col("paise"))), F.lit(0))
    rows = payments.filter(F.col(cluster).isNotNull()).groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("data_source") == s).alias(f"n_{s}") for s in ("ledger", "both", "card")], amount("RECEIVED").alias("paise_received"), amount("SENT").alias("paise_sent"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"),
    )
    return rows.withColumn("net", F.col("paise_received") - F.col("paise_sent"))


def dashboard(payments: DataFrame, contacts: DataFrame, messages: DataFrame, timeline: DataFrame, findings: DataFrame) -> DataFrame:
    """One row with the figures of all parts; each part is one aggregate, and they meet as scalars."""
    n = lambda df: df.agg(F.count(F.lit(1))).scalar()
    row = payments.agg(F.count(F.lit(1)).alias("n_payments"), *flow_totals())
    serious = findings.agg(F.count_if(F.col("severity") == "high")).scalar()
    return row.withColumns({"n_contacts": n(contacts), "n_messages": n(messages), "n_dated": n(timeline), "n_findings": n(findings), "n_serious": serious, "net": F.col("paise_in") - F.col("paise_out")})
