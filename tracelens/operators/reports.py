"""Report tables: volumes, usage, dossiers, chats, recovered records, health rows and exports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tracelens.functions.money import is_failed
from tracelens.functions.text import cell, guard_cell
from tracelens.functions.time import iso
from tracelens.operators.payments import flow_totals


def monthly(df: DataFrame) -> DataFrame:
    """Received and sent by month (``yyyy-MM``, UTC); undated payments under null."""
    return df.groupBy(F.date_format(F.timestamp_millis(F.col("ms")), "yyyy-MM").alias("month")).agg(*flow_totals())


def headline(df: DataFrame) -> DataFrame:
    """Counts and sums of payments in every state, unlike the summary."""
    way = lambda d: F.coalesce(F.sum(F.when(F.col("direction") == d, F.col("paise"))), F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("n"), way("IN").alias("paise_in"), way("OUT").alias("paise_out"), F.count_if(is_failed(F.col("state"))).alias("n_failed"))


def failures(df: DataFrame) -> DataFrame:
    return df.filter(is_failed(F.col("state")))


def usage(df: DataFrame, legs: Sequence[str], absent: str = "No VPA") -> DataFrame:
    """(app, n) over all legs of the payments; legs without an address do not count."""
    return df.select(F.explode(F.array(*legs)).alias("app")).filter(F.col("app") != absent).groupBy("app").agg(F.count(F.lit(1)).alias("n"))


def dossier(df: DataFrame, cluster: str) -> DataFrame:
    """Received, sent and net of each cluster by year."""
    year = F.year(F.timestamp_millis(F.col("ms"))).alias("year")
    return df.groupBy(cluster, year).agg(*flow_totals()).withColumn("net", F.col("paise_in") - F.col("paise_out"))


def refunds(payments: DataFrame, requests: DataFrame) -> DataFrame:
    """Refund payments and refund requests of merchants, told apart by ``kind``."""
    return payments.withColumn("kind", F.lit("payment")).unionByName(requests.withColumn("kind", F.lit("merchant request")))


def conversation_list(messages: DataFrame, key: str, order: Sequence[str], text: str) -> DataFrame:
    """Each conversation with its number of messages and its latest one as ``preview``."""
    return messages.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max_by(text, F.struct(*order)).alias("preview"))


def chat_summary(messages: DataFrame, kind: str, key: str) -> DataFrame:
    """Messages, conversations and characters by kind of message."""
    return messages.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("n_conversations"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))


def best_readings(rows: DataFrame, position: str) -> DataFrame:
    """The best reading of every byte position by (clean_text, fields), all tied tables listed, and whether they are several.

    The list is bounded by the number of table shapes that are tried at a position.
    """
    score = F.struct("clean_text", "fields")
    best = rows.groupBy(position).agg(F.max(score).alias("_best"))
    kept = rows.join(best, position).filter(score == F.col("_best"))
    tables = F.array_sort(F.collect_set("shape"))
    return kept.groupBy(position).agg(F.max("clean_text").alias("clean_text"), F.max("fields").alias("fields"), F.array_join(tables, ",").alias("shapes"), (F.count_distinct("shape") > 1).alias("ambiguous"))


#: A column is an enumeration when it has at least four live rows, no number beyond 16 and at most eight values.
LEAST_ROWS, MOST_NUMBER, MOST_VALUES = 4, 16, 8


def learn_domains(live: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, domain) of the columns that live rows show to be enumerations, in one pass; sets hold 33 numbers at most."""
    parts = []
    for c in columns:
        v = F.col(c)
        values = F.array_sort(F.collect_set(F.when(F.abs(v) <= MOST_NUMBER, v.cast("long"))))
        parts.append(F.struct(F.lit(c).alias("column"), F.count(v).alias("n"), F.max(F.abs(v)).cast("double").alias("most"), values.alias("domain")))
    found = live.agg(F.array(*parts).alias("c")).select(F.explode("c").alias("c")).select("c.*")
    good = (F.col("n") >= LEAST_ROWS) & (F.col("most") <= MOST_NUMBER) & (F.size("domain") <= MOST_VALUES)
    return found.filter(good).select("column", "domain")


def not_live(recovered: DataFrame, live: DataFrame, keys: Sequence[Sequence[Column]]) -> DataFrame:
    """Recovered rows that no live row equals in any of the keys (whole row, its head, its tail); values are compared, null with null."""
    for columns in keys:
        parts = {f"_k{i}": c for i, c in enumerate(columns)}
        known = live.select(*[c.alias(k) for k, c in parts.items()]).distinct().toDF(*[f"{k}_live" for k in parts])
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_live")) for k in parts])
        recovered = recovered.withColumns(parts).join(known, same, "left_anti").drop(*parts)
    return recovered


def select_tolerant(df: DataFrame, columns: Mapping[str, str]) -> tuple[DataFrame, list[str]]:
    """The columns (name -> type), null where absent, and the names that are absent."""
    gaps = [c for c in columns if c not in df.columns]
    return df.select(*[F.lit(None).cast(t).alias(c) if c in gaps else F.col(c).cast(t).alias(c) for c, t in columns.items()]), gaps


def health(tables: Mapping[str, DataFrame | None], wanted: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """(source, detail, status, n) for each gap of each table; an absent table has a null count, an empty one zero."""
    out: list[DataFrame] = []
    present = [df for df in tables.values() if df is not None]
    for name, df in tables.items():
        if df is None:
            out.append(present[0].sparkSession.range(1).select(F.lit(name).alias("source"), F.lit(None).cast("string").alias("detail"), F.lit("absent").alias("status"), F.lit(None).cast("long").alias("n")))
            continue
        gaps = select_tolerant(df, wanted[name])[1]
        rows = F.array(*[F.struct(F.lit(g).alias("detail"), F.lit("schema gap").alias("status")) for g in gaps] or [F.struct(F.lit(None).cast("string").alias("detail"), F.lit("ok").alias("status"))])
        out.append(df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("source"), F.explode(rows).alias("g"), "n").select("source", "g.*", "n"))
    return reduce(DataFrame.unionByName, out)


def cross_check(found: DataFrame, stated: DataFrame, key: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Keys on which the computed and the stated values differ, or that one side lacks."""
    joined = found.alias("f").join(stated.alias("s"), list(key), "full_outer")
    same = reduce(lambda a, b: a & b, [F.col(f"f.{v}").eqNullSafe(F.col(f"s.{v}")) for v in values])
    return joined.filter(~same).select(*key, *[F.col(f"{side}.{v}").alias(f"{label}_{v}") for v in values for side, label in (("f", "found"), ("s", "stated"))])


def flatten_times(df: DataFrame) -> DataFrame:
    """Timestamp structs ``x`` become ``x_iso`` and ``x_epoch_ms``."""
    out: list[Column] = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        timed = f.dataType.typeName() == "struct" and "epoch_ms" in f.dataType.fieldNames()
        out += [iso(c["epoch_ms"]).alias(f"{f.name}_iso"), c["epoch_ms"].alias(f"{f.name}_epoch_ms")] if timed else [c]
    return df.select(*out)


def export_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as guarded text: nested values as JSON, times as ISO, absent columns null."""
    known = {f.name: f for f in df.schema.fields}
    return df.select(*[guard_cell(cell(known[c])).alias(c) if c in known else F.lit(None).cast("string").alias(c) for c in columns])


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    export_rows(df, columns).write.option("header", True).option("escape", '"').csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.json(path)
