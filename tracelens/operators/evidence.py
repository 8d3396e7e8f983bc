"""How many independent sources know a payment, when each record names it by several ids."""

from __future__ import annotations

from collections.abc import Collection, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tracelens.functions.values import filled
from tracelens.operators.components import connected_components

#: Kinds of reference that assert a movement of money, so that a ledger row is expected. Fixed values.
PAYMENT_KINDS = ("ledger_row", "chat_payment_card", "chat_receipt", "chat_settlement", "reward_link", "split_settlement")


def _records(sources: Mapping[str, DataFrame]) -> DataFrame:
    """All records with at least one id: source, place (of the source), first id, ids, kind, ms, paise, party."""
    parts = []
    for place, (name, df) in enumerate(sources.items()):
        ids = F.array_distinct(F.filter(F.transform("ids", lambda x: x.cast("string")), lambda x: filled(x).isNotNull()))
        kept = df.select(F.lit(name).alias("source"), F.lit(place).alias("place"), ids.alias("ids"), "kind", F.col("ms").cast("long").alias("ms"), F.col("paise").cast("long").alias("paise"), "party")
        parts.append(kept.filter(F.size("ids") > 0).withColumn("id", F.col("ids")[0]))
    return reduce(DataFrame.unionByName, parts)


def alias_entities(records: DataFrame) -> DataFrame:
    """(id, entity) of every id in the arrays ``ids``: ids of one record are one entity, also through other records.

    A record is a star from its first id to the others, never all pairs; an id that only ever stands alone is its own
    entity and takes no part in the rounds.
    """
    edges = records.filter(F.size("ids") > 1).select(F.col("ids")[0].alias("src"), F.explode(F.slice("ids", 2, F.size("ids"))).alias("dst"))
    linked = connected_components(edges).select(F.col("node").alias("id"), F.col("component").alias("entity"))
    alone = records.select(F.explode("ids").alias("id")).distinct().join(linked.select("id"), "id", "left_anti")
    return linked.unionByName(alone.select("id", F.col("id").alias("entity")))


def corroborate(sources: Mapping[str, DataFrame], payment_kinds: Collection[str] = PAYMENT_KINDS) -> DataFrame:
    """One row for each entity: how many sources refer to it, how, and the first date, amount and party that they state.

    Sources are tables of (ids, kind, ms, paise, party) in order of trust; ``ids`` is an array of which blank ones are ignored.
    ``entity`` is the least id, ``n_aliases`` the number of its ids, ``score`` the number of distinct sources.  Amount and party are the first not null,
    by source, then date, then first id.  ``expects_ledger_row`` tells whether any reference is of a payment kind.
    """
    records = _records(sources)
    entities = alias_entities(records)
    order = F.struct("place", F.coalesce("ms", F.lit(2**62)).alias("ms"), "id")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(order, F.col(c).alias("v"))))
    told = records.drop("ids").join(entities, "id")
    facts = told.groupBy("entity").agg(
        F.size(F.collect_set("source")).alias("score"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"),
        F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("ref_kinds"), F.coalesce(F.max(F.col("kind").isin(*payment_kinds)), F.lit(False)).alias("expects_ledger_row"),
        F.count(F.lit(1)).alias("mentions"), F.min("ms").alias("earliest_ms"), first("paise").alias("paise"), first("party").alias("party"),
    )
    sizes = entities.groupBy("entity").agg(F.count(F.lit(1)).alias("n_aliases"))
    return facts.join(sizes, "entity")


def ranked(index: DataFrame) -> DataFrame:
    """Best corroborated first, then by id, both descending."""
    return index.orderBy(F.col("score").desc(), F.col("entity").desc())


def corroboration_summary(index: DataFrame) -> DataFrame:
    """Entities, ids, the highest score, and how many entities one source alone knows."""
    return index.agg(
        F.count(F.lit(1)).alias("n_entities"), F.coalesce(F.sum("n_aliases"), F.lit(0)).alias("n_ids"),
        F.coalesce(F.max("score"), F.lit(0)).alias("max_score"), F.count_if(F.col("score") == 1).alias("n_single_source"),
    )


def ledger_window(ledger: DataFrame) -> Column:
    """The date of the oldest ledger row, as a scalar subquery."""
    return ledger.agg(F.min("ms")).scalar()


def missing_payments(index: DataFrame, ledger: DataFrame, ledger_source: str) -> DataFrame:
    """Entities that ought to be in the ledger and are not, with ``verdict`` and ``severity``.

    One dated before the oldest ledger row may have aged out, so its severity is low; one inside the ledger's window is high;
    without a date, or without any dated ledger row, it is medium.
    """
    absent = ~F.array_contains(F.split("sources", ","), ledger_source) & F.col("expects_ledger_row")
    rows = index.filter(absent).withColumn("oldest_ms", ledger_window(ledger))
    verdict = F.when(F.col("earliest_ms").isNull(), "undated").when(F.col("oldest_ms").isNull(), "no ledger dates").when(F.col("earliest_ms") < F.col("oldest_ms"), "before window").otherwise("inside window")
    severity = F.when(verdict == "inside window", "high").when(verdict == "before window", "low").otherwise("medium")
    return rows.withColumns({"verdict": verdict, "severity": severity}).drop("oldest_ms")
