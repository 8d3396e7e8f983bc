"""Canonical payments, reconciliation, filters, summaries, findings and the counterparty graph."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tracelens import verbs
from tracelens.functions.money import is_failed, is_pending, is_success, is_unknown
from tracelens.operators.skew import pick_first


def canonicalise(rows: DataFrame, group: str, row_id: str, priority: Column) -> DataFrame:
    """One row for each group: the highest priority, then the smallest id; ``n_aliases`` counts the others. One aggregate, combined before the shuffle."""
    fields = [c for c in rows.columns if c != group]
    rank = F.struct((-priority).alias("p"), F.col(row_id).alias("i"))
    best = rows.groupBy(group).agg(F.min_by(F.struct(*fields), rank).alias("_row"), (F.count(F.lit(1)) - 1).alias("n_aliases"))
    return best.select(group, "_row.*", "n_aliases")


def id_map(rows: DataFrame, group: str, row_id: str, priority: Column) -> DataFrame:
    """(id, primary) in long form: every row id with its group's primary id."""
    primary = canonicalise(rows, group, row_id, priority).select(group, F.col(row_id).alias("primary"))
    return rows.select(group, F.col(row_id).alias("id")).join(primary, group).select("id", "primary")


def known_cards(cards: DataFrame, ledger: DataFrame, card: str, candidates: Sequence[str], ledger_id: str) -> DataFrame:
    """Each card with the first of its candidate ids that the ledger knows, or null."""
    listed = cards.select(card, F.posexplode(F.array(*candidates)).alias("place", ledger_id))
    found = listed.join(ledger.select(ledger_id).distinct(), ledger_id).groupBy(card).agg(F.min_by(ledger_id, "place").alias("match"))
    return cards.join(found, card, "left")


def reconcile(ledger: DataFrame, cards: DataFrame, ledger_id: str, card: str, amount: str) -> DataFrame:
    """Ledger payments and the first card of each id that only cards know, tagged ``data_source``; cards carry ``match``."""
    own = ledger.select(F.col(ledger_id).alias("id"), amount).join(cards.filter("match is not null").select(F.col("match").alias("id")).distinct().withColumn("_seen", F.lit(True)), "id", "left")
    own = own.select("id", amount, F.when(F.col("_seen"), F.lit("both")).otherwise(F.lit("ledger")).alias("data_source"))
    lone = pick_first(cards.filter("match is null").select(F.col("first_id").alias("id"), amount, card), ["id"], F.col(card))
    return own.unionByName(lone.select("id", amount, F.lit("card").alias("data_source")))


def coverage(reconciled: DataFrame) -> DataFrame:
    """How many payments either side knows."""
    n = lambda *kinds: F.count_if(F.col("data_source").isin(*kinds))
    return reconciled.agg(n("ledger", "both").alias("ledger"), n("card", "both").alias("cards"), n("both").alias("overlap"), n("card").alias("card_only"), n("ledger").alias("ledger_only"), F.count(F.lit(1)).alias("combined"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both; a new value wins unless it is null or empty."""
    fields = [c for c in old.columns if c != key]
    joined = old.alias("o").join(new.alias("n"), key, "full_outer")
    pick = lambda c: F.coalesce(F.when(F.col(f"n.{c}").cast("string") != "", F.col(f"n.{c}")), F.col(f"o.{c}")).alias(c)
    return joined.select(key, *map(pick, fields))


def timeline(sources: Mapping[str, tuple[DataFrame, Column, Column]], limit: int | None = None) -> DataFrame:
    """(source, ref, ms) of every dated row of the sources (table, id, epoch ms), newest first."""
    out = None
    for name, (df, ref, ms) in sources.items():
        part = df.select(F.lit(name).alias("source"), ref.cast("string").alias("ref"), ms.cast("long").alias("ms")).filter("ms is not null")
        out = part if out is None else out.unionByName(part)
    ranked = out.orderBy(F.col("ms").desc(), "source", "ref")
    return ranked if limit is None else ranked.limit(limit)


def filter_payments(df: DataFrame, direction: str | None = None, state: str | None = None, least: int | None = None, most: int | None = None, kind: str | None = None) -> DataFrame:
    """The payments that every given criterion admits."""
    tests = [F.lit(True)]
    tests += [verbs.eq(F.col("direction"), direction)] if direction else []
    tests += [verbs.eq(F.col("state"), state)] if state else []
    tests += [verbs.eq(F.col("type"), kind)] if kind else []
    tests += [verbs.is_true(F.col("paise") >= least)] if least is not None else []
    tests += [verbs.is_true(F.col("paise") <= most)] if most is not None else []
    for t in tests:
        df = df.filter(t)
    return df


def facets(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, value, n) of the named fields in one pass and one shuffle."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    return df.select(pairs.alias("p")).groupBy("p.field", "p.value").agg(F.count(F.lit(1)).alias("n"))


def flow_totals(by: Sequence[str] = ()) -> list[Column]:
    """Counts of all payments and sums of the successful ones, by direction."""
    out = []
    for name in ("IN", "OUT"):
        way = F.col("direction") == name
        out += [F.count_if(way).alias(f"n_{name.lower()}"), F.coalesce(F.sum(F.when(way & is_success(F.col("state")), F.col("paise"))), F.lit(0)).alias(f"paise_{name.lower()}")]
    return out


def summary(df: DataFrame) -> DataFrame:
    """Headline counts, sums and dates of the payments."""
    s = F.col("state")
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_success(s)).alias("n_success"), F.count_if(is_failed(s)).alias("n_failed"),
        F.count_if(is_pending(s)).alias("n_pending"), F.count_if(is_unknown(s)).alias("n_unknown"), *flow_totals(),
        F.count_distinct("party").alias("n_parties"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"),
    )


def yearly(df: DataFrame) -> DataFrame:
    """Received, sent and net of the successful payments by year."""
    year = F.year(F.timestamp_millis(F.col("ms"))).alias("year")
    return df.groupBy(year).agg(*flow_totals()).withColumn("net", F.col("paise_in") - F.col("paise_out"))


def amount_rank(df: DataFrame, direction: str, n: int) -> DataFrame:
    """The n parties with the largest successful sum in one direction."""
    chosen = df.filter((F.col("direction") == direction) & is_success(F.col("state")))
    return chosen.groupBy("party").agg(F.sum("paise").alias("paise"), F.count(F.lit(1)).alias("n")).orderBy(F.col("paise").desc(), "party").limit(n)


def unambiguous(df: DataFrame, key: str, value: str) -> DataFrame:
    """key -> value where the key has exactly one value."""
    ends = df.filter(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("_high"))
    return ends.filter(F.col(value).eqNullSafe(F.col("_high"))).drop("_high")


def social_graph(payments: DataFrame, messages: DataFrame) -> DataFrame:
    """A node for each party: flows, first and last date, messages, and the rank in + out + messages / 5."""
    flows = payments.groupBy("party").agg(*flow_totals(), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"))
    chats = messages.groupBy("party").agg(F.count(F.lit(1)).alias("n_messages"))
    nodes = flows.join(chats, "party", "full_outer").fillna(0, ["n_in", "n_out", "paise_in", "paise_out", "n_messages"])
    return nodes.withColumn("score", (F.col("n_in") + F.col("n_out")) * 5 + F.col("n_messages"))


def corroboration(sources: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """(ref, score): how many of the sources (table, reference column) know a reference."""
    out = None
    for name, (df, ref) in sources.items():
        part = df.select(F.col(ref).cast("long").alias("ref"), F.lit(name).alias("source")).filter("ref is not null")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("ref").agg(F.count_distinct("source").alias("score"), F.count(F.lit(1)).alias("mentions"))


def retention_verdict(missing: DataFrame, ledger: DataFrame) -> DataFrame:
    """Payments that the ledger lacks: before its oldest row, inside its window, or undated."""
    dated = missing.withColumn("_oldest", ledger.agg(F.min("ms")).scalar())
    verdict = F.when(F.col("ms").isNull(), "undated").when(F.col("ms") < F.col("_oldest"), "before window").otherwise("inside window")
    return dated.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


#: Findings on payments: rule, severity, and what it counts. High value is 50 000 rupees.
HIGH_PAISE = 5_000_000


def findings(df: DataFrame) -> DataFrame:
    """(rule, n, paise): one row for each rule that some payment meets."""
    s = F.col("state")
    rules = {"failed": is_failed(s), "pending": is_pending(s), "unrecognised state": is_unknown(s), "high value": is_success(s) & (F.col("paise") >= HIGH_PAISE)}
    hit = F.filter(F.array(*[F.when(t, F.lit(r)) for r, t in rules.items()]), lambda x: x.isNotNull())
    return df.select("paise", F.explode(hit).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.sum("paise").alias("paise"))
