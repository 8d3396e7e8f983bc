"""Findings: what an examiner should look at, one row for each rule that something meets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracelens.functions.identity import digits, is_masked
from tracelens.functions.money import SUCCESS_STATES, FAILED_STATES, PENDING_STATES, is_failed, is_pending, is_success, is_unknown, norm_state
from tracelens.functions.values import filled, is_true
from tracelens.session import materialise

#: Share of free pages from which deletion was heavy or noticeable; paise of a high value; failed sends of a stuck upload; rows shown as samples. Fixed values.
HEAVY, NOTICEABLE, HIGH_PAISE, STUCK, SAMPLES = 0.20, 0.05, 5_000_000, 3, 5


def _finding(df: DataFrame, severity: Column | str, category: str, n: Column, detail: Column) -> DataFrame:
    """(severity, category, n, detail), no row where nothing was found."""
    level = F.lit(severity) if isinstance(severity, str) else severity
    return df.select(level.alias("severity"), F.lit(category).alias("category"), n.cast("long").alias("n"), F.to_json(detail).alias("detail")).filter("n > 0")


def _by(df: DataFrame, key: Column) -> Column:
    """(key, n) of all rows as a list, the most frequent first, then by key; for keys of a small domain."""
    counts = df.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "k"))), lambda x: F.struct(x["k"].alias("key"), (-x["o"]).alias("n")))).scalar()


def _sample(df: DataFrame, order: Column, fields: Column, n: int = SAMPLES) -> Column:
    """The first n rows in an order, as a list."""
    top = df.select(order.alias("o"), fields.alias("f")).orderBy("o").limit(n)
    return top.agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "f"))), lambda x: x["f"])).scalar()


def deletion_intensity(stores: DataFrame) -> DataFrame:
    """``stores`` (store, free_pages, total_pages) with the share of free pages and its grade; without pages there is no grade."""
    share = F.when(F.col("total_pages") > 0, F.col("free_pages") / F.col("total_pages"))
    grade = F.when(share > HEAVY, "high").when(share > NOTICEABLE, "medium").when(share.isNotNull(), "low")
    return stores.withColumns({"share": share, "intensity": grade})


def store_findings(stores: DataFrame) -> DataFrame:
    """A finding for each store with heavy deletion."""
    heavy = deletion_intensity(stores).filter("intensity = 'high'")
    return _finding(heavy, "high", "data_deletion", F.lit(1), F.struct("store", "free_pages", "total_pages"))


def payment_findings(payments: DataFrame) -> DataFrame:
    """Unsuccessful payments by state, states that nobody knows, and high values; each with its first five ids or its five largest payments.

    ``payments``: (id, state, paise, party).
    """
    s, state = F.col("state"), norm_state(F.col("state"))
    bad, odd, large = payments.filter(is_failed(s) | is_pending(s)), payments.filter(is_unknown(s)), payments.filter(is_success(s) & (F.col("paise") >= HIGH_PAISE))
    count = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.max("paise").alias("biggest"))
    largest = _sample(large, F.struct((-F.col("paise")).alias("p"), F.col("id").cast("string").alias("i")), F.struct(F.col("id").cast("string").alias("id"), "paise", F.col("party").cast("string").alias("party")))
    rules = [
        _finding(count(bad), "medium", "failed_transactions", F.col("n"), F.struct(_by(bad, state).alias("by_state"), _sample(bad, F.col("id"), F.col("id").cast("string")).alias("sample_ids"))),
        _finding(count(odd), "medium", "unrecognised_transaction_state", F.col("n"), F.struct(_by(odd, state).alias("by_state"), F.lit(len(SUCCESS_STATES)).alias("known_success"), F.lit(len(FAILED_STATES) + len(PENDING_STATES)).alias("known_failed"))),
        _finding(count(large), "info", "high_value_transactions", F.col("n"), F.struct("biggest", largest.alias("sample"))),
    ]
    return reduce(DataFrame.unionByName, rules)


def upload_findings(queue: DataFrame) -> DataFrame:
    """Uploads that failed three times and more."""
    stuck = queue.agg(F.count_if(F.col("failure_count") >= STUCK).alias("k"))
    return _finding(stuck, "info", "analytics_loss", F.col("k"), F.struct(F.col("k").alias("count")))


def missing_payment_findings(missing: DataFrame) -> DataFrame:
    """Payments that one source outside the ledger knows alone, by where they lie to its oldest row; mild if all of them are older.

    ``missing`` as ``evidence.missing_payments`` makes it.
    """
    # written, as the counts and the sample both read it and corroboration is long
    alone = materialise(missing.filter("score = 1").select("entity", "verdict"))
    v = F.col("verdict")
    counted = alone.agg(F.count(F.lit(1)).alias("k"), F.count_if(v == "before window").alias("before_window"), F.count_if(v == "inside window").alias("inside_window"), F.count_if(v.isin("undated", "no ledger dates")).alias("undated"))
    severity = F.when(F.col("inside_window") + F.col("undated") > 0, "medium").otherwise("info")
    sample = _sample(alone.filter("verdict = 'inside window'"), F.col("entity"), F.col("entity"))
    return _finding(counted, severity, "uncorroborated_transactions", F.col("k"), F.struct("before_window", "inside_window", "undated", sample.alias("sample_inside_window")))


def wallet_findings(wallets: DataFrame) -> DataFrame:
    """Wallets with a balance."""
    full = wallets.filter(F.col("paise") > 0).agg(F.count(F.lit(1)).alias("k"), F.sum("paise").alias("paise"))
    return _finding(full, "info", "wallet_balance", F.col("k"), F.struct("paise"))


def device_findings(devices: DataFrame) -> DataFrame:
    """A finding for each rooted device (model, is_rooted); an unknown state is none."""
    return _finding(devices.filter(is_true(F.col("is_rooted"))), "high", "rooted_device", F.lit(1), F.struct("model"))


def recovery_findings(recovered: DataFrame, scanned: DataFrame) -> DataFrame:
    """Recovered rows with their three most frequent tables, or else that nothing came back from the stores that were scanned, which proves nothing."""
    table = F.coalesce("table", F.lit("(ambiguous)"))
    some = recovered.agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("extent") == "high").alias("high"), F.count_if(F.col("ambiguous")).alias("several"))
    found = _finding(some, "high", "recovered_deleted_records", F.col("k"), F.struct(F.slice(_by(recovered, table), 1, 3).alias("by_table"), F.col("high").alias("high_confidence"), F.col("several").alias("ambiguous")))
    stores = scanned.agg(F.count(F.lit(1)).alias("k"))
    none = _finding(stores.filter(some.select(F.col("k") == 0).scalar()), "info", "no_deleted_records_recovered", F.col("k"), F.struct(F.col("k").alias("stores")))
    return found.unionByName(none)


def container_findings(inventory: DataFrame) -> DataFrame:
    """Encrypted containers, with the first names."""
    locked = inventory.filter(is_true(F.col("encrypted")))
    return _finding(locked.agg(F.count(F.lit(1)).alias("k")), "info", "encrypted_databases", F.col("k"), F.struct(_sample(locked, F.col("path"), F.col("path")).alias("names")))


def message_findings(summary: DataFrame) -> DataFrame:
    """What bank messages confirm, where some payment is not confirmed and some message speaks of money; ``summary`` of ``match_summary``."""
    told = summary.filter("uncorroborated > 0 and n_right > 0")
    return _finding(told, "info", "sms_corroboration", F.col("n_right"), F.struct("confirmed", "uncorroborated", "only_right"))


def detect_findings(*parts: DataFrame) -> DataFrame:
    """All findings as one table."""
    return reduce(DataFrame.unionByName, parts)


def weak_name(name: Column) -> Column:
    """A name that is absent, masked, or nothing but a number."""
    return F.coalesce(is_masked(name) | (F.replace(name, F.lit("+"), F.lit("")) == digits(name)), F.lit(True))


def rank_counterparties(payments: DataFrame, top: int = 20) -> DataFrame:
    """The counterparties with the largest successful sums in each direction, the ``top`` of either.

    ``payments``: (seq, direction, state, paise, user_id, phone, vpa, name, resolved, is_merchant).  A counterparty is its user id, else the last ten digits of a full phone, else its address, else its name.
    The label is the first recovered name, else the first that is neither masked nor a number, else the last other one, else the key.  One merchant row makes a merchant.
    Ranked by amount, then count, then label; Spark keeps no more than ``top`` rows of a direction in a task before they meet.
    """
    phone = F.when(~is_masked(F.col("phone")), F.right(digits(F.col("phone")), F.lit(10)))
    keys = {"uid": filled(F.col("user_id")), "ph": filled(phone), "vpa": F.lower(filled(F.col("vpa"))), "name": F.lower(filled(F.col("name")))}
    key = F.coalesce(*[F.when(v.isNotNull(), F.struct(F.lit(k).alias("kind"), v.alias("value"))) for k, v in keys.items()])
    good = payments.filter(is_success(F.col("state")) & F.col("paise").isNotNull() & F.col("direction").isin("IN", "OUT")).withColumns({"key": key, "resolved": filled(F.col("resolved")), "name": filled(F.col("name"))}).filter("key is not null")
    weak = weak_name(F.col("name"))
    first = lambda c, when: F.min_by(c, F.when(when, F.struct("seq", F.col(c).alias("v"))))
    label = F.coalesce(first("resolved", F.col("resolved").isNotNull()), first("name", ~weak), F.max_by("name", F.when(F.col("name").isNotNull(), F.struct("seq", "name"))), F.max("key.value"))
    ids = [F.count_distinct(keys[k]).alias(f"n_{k}") for k in ("uid", "ph", "vpa")]
    sums = good.groupBy("direction", "key").agg(
        F.sum("paise").alias("paise"), F.count(F.lit(1)).alias("n"), label.alias("label"), F.when(F.max(is_true(F.col("is_merchant"))), "Merchant").otherwise("Peer").alias("kind"), *ids,
    )
    place = F.row_number().over(Window.partitionBy("direction").orderBy(F.col("paise").desc(), F.col("n").desc(), "label", "key"))
    ranked = sums.withColumn("place", place).filter(F.col("place") <= top)
    return ranked.select("direction", "place", "label", "kind", "n", "paise", F.col("key.kind").alias("grouped_by"), F.col("key.value").alias("key"), *[f"n_{k}" for k in ("uid", "ph", "vpa")])
