"""Shared expenses: who paid, who owes whom, and nets that add up to nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tracelens.functions.values import is_true
from tracelens.operators.skew import lookup_join


def named_members(members: DataFrame, names: DataFrame) -> DataFrame:
    """``members`` with ``name``: the contact's by connection (connection, name), else the member's own name, else the connection, else the member id."""
    known = names.select("connection", F.col("name").alias("_known"))
    return lookup_join(members, known, "connection").withColumn("name", F.coalesce("_known", "own_name", "connection", F.col("member").cast("string"))).drop("_known")


def payers(members: DataFrame) -> DataFrame:
    """(expense, payer, paid, shares, n_members): the first payer by seq with what it has paid, and the sum of all shares."""
    pays = is_true(F.col("is_payer"))
    first = F.min(F.when(pays, F.struct("seq", "member", "paise")))
    return members.groupBy("expense").agg(first.alias("_first"), F.coalesce(F.sum("paise"), F.lit(0)).alias("shares"), F.count(F.lit(1)).alias("n_members")).select("expense", F.col("_first.member").alias("payer"), F.col("_first.paise").alias("paid"), "shares", "n_members")


def expenses(entries: DataFrame, members: DataFrame, settlements: DataFrame) -> DataFrame:
    """``entries`` (expense, ...) with payer, total and the payment that settled it.

    The total is what the payer paid; without a payer the sum of the shares.  ``settlements``: (expense, payment), of several the last id.
    Every entry stays, also one without members.
    """
    settled = settlements.groupBy("expense").agg(F.max("payment").alias("settlement"))
    rows = entries.join(payers(members), "expense", "left").join(settled, "expense", "left")
    return rows.withColumn("total", F.when(F.col("payer").isNotNull(), F.col("paid")).otherwise(F.coalesce("shares", F.lit(0)))).fillna(0, ["n_members"]).drop("paid", "shares")


def debts(members: DataFrame) -> DataFrame:
    """(expense, debtor, creditor, paise): each member owes its share to the expense's payer; payers and empty shares owe nothing."""
    to = payers(members).filter("payer is not null").select("expense", F.col("payer").alias("creditor"))
    owing = members.filter(~is_true(F.col("is_payer")) & (F.col("paise") != 0)).select("expense", F.col("member").alias("debtor"), "paise")
    return owing.join(to, "expense").filter("debtor <> creditor")


def pairwise_nets(owed: DataFrame) -> DataFrame:
    """(member, other, net): what ``other`` owes ``member`` over all expenses, once from either side, so that all nets add up to nothing.

    Both directions of a pair are one group, keyed by its lesser and greater member; settled pairs stay with a net of 0.
    """
    low, high = F.least("debtor", "creditor"), F.greatest("debtor", "creditor")
    signed = F.when(F.col("creditor") == low, F.col("paise")).otherwise(-F.col("paise"))
    nets = owed.groupBy(low.alias("low"), high.alias("high")).agg(F.sum(signed).alias("net"))
    sides = F.array(F.struct(F.col("low").alias("member"), F.col("high").alias("other"), F.col("net").alias("net")), F.struct(F.col("high").alias("member"), F.col("low").alias("other"), (-F.col("net")).alias("net")))
    return nets.select(F.explode(sides).alias("s")).select("s.*")


def balances(owed: DataFrame) -> DataFrame:
    """(member, to_give, to_receive, net) over all pairs; the sum of ``net`` is 0."""
    nets = pairwise_nets(owed)
    return nets.groupBy("member").agg(F.sum(F.greatest(-F.col("net"), F.lit(0))).alias("to_give"), F.sum(F.greatest("net", F.lit(0))).alias("to_receive"), F.sum("net").alias("net"))


def ledger_summary(rows: DataFrame, owed: DataFrame) -> DataFrame:
    """Expenses, their total, how many are settled, and members with a balance."""
    with_balance = balances(owed).agg(F.count_if(F.col("net") != 0).alias("n")).scalar()
    return rows.agg(F.count(F.lit(1)).alias("n_expenses"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.count_if(F.col("settlement").isNotNull()).alias("n_settled")).withColumn("n_with_balance", with_balance)
