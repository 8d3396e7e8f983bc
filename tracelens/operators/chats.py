"""Conversations from their member rows, with the device's owner inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracelens.functions.values import filled, is_true
from tracelens.operators.skew import lookup_join


def most_frequent(members: DataFrame, group: str, key: str) -> Column:
    """The key that lies in the most groups, the least one of a tie, as a scalar subquery; null without any.

    Counted in two levels, so that a key in every group costs a row for each task.
    """
    once = members.select(group, F.col(key).alias("key")).filter(filled(F.col("key")).isNotNull()).distinct()
    counts = once.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.min_by("key", F.struct((-F.col("n")).alias("n"), F.col("key").alias("k")))).scalar()


def with_owner(members: DataFrame) -> DataFrame:
    """``members`` with ``is_owner``: the connection found in the most groups; by masked phone only where a row has no connection."""
    owner, masked = most_frequent(members, "group_id", "connection"), most_frequent(members, "group_id", "masked_phone")
    told = members.withColumns({"owner_connection": owner, "owner_masked": masked})
    own = F.when(filled(F.col("connection")).isNotNull(), F.col("connection") == F.col("owner_connection")).otherwise(F.col("masked_phone") == F.col("owner_masked"))
    return told.withColumn("is_owner", is_true(own))


def conversations(groups: DataFrame, members: DataFrame, people: DataFrame) -> DataFrame:
    """One row for each of ``groups`` (group_id, name, ...): size, whether it is a group, and the counterparty.

    ``members``: (group_id, seq, connection, display_name, masked_phone, deleted), deleted ones included, for an old member is still
    the counterparty; only the size leaves them out.  The counterparty is the first member by seq who is not the owner; if all are, the first whose
    connection is not the owner's, else the first.  ``people``: (connection, phone, name), one row a connection.
    Every group stays, also without members.
    """
    marked = with_owner(members)
    strange = ~F.col("connection").eqNullSafe(F.col("owner_connection"))
    tier = F.when(~F.col("is_owner"), 0).when(strange, 1).otherwise(2)
    rank = F.struct(tier.alias("tier"), "seq", "connection", "display_name", "masked_phone")
    live = ~is_true(F.col("deleted"))
    sized = marked.groupBy("group_id").agg(
        F.count_if(live).alias("n_members"), F.count_if(~F.col("is_owner")).alias("n_others"), F.max("is_owner").alias("owner_present"), F.min(rank).alias("other"),
    )
    other = {f"other_{c}": F.col(f"other.{c}") for c in ("connection", "display_name", "masked_phone")}
    rows = groups.join(sized, "group_id", "left").withColumns(other).drop("other").fillna(0, ["n_members", "n_others"]).fillna(False, ["owner_present"])
    known = people.select(F.col("connection").alias("other_connection"), F.col("phone").alias("other_phone"), F.col("name").alias("other_name"))
    return lookup_join(rows, known, "other_connection").withColumn("is_group", F.col("n_members") > 2)


def member_phones(members: DataFrame, people: DataFrame) -> DataFrame:
    """(group_id, phone) of everyone but the owner, each once, in long form: a group may have any number of members."""
    others = with_owner(members).filter(~F.col("is_owner"))
    found = others.join(people.select("connection", "phone"), "connection").filter(filled(F.col("phone")).isNotNull())
    return found.select("group_id", "phone").distinct()
