"""Who a counterparty is: name directory, exact recovery of masked labels, clusters and their attributes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from tracelens.functions.identity import digits, is_full_phone, is_masked, same_name
from tracelens.functions.values import filled
from tracelens.operators.components import connected_components
from tracelens.operators.payments import unambiguous
from tracelens.operators.skew import null_spread_join, pick_first
from tracelens.session import materialise


def identity_directory(sources: Mapping[str, DataFrame]) -> DataFrame:
    """(connection, name, origin, priority): each name of a connection once, from the first source that has it.

    Sources are (connection, name) tables in order of trust; masked and blank names are ignored, and names that differ
    in case or blanks are one.  A connection's rows by priority and name are its ordered list.
    """
    out = None
    for place, (origin, df) in enumerate(sources.items()):
        named = df.select("connection", same_name(F.col("name")).alias("name"), F.lit(origin).alias("origin"), F.lit(place).alias("priority"))
        out = named if out is None else out.unionByName(named)
    usable = out.filter(F.col("connection").isNotNull() & F.col("name").isNotNull() & ~is_masked(F.col("name")))
    keyed = usable.withColumn("_key", F.lower("name"))
    return pick_first(keyed, ["connection", "_key"], F.struct("priority", "name")).drop("_key")


def first_names(directory: DataFrame) -> DataFrame:
    """(connection, name): the name that comes first in each connection's list."""
    return directory.groupBy("connection").agg(F.min_by("name", F.struct("priority", "name")).alias("name"))


def reverse_index(owners: DataFrame, key: str, names: DataFrame) -> DataFrame:
    """(key, connection) of the keys that exactly one named connection owns."""
    return unambiguous(owners.join(names.select("connection"), "connection", "left_semi"), key, "connection")


def recover_masked(df: DataFrame, name: str, keys: Mapping[str, DataFrame], names: DataFrame) -> DataFrame:
    """Masked names replaced where a key leads to one named connection; ``matched_by`` tells the first key that did.

    ``keys`` maps a column of ``df`` to its reverse index, in the order in which they are tried.
    """
    out, tried = df, []
    for key, index in keys.items():
        told = index.join(names, "connection").select(key, F.col("name").alias(f"_{key}_name"))
        out = null_spread_join(out, told, key)
        tried.append(key)
    masked = is_masked(F.col(name))
    found = F.coalesce(*[F.col(f"_{k}_name") for k in tried])
    by = F.coalesce(*[F.when(F.col(f"_{k}_name").isNotNull(), F.lit(k)) for k in tried])
    shown = F.when(masked, F.coalesce(found, F.col(name))).otherwise(F.col(name))
    return out.select(*[c for c in df.columns if c != name], shown.alias(name), F.when(masked, by).alias("matched_by"))


def resolve_counterparties(payments: DataFrame, payment: str, ids: Column) -> DataFrame:
    """(payment, cluster): payments that share a strong identifier, directly or through others, are one counterparty.

    ``ids`` is an array such as ``strong_ids`` gives; a payment without any is a cluster of its own.
    """
    named = F.concat(F.lit("pmt:"), F.col(payment).cast("string"))
    own = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array_compact(F.when(F.col(payment).isNotNull(), F.col("_ids")))))))
    grouped = payments.select(payment, ids.alias("_ids")).groupBy(payment).agg(F.count(F.lit(1)).alias("_times"), own.alias("_ids"))
    grouped = materialise(grouped.select(payment, named.alias("_node"), "_times", "_ids", F.get("_ids", F.lit(0)).alias("_first")))
    # only payments with several identifiers link any; the others need no part in the graph
    links = grouped.filter(F.size("_ids") > 1).select(F.col("_first").alias("src"), F.explode(F.slice("_ids", 2, F.size("_ids"))).alias("dst")).distinct()
    linked = connected_components(links).select(F.col("node").alias("_first"), F.col("component").alias("_root"))
    least = grouped.filter("_first is not null").groupBy("_first").agg(F.min("_node").alias("_node"))
    rooted = materialise(least.join(linked, "_first", "left").select("_first", F.coalesce("_root", "_first").alias("_root"), "_node"))
    labels = rooted.groupBy("_root").agg(F.least("_root", F.min("_node")).alias("cluster"))
    told = null_spread_join(grouped.drop("_ids"), rooted.select("_first", "_root").join(labels, "_root").select("_first", "cluster"), "_first")
    return told.select(payment, F.coalesce("cluster", "_node").alias("cluster"), F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_")).drop("_")


def weak_links(lone: DataFrame, members: DataFrame, seq: str) -> DataFrame:
    """``lone`` with ``cluster``: the first cluster by ``seq`` that owns a full phone with the same last four digits.

    ``lone`` holds payments without strong identifiers and a masked ``phone``; no two clusters are ever merged.
    """
    tail = lambda c: F.right(digits(F.col(c)), F.lit(4))
    first = members.filter(is_full_phone(F.col("phone"))).groupBy(tail("phone").alias("_tail")).agg(F.min_by("cluster", F.struct(seq, "cluster")).alias("cluster"))
    keyed = lone.withColumn("_tail", F.when(is_masked(F.col("phone")) & (F.length(tail("phone")) == 4), tail("phone")))
    return null_spread_join(keyed, first, "_tail").drop("_tail")


def cluster_attributes(rows: DataFrame, cluster: str, trust: Column) -> DataFrame:
    """Rows, distinct names and the display name of each cluster: the most trusted (least ``trust``), then the longest name."""
    name = filled(F.col("name"))
    rank = F.struct(trust.alias("t"), (-F.length("name")).alias("l"), F.col("name").alias("n"))
    return rows.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(name).alias("n_names"), F.min_by("name", F.when(name.isNotNull(), rank)).alias("display_name"))


def current_clusters(refs: DataFrame, ref: str, clusters: DataFrame) -> DataFrame:
    """``refs`` with ``cluster``: a payment id, or its old ``pmt:`` label, leads to the cluster it now belongs to."""
    key = F.regexp_replace(F.col(ref).cast("string"), "^pmt:", "")
    return null_spread_join(refs.withColumn("_id", key), clusters.select(F.col("payment").cast("string").alias("_id"), "cluster"), "_id").drop("_id")


def tag_self(df: DataFrame, owner: Column) -> DataFrame:
    """``is_self``, ``direction`` and ``other`` by equality of sender and receiver names with the owner's."""
    same = lambda c: F.coalesce(F.lower(same_name(F.col(c))) == F.lower(same_name(owner)), F.lit(False))
    out, in_ = same("sender"), same("receiver")
    direction = F.when(out & in_, "SELF").when(out, "OUT").when(in_, "IN").otherwise("UNKNOWN")
    return df.select("*", (out & in_).alias("is_self"), direction.alias("direction"), F.when(out, F.col("receiver")).when(in_, F.col("sender")).alias("other"))
