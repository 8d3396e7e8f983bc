"""Contacts of several source tables as one list of people, with their contradictions, directories and links."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tracelens.functions.identity import digits, norm_phone
from tracelens.functions.values import filled, first_filled, is_true, not_none_text, tri_bool
from tracelens.operators.payments import flow_totals
from tracelens.operators.skew import lookup_join, pick_first

#: A phonebook row of this change state is deleted. Fixed value.
DELETED = 3
#: The group size of a group that states none. Fixed value.
UNKNOWN_SIZE = 99


def contact_rows(phones: DataFrame, addresses: DataFrame, profiles: DataFrame, names: DataFrame) -> DataFrame:
    """One row for each source row: seq, source, connection, phone, vpa, name, bank_name, on_app, upi_state.

    ``phones``: (seq, phone, connection, bank_name, on_app, upi_state), named by ``names`` (connection, name; one row each) before their bank name; ``addresses``:
    (seq, vpa, nick_name, bank_name, connection); ``profiles``: (seq, destination, name, bank_name, connection), whose destination is an address if it has an @, else a phone.  Only the first
    source states whether a person is on the app; the others leave it unknown.
    """
    known = names.select("connection", F.col("name").alias("_name"))
    none = F.lit(None).cast("string")
    verified = lookup_join(phones, known, "connection").select(
        "seq", F.lit("phone contacts").alias("source"), "connection", norm_phone(F.col("phone")).alias("phone"), none.alias("vpa"), first_filled(F.col("_name"), F.col("bank_name")).alias("name"), "bank_name",
        tri_bool(F.col("on_app")).alias("on_app"), "upi_state",
    )
    unknown = [F.lit(None).cast("boolean").alias("on_app"), none.alias("upi_state")]
    by_address = addresses.select("seq", F.lit("address contacts").alias("source"), "connection", none.alias("phone"), "vpa", first_filled(F.col("nick_name"), F.col("bank_name")).alias("name"), "bank_name", *unknown)
    to, at = F.coalesce("destination", F.lit("")), F.col("destination").contains("@")
    by_profile = profiles.select(
        "seq", F.lit("payment profiles").alias("source"), "connection", F.when(~is_true(at), norm_phone(to)).alias("phone"), F.when(at, to).alias("vpa"), first_filled(F.col("name"), F.col("bank_name")).alias("name"), "bank_name", *unknown,
    )
    return reduce(DataFrame.unionByName, [verified, by_address, by_profile])


def person_key() -> Column:
    """Connection, else phone, else address, else the row itself."""
    return F.coalesce(filled(F.col("connection")), filled(F.col("phone")), filled(F.col("vpa")), F.concat("source", F.lit("#"), F.col("seq").cast("string")))


def with_row_counts(rows: DataFrame) -> DataFrame:
    """``rows`` with ``person`` and ``n_rows``, the number of source rows of the same person; the counts are joined, so that a person of many rows is never one task's."""
    keyed = rows.withColumn("person", person_key())
    return lookup_join(keyed, keyed.groupBy("person").agg(F.count(F.lit(1)).alias("n_rows")), "person")


def contradictions(rows: DataFrame) -> DataFrame:
    """(person, field, stated, phones) where rows of one person state different things; both are listed and neither is preferred.

    Flags and states are few, the phones are the distinct ones that the person's rows hold.
    """
    keyed = rows.withColumn("person", person_key())
    facts = F.explode(F.array(F.struct(F.lit("on_app").alias("field"), F.col("on_app").cast("string").alias("value")), F.struct(F.lit("upi_state").alias("field"), F.col("upi_state").alias("value")))).alias("f")
    stated = keyed.select("person", facts).filter("f.value is not null").groupBy("person", "f.field").agg(F.array_join(F.array_sort(F.collect_set("f.value")), ",").alias("stated"), F.count_distinct("f.value").alias("n")).filter("n > 1").drop("n")
    phones = keyed.join(stated.select("person").distinct(), "person", "left_semi").groupBy("person").agg(F.array_join(F.array_sort(F.collect_set("phone")), ",").alias("phones"))
    return stated.join(phones, "person")


def contact_summary(rows: DataFrame, phonebook: DataFrame, strangers: DataFrame) -> DataFrame:
    """People and source rows apart, people on the app, addresses, deleted phonebook rows, and numbers that were looked up but not saved."""
    people = rows.withColumn("person", person_key()).groupBy("person").agg(F.max("on_app").alias("on_app"), F.count(F.lit(1)).alias("n"), F.count_if(filled(F.col("vpa")).isNotNull()).alias("v"))
    counted = people.agg(
        F.count(F.lit(1)).alias("n_people"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count_if("on_app").alias("n_on_app"), F.coalesce(F.sum("v"), F.lit(0)).alias("n_with_address"), F.count_if(F.col("n") > 1).alias("n_several_rows"),
    )
    book = phonebook.agg(F.struct(F.count(F.lit(1)).alias("n"), F.count_if(is_true(F.col("deleted"))).alias("d")).alias("s")).scalar()
    other = strangers.agg(F.struct(F.count(F.lit(1)).alias("n"), F.count_if(F.col("phone").isNotNull()).alias("p"), F.count_if(is_true(F.col("use_case") == "CONTACT_SEARCH")).alias("l")).alias("s")).scalar()
    row = counted.withColumns({"_b": book, "_o": other})
    return row.select(*counted.columns, F.col("_b.n").alias("n_phonebook"), F.col("_b.d").alias("n_deleted"), F.col("_o.n").alias("n_strangers"), F.col("_o.p").alias("n_strangers_with_phone"), F.col("_o.l").alias("n_looked_up"))


def phonebook_rows(entries: DataFrame, metadata: DataFrame) -> DataFrame:
    """Phonebook entries (contact_id, lookup, raw_number, is_valid, change_state) with name and image size by lookup (lookup, display_name, image_size), and whether they are deleted."""
    known = metadata.filter("lookup is not null").groupBy("lookup").agg(F.max("display_name").alias("name"), F.max("image_size").alias("image_size"))
    rows = lookup_join(entries, known, "lookup")
    return rows.select("contact_id", "lookup", "raw_number", norm_phone(F.col("raw_number")).alias("number"), "name", F.coalesce("image_size", F.lit(0)).alias("image_size"), is_true(F.col("is_valid")).alias("is_valid"), is_true(F.col("change_state") == DELETED).alias("deleted"))


def stranger_rows(rows: DataFrame) -> DataFrame:
    """Numbers that the subject met but did not save (connection, use_case, phone, known, hidden, region); the words for nothing count as nothing."""
    phone = not_none_text(F.col("phone"))
    return rows.select("connection", "use_case", phone.alias("phone"), norm_phone(phone).alias("number"), is_true(tri_bool(F.col("known"))).alias("known"), is_true(tri_bool(F.col("hidden"))).alias("hidden"), not_none_text(F.col("region")).alias("region"))


def contact_dimension(verified: DataFrame, strangers: DataFrame) -> DataFrame:
    """(phone, verified, cbs, on_app, connection, image_url), one row for each phone of either source.

    Of several verified rows of a phone the last by seq holds; rows of strangers only fill gaps, the earlier before the later.  ``verified``: (seq, phone, verified, on_app, connection);
    ``strangers``: (seq, phone, cbs, on_app, connection, image_url).
    """
    mine = pick_first(verified.withColumn("phone", norm_phone(F.col("phone"))).filter("phone is not null"), ["phone"], F.struct((-F.col("seq")).alias("s"), "verified", "connection"), ["seq", "verified", "on_app", "connection"])
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.struct("seq", F.col(c).alias("v")))).alias(f"s_{c}")
    theirs = strangers.withColumn("phone", norm_phone(F.col("phone"))).filter("phone is not null").groupBy("phone").agg(
        *map(first, ("cbs", "image_url")), F.min_by("on_app", F.when(F.col("on_app").isNotNull(), F.col("seq"))).alias("s_on_app"), F.min_by("connection", F.struct("seq", "connection")).alias("s_connection"),
    )
    both = mine.join(theirs, "phone", "full_outer")
    return both.select("phone", "verified", F.col("s_cbs").alias("cbs"), F.coalesce("on_app", "s_on_app").alias("on_app"), F.when(F.col("seq").isNotNull(), F.col("connection")).otherwise(F.col("s_connection")).alias("connection"), F.col("s_image_url").alias("image_url"))


def connection_directory(sources: Mapping[str, DataFrame]) -> DataFrame:
    """(connection, phone, verified, cbs): for each field the first filled value, by the order of the sources and then seq.

    Sources are tables of (seq, connection, phone, verified, cbs).
    """
    parts = [df.select("connection", norm_phone(F.col("phone")).alias("phone"), F.trim("verified").alias("verified"), F.trim("cbs").alias("cbs"), "seq", F.lit(k).alias("place")) for k, df in enumerate(sources.values())]
    rows = reduce(DataFrame.unionByName, parts).filter(filled(F.col("connection")).isNotNull())
    first = lambda c: F.min_by(c, F.when(filled(F.col(c)).isNotNull(), F.struct("place", "seq", F.col(c).alias("v")))).alias(c)
    return rows.groupBy("connection").agg(*map(first, ("phone", "verified", "cbs")))


def saved_names(phonebook: DataFrame) -> DataFrame:
    """(phone, name): the first name by seq that the phonebook (seq, number, name) has for a phone."""
    rows = phonebook.withColumn("phone", norm_phone(F.col("number"))).filter(F.col("phone").isNotNull() & filled(F.col("name")).isNotNull())
    return rows.groupBy("phone").agg(F.min_by("name", F.struct("seq", "name")).alias("name"))


def chat_links(contacts: DataFrame, members: DataFrame, groups: DataFrame) -> DataFrame:
    """``contacts`` with ``chat_group``: of the groups that a contact's connection is a member of the smallest, the first by seq of several; a group without a size counts as large.

    ``members``: (seq, group_id, connection, is_self); ``groups``: (group_id, size), one row each.
    """
    others = members.filter(~is_true(F.col("is_self")) & filled(F.col("connection")).isNotNull() & F.col("group_id").isNotNull())
    sizes = groups.select("group_id", F.when(F.col("size") > 0, F.col("size")).alias("_size"))
    sized = lookup_join(others, sizes, "group_id")
    best = sized.groupBy("connection").agg(F.min_by("group_id", F.struct(F.coalesce("_size", F.lit(UNKNOWN_SIZE)).alias("s"), "seq")).alias("chat_group"))
    return lookup_join(contacts, best, "connection")


def contact_activity(contacts: DataFrame, payments: DataFrame, key: str) -> DataFrame:
    """``contacts`` with the counts and successful sums of their payments by ``key``, zeros for those without."""
    flows = payments.filter(F.col(key).isNotNull()).groupBy(key).agg(*flow_totals())
    return lookup_join(contacts, flows, key).fillna(0, ["n_in", "paise_in", "n_out", "paise_out"])


def holding(df: DataFrame, text: str, columns: list[str]) -> Column:
    """Any of the columns holds the text, in either case; lists by their joined values."""
    shown = {f.name: F.array_join(F.col(f.name), " ") if f.dataType.typeName() == "array" else F.col(f.name).cast("string") for f in df.schema.fields}
    return reduce(lambda a, b: a | b, [is_true(F.lower(shown[c]).contains(text.lower())) for c in columns])


def profile(text: str, contacts: DataFrame, phonebook: DataFrame, payments: DataFrame, groups: DataFrame, messages: DataFrame, rewards: DataFrame) -> dict[str, DataFrame]:
    """All that is known about whoever a text names: contacts, payments, messages of groups with such a name, rewards of those payments, and sums."""
    people = contacts.filter(holding(contacts, text, ["phone", "name", "vpa", "bank_name"])).select(F.lit("contact").alias("origin"), "phone", "name", "vpa")
    book = phonebook.filter(holding(phonebook, text, ["number", "name", "raw_number"])).select(F.lit("phonebook").alias("origin"), F.col("number").alias("phone"), "name", F.lit(None).cast("string").alias("vpa"))
    paid = payments.filter(holding(payments, text, ["party", "phone", "vpa", "search_tokens"]))
    talk = messages.join(groups.filter(holding(groups, text, ["name"])).select("group_id"), "group_id", "left_semi")
    given = rewards.join(paid.select(F.col("id").alias("payment")), "payment", "left_semi")
    n = lambda df: df.agg(F.count(F.lit(1))).scalar()
    found = people.unionByName(book)
    sums = paid.agg(F.count(F.lit(1)).alias("n_payments"), *flow_totals()).withColumns({"n_contacts": n(found), "n_messages": n(talk), "n_rewards": n(given), "net": F.col("paise_in") - F.col("paise_out")})
    return {"contacts": found, "payments": paid, "messages": talk, "rewards": given, "summary": sums}
