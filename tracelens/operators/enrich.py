"""Fields filled from ordered sources, with a record of which source filled them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tracelens.functions.identity import digits
from tracelens.functions.values import filled
from tracelens.operators.skew import lookup_join

OWN = "own"
#: The fields that are filled, in the order in which later ones may rest on earlier ones.
FIELDS = ("direction", "name", "connection", "verified", "cbs", "phone", "note", "saved")


def waterfall(tiers: Mapping[str, Column]) -> tuple[Column, Column]:
    """(value, tier): the first not null value of the tiers and the name of its tier, null without any."""
    value = F.coalesce(*tiers.values())
    return value, F.coalesce(*[F.when(v.isNotNull(), F.lit(k)) for k, v in tiers.items()])


def with_waterfall(df: DataFrame, field: str, tiers: Mapping[str, Column]) -> DataFrame:
    """``df`` with ``field`` from the first tier that has it, and ``<field>_by``."""
    value, by = waterfall(tiers)
    return df.withColumns({field: value, f"{field}_by": by})


def patch_counts(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, tier, n): how many rows each tier filled, own values and rows that stay empty left out; all fields in one pass."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_by").alias("tier")) for f in fields])
    told = df.select(F.explode(pairs).alias("p")).filter(F.col("p.tier").isNotNull() & (F.col("p.tier") != OWN))
    return told.groupBy("p.field", "p.tier").agg(F.count(F.lit(1)).alias("n"))


def observed(df: DataFrame, fields: Sequence[str], observation) -> DataFrame:
    """``df`` that leaves the number of patched rows of each field in ``observation`` while an action of the caller reads it; no job of its own."""
    return df.observe(observation, *[F.count_if(F.col(f"{f}_by").isNotNull() & (F.col(f"{f}_by") != OWN)).alias(f) for f in fields])


def full(phone: Column) -> Column:
    """The phone, unless it is masked or blank."""
    return F.when(~phone.contains("*"), filled(phone))


def _by_id(messages: DataFrame) -> DataFrame:
    """(id, chat, group_id): the first message by seq that names an id, and the first group among those that lie in one."""
    told = messages.select(F.explode(F.filter("ids", lambda x: filled(x).isNotNull())).alias("id"), "seq", "group_id", F.struct("way", "other_name", "other_phone", "note").alias("chat"))
    group = F.col("group_id").isNotNull()
    return told.groupBy("id").agg(F.min_by("chat", F.struct("seq", "chat")).alias("chat"), F.min_by("group_id", F.when(group, F.struct("seq", "group_id"))).alias("group_id"))


def known_tails(payments: DataFrame) -> DataFrame:
    """(tail, tail_cbs): for the last four characters of a phone the first bank name that a full ledger row gives them; at most one row for each tail."""
    rows = payments.filter((F.col("data_source") == "ledger") & filled(F.col("phone")).isNotNull() & filled(F.col("cbs")).isNotNull())
    return rows.groupBy(F.right("phone", F.lit(4)).alias("tail")).agg(F.min_by("cbs", F.struct("id", "cbs")).alias("tail_cbs"))


def enrich_payments(payments: DataFrame, messages: DataFrame, conversations: DataFrame, contacts: DataFrame, phonebook: DataFrame) -> DataFrame:
    """``payments`` with every field of ``FIELDS`` filled where some source knows it, and ``<field>_by`` beside it.

    ``payments``: (id, global_id, data_source, *FIELDS); ``messages``: (seq, ids, group_id, way, other_name, other_phone, note); ``conversations``: (group_id, connection, verified, cbs,
    display_name, phone, member_phone, masked_phone), one row a group; ``contacts``: (phone, verified, cbs), one row a phone; ``phonebook``: (phone, name), one row a phone.

    A direction that is neither SENT nor RECEIVED counts as none.  A payment meets the first message that names its id, else its global id; its conversation likewise.  A full phone beats every masked one.  Bank names also come from the contact of the
    phone and then from other payments with the same last four digits.  Payments are never multiplied: each join is to one row a key, and rows without the key go round it.
    """
    ways = F.when(F.upper(filled(F.col("chat.way"))) == "IN", "RECEIVED").when(F.upper(filled(F.col("chat.way"))) == "OUT", "SENT")
    by_id = _by_id(messages)
    hits = lambda key: by_id.select(F.col("id").alias(key), F.col("chat").alias(f"{key}_chat"), F.col("group_id").alias(f"{key}_group"))
    rows = lookup_join(payments.withColumn("_id", filled(F.col("id"))), hits("_id"), "_id")
    rows = lookup_join(rows.withColumn("_global", filled(F.col("global_id"))), hits("_global"), "_global")
    rows = rows.withColumns({"chat": F.coalesce("_id_chat", "_global_chat"), "group_id": F.coalesce("_id_group", "_global_group")})
    talk = conversations.select("group_id", *[F.col(c).alias(f"c_{c}") for c in conversations.columns if c != "group_id"])
    rows = lookup_join(rows, talk, "group_id")
    own = said = lambda c: filled(F.col(c))
    rows = with_waterfall(rows, "direction", {OWN: F.when(F.col("direction").isin("RECEIVED", "SENT"), F.col("direction")), "chat": ways})
    rows = with_waterfall(rows, "name", {OWN: own("name"), "chat": said("chat.other_name"), "conversation": said("c_display_name")})
    rows = with_waterfall(rows, "connection", {OWN: own("connection"), "conversation": said("c_connection")})
    rows = with_waterfall(rows, "phone", {OWN: own("phone"), "conversation": said("c_phone"), "member": said("c_member_phone"), "masked member": said("c_masked_phone"), "masked chat": said("chat.other_phone")})
    people = contacts.select(F.col("phone").alias("_phone"), F.col("verified").alias("p_verified"), F.col("cbs").alias("p_cbs"))
    rows = lookup_join(rows.withColumn("_phone", full(F.col("phone"))), people, "_phone")
    rows = lookup_join(rows, phonebook.select(F.col("phone").alias("_phone"), F.col("name").alias("b_name")), "_phone")
    rows = with_waterfall(rows, "verified", {OWN: own("verified"), "conversation": said("c_verified"), "contact": said("p_verified")})
    rows = with_waterfall(rows, "cbs", {OWN: own("cbs"), "conversation": said("c_cbs"), "contact": said("p_cbs")})
    rows = lookup_join(rows.withColumn("tail", F.when(F.col("cbs").isNull(), F.right("_phone", F.lit(4)))), known_tails(payments), "tail")
    rows = rows.withColumns({"cbs_by": F.coalesce("cbs_by", F.when(F.col("tail_cbs").isNotNull(), "same tail")), "cbs": F.coalesce("cbs", "tail_cbs")})
    rows = with_waterfall(rows, "note", {OWN: own("note"), "chat": F.trim(said("chat.note"))})
    rows = with_waterfall(rows, "saved", {OWN: own("saved"), "phonebook": said("b_name")})
    kept = [c for c in payments.columns if c not in FIELDS]
    return rows.select(*kept, "group_id", *[c for f in FIELDS for c in (f, f"{f}_by")])


def masked_label(name: Column) -> Column:
    """A name that is nothing but a masked phone."""
    rest = F.replace(F.trim(name), F.lit("*"), F.lit(""))
    return F.coalesce(name.contains("*") & (rest != "") & (rest == digits(rest)), F.lit(False))


def label_groups(groups: DataFrame, conversations: DataFrame, payments: DataFrame, clusters: DataFrame, identifiers: DataFrame, phonebook: DataFrame) -> DataFrame:
    """``groups`` (group_id, name) with full_phone, cluster, the label shown and which of seven sources gave it.

    ``conversations``: (group_id, connection, display_name, phone, masked_phone), one row a group; ``payments``: (id, group_id, phone, cluster); ``clusters``: (cluster, display_name); ``identifiers``:
    (identifier, cluster), one row an identifier (``cid:`` or ``ph:``); ``phonebook``: (phone, name).  The phone is the conversation's if full, else that of the group's first payment with a full one; the cluster that of its
    first payment with one, else by connection, else by phone.  A person's name beats a number, a number beats a mask.
    """
    paid = payments.filter("group_id is not null").groupBy("group_id").agg(
        F.min_by("phone", F.when(full(F.col("phone")).isNotNull(), F.struct("id", "phone"))).alias("p_phone"), F.min_by("cluster", F.when(F.col("cluster").isNotNull(), F.struct("id", "cluster"))).alias("p_cluster"),
    )
    talk = conversations.select("group_id", "connection", F.col("display_name").alias("c_display"), F.col("phone").alias("c_phone"), F.col("masked_phone").alias("c_masked"))
    rows = lookup_join(lookup_join(groups, talk, "group_id"), paid, "group_id")
    rows = rows.withColumn("full_phone", F.coalesce(full(F.col("c_phone")), full(F.col("p_phone"))))
    lookup = lambda k: identifiers.select(F.col("identifier").alias(f"_{k}"), F.col("cluster").alias(f"{k}_cluster"))
    open_ = F.col("p_cluster").isNull()
    rows = lookup_join(rows.withColumn("_cid", F.when(open_, F.concat(F.lit("cid:"), filled(F.col("connection"))))), lookup("cid"), "_cid")
    rows = lookup_join(rows.withColumn("_ph", F.when(open_ & F.col("cid_cluster").isNull(), F.concat(F.lit("ph:"), F.col("full_phone")))), lookup("ph"), "_ph")
    rows = rows.withColumn("cluster", F.coalesce("p_cluster", "cid_cluster", "ph_cluster"))
    rows = lookup_join(rows, clusters.select("cluster", F.col("display_name").alias("k_name")), "cluster")
    rows = lookup_join(rows, phonebook.select(F.col("phone").alias("full_phone"), F.col("name").alias("b_name")), "full_phone")
    name = filled(F.col("name"))
    tiers = {
        "group": F.when(~masked_label(name), name), "cluster": F.when(F.col("k_name") != "(unknown)", filled(F.col("k_name"))), "phonebook": filled(F.col("b_name")), "phone": F.col("full_phone"),
        "masked name": name, "member": filled(F.col("c_display")), "masked phone": filled(F.col("c_masked")),
    }
    return with_waterfall(rows, "label", tiers).select(*groups.columns, "full_phone", "cluster", "label", "label_by")
