"""Nested values: decoded columns, every leaf of a document, and what identities and messages they hold."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tracelens.functions.identity import ADDRESS_PATTERN, digits, is_masked, norm_address, phones_in
from tracelens.functions.payload import at, decode_b64_json, decode_json, kind_at, long_at, text_at
from tracelens.functions.values import filled

#: How deep documents are opened. Fixed value.
DEPTH = 12


def decode_json_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The text columns as VARIANT: a value that is whole JSON between braces or brackets is decoded, any other stays its text."""
    texts = [f.name for f in df.schema.fields if f.dataType.typeName() == "string" and (columns is None or f.name in columns)]
    looks = lambda c: c.rlike(r"(?s)^(\{.*\}|\{.*\]|\[.*\]|\[.*\})\z")
    decoded = lambda c: F.coalesce(F.when(looks(c), F.try_parse_json(c)), c.cast("variant"))
    return df.withColumns({c: decoded(F.col(f"`{c}`")) for c in texts})


def leaves(df: DataFrame, value: str, depth: int = DEPTH) -> DataFrame:
    """One row for each leaf of the VARIANT column ``value``, with ``path`` (dotted keys and places) and ``leaf`` (VARIANT) beside the other columns.

    Objects and lists are opened level by level in one narrow pipeline that never shuffles: a leaf passes through the levels below it unchanged.
    What lies deeper than ``depth`` stays whole, as do empty objects and lists; a null document gives one row with null path.
    """
    tvf, others = df.sparkSession.tvf, [c for c in df.columns if c != value]
    rows = df.select(*others, F.lit(None).cast("string").alias("path"), F.col(value).alias("leaf"))
    for _ in range(depth):
        opened = rows.lateralJoin(tvf.variant_explode_outer(F.col("leaf").outer()))
        inside, step = F.col("pos").isNotNull(), F.coalesce("key", F.col("pos").cast("string"))
        path = F.when(inside, F.concat_ws(".", "path", step)).otherwise(F.col("path"))
        rows = opened.select(*others, path.alias("path"), F.when(inside, F.col("value")).otherwise(F.col("leaf")).alias("leaf"))
    return rows


def values_seen(leaf_rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, kind, value) of every full phone and address in any leaf, each once; phones by their last ten digits, masked ones never."""
    text = F.try_variant_get("leaf", "$", "string")
    phones = F.transform(F.when(~is_masked(text), phones_in(text)), lambda p: F.struct(F.lit("phone").alias("kind"), F.right(digits(p), F.lit(10)).alias("value")))
    addresses = F.transform(F.regexp_extract_all(text, F.lit(ADDRESS_PATTERN), 0), lambda a: F.struct(F.lit("address").alias("kind"), norm_address(a).alias("value")))
    none = F.array().cast("array<struct<kind:string,value:string>>")
    found = leaf_rows.select(*by, F.explode(F.concat(F.coalesce(phones, none), F.coalesce(addresses, none))).alias("v"))
    return found.select(*by, "v.kind", "v.value").distinct()


def first_by_source(sources: Mapping[str, DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """(by, attribute, value, source): for each attribute the first filled value, by the order of the sources and then ``seq``.

    Sources are tables of (by, attribute, value, seq); masked values only stand where no source has another.
    """
    parts = [df.select(*by, "attribute", "value", "seq", F.lit(name).alias("source"), F.lit(k).alias("place")) for k, (name, df) in enumerate(sources.items())]
    rows = reduce(DataFrame.unionByName, parts).filter(filled(F.col("value")).isNotNull())
    best = F.min(F.struct(is_masked(F.col("value")).alias("masked"), "place", "seq", "value", "source"))
    return rows.groupBy(*by, "attribute").agg(best.alias("b")).select(*by, "attribute", "b.value", "b.source")


_PARAMS = "template.templateParams.value"


def _first(values: Column) -> Column:
    """The first not null of an array, or null."""
    return F.get(F.filter(values, lambda x: x.isNotNull()), F.lit(0))


def notice_content(payload: Column) -> Column:
    """kind, sync_key, title, subtitle, body, deeplink and template of a decoded notification.

    A payload with system and operation is an instruction between machines.  Of the others the placements are read in order up to the first with a title;
    each part is the first that they fill, the body from its older or newer key, the link from its keys or from a redirection entry named url.
    """
    places = F.filter(F.coalesce(F.try_variant_get(payload, "$.data.placements", "array<variant>"), F.array().cast("array<variant>")), lambda p: F.schema_of_variant(p).startswith("OBJECT"))
    titles = F.transform(places, lambda p: F.coalesce(text_at(p, f"{_PARAMS}.title").isNotNull(), F.lit(False)))
    stop = F.array_position(titles, True).cast("int")
    read = F.slice(places, F.lit(1), F.when(stop > 0, stop).otherwise(F.size(places)))

    def link(p: Column) -> Column:
        nav = "template.nav.params"
        entries = F.coalesce(F.try_variant_get(p, f"$.{nav}.redirection_data.data", "array<variant>"), F.array().cast("array<variant>"))
        told = F.transform(entries, lambda e: F.when(at(e, "key") == "url", text_at(e, "value")))
        return F.coalesce(text_at(p, f"{nav}.deepLink", f"{nav}.deepLinkIOS", f"{nav}.deeplink"), _first(told))

    part = lambda *names: _first(F.transform(read, lambda p: text_at(p, *[f"{_PARAMS}.{n}" for n in names])))
    machine = F.coalesce(text_at(payload, "system").isNotNull() & text_at(payload, "operation").isNotNull(), F.lit(False))
    title = part("title")
    kind = F.when(machine, F.concat_ws("/", at(payload, "system"), at(payload, "operation"))).otherwise(F.coalesce(text_at(payload, "type"), F.when(title.isNotNull(), "NOTIFICATION"), F.lit("unclassified")))
    human = lambda c: F.when(~machine, c)
    return F.struct(
        kind.alias("kind"), F.when(machine, at(payload, "key")).alias("sync_key"), human(title).alias("title"), human(part("subTitle")).alias("subtitle"), human(part("message", "body")).alias("body"),
        human(_first(F.transform(read, link))).alias("deeplink"), human(at(F.get(read, F.lit(0)), "template.templateId")).alias("template"),
    )


def delivered_messages(rows: DataFrame, message_id: str, envelope: str) -> DataFrame:
    """Stored envelopes as messages: ids, topic, content, dates, whether a person saw it, and whether its payload can't be decoded.

    The envelope is JSON with the message under ``message``, whose payload is base64 of another JSON.  Every row stays.
    """
    outer = rows.withColumn("_message", F.try_variant_get(decode_json(F.col(envelope)), "$.message", "variant"))
    stated = at(F.col("_message"), "payload")
    inner = outer.withColumn("_payload", decode_b64_json(stated))
    read = inner.withColumn("_content", notice_content(F.col("_payload")))
    m, p = F.col("_message"), F.col("_payload")
    shown = F.coalesce(F.col("_content.title"), F.col("_content.body")).isNotNull()
    undecodable = F.coalesce((kind_at(m, "payload") != "VOID") & p.isNull(), F.lit(False))
    return read.select(
        F.coalesce(text_at(m, "id"), F.col(message_id).cast("string")).alias("message_id"), at(m, "serverId").alias("server_id"), at(m, "topicId").alias("topic_id"), "_content.*",
        long_at(m, "created").alias("created_ms"), long_at(p, "sentAt").alias("sent_ms"), shown.alias("is_notification"), undecodable.alias("payload_undecodable"),
    )


def message_summary(messages: DataFrame) -> DataFrame:
    """Messages by kind with their dates and how many no reader can decode."""
    return messages.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_notification").alias("n_seen"), F.count_if("payload_undecodable").alias("n_undecodable"), F.min("created_ms").alias("first_ms"), F.max("created_ms").alias("last_ms"))
