"""Transaction rows from two stores: payloads with party legs, and payloads beside a table of tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracelens.functions import classify as rules
from tracelens.functions.identity import digits, is_masked, norm_phone
from tracelens.functions.payload import at, decode_json, kind_at, long_at, text_at
from tracelens.functions.time import decode_id_ts, norm_ms
from tracelens.functions.values import filled, first_filled, is_true, safe_long, tri_bool
from tracelens.operators.skew import lookup_join

#: Tags of the leg layout that become fields. Fixed values.
LEG_TAGS = {"category": "entity.category", "received_in_type": "receivedIn.type", "mode_tag": "context.transferMode", "internal_tag": "isInternalPayment"}


def tag_fields(tags: DataFrame, key: str, wanted: dict[str, str]) -> DataFrame:
    """One row for each ``key`` with the first filled value by seq of every wanted tag (field -> tag); ``tags``: (key, seq, tag, value)."""
    value = lambda tag: F.when((F.col("tag") == tag) & filled(F.col("value")).isNotNull(), F.struct("seq", "value"))
    return tags.filter(F.col("tag").isin(*wanted.values()) & F.col(key).isNotNull()).groupBy(key).agg(*[F.min_by("value", value(tag)).alias(field) for field, tag in wanted.items()])


def leg(v: Column, *names: str, only_object: bool = False) -> Column:
    """The first of the legs that is an object with some field, or a list that begins with one; null without any."""
    found = []
    for n in names:
        for path in ([n] if only_object else [f"{n}[0]", n]):
            found.append(F.when(is_true(kind_at(v, path).rlike("^OBJECT<[^>]")), F.try_variant_get(v, f"$.{path}", "variant")))
    return F.coalesce(*found)


def _least_zero(*amounts: Column) -> Column:
    """The first amount that is a number of at least zero."""
    return F.coalesce(*[F.when(a >= 0, a) for a in amounts])


def search_tokens(tokens: DataFrame, key: str) -> DataFrame:
    """(key, search_text): the distinct tokens of a row in order, two blanks between."""
    return tokens.filter(F.col(key).isNotNull() & filled(F.col("token")).isNotNull()).groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(F.trim("token"))), "  ").alias("search_text"))


def leg_transactions(rows: DataFrame, tags: DataFrame, tokens: DataFrame, own_members: DataFrame, by_phone: DataFrame, by_address: DataFrame, by_member: DataFrame) -> DataFrame:
    """Rows of the leg layout as transactions.

    ``rows``: (id, ref, type, state, data, instruments, contact_data, payment_reference, created, updated, show_on_history); ``tags``: (ref, seq, tag, value); ``tokens``: (ref, token); ``own_members``: (member);
    ``by_phone``, ``by_address``, ``by_member``: (phone, address or member; name, full_phone), one row each.

    The stated actor outranks a type that does not say the direction itself; of a split settlement the side on which only the owner stands decides.  The counterparty is the leg that names the other
    party in full, else the plain one.  Masked names are replaced by an exact match of a full phone, then of an address; settlements take the name of the other member.
    """
    ready = rows.withColumn("v", decode_json(F.col("data"))).withColumn("v", F.when(F.schema_of_variant("v").startswith("OBJECT"), F.col("v")))
    v, kind = F.col("v"), F.coalesce("type", F.lit("UNKNOWN"))
    settles = kind == "EXPENSE_SETTLEMENT"
    ready = ready.withColumns({"type": kind, "payer": F.when(settles, text_at(v, "payerMemberId")), "payee": F.when(settles, text_at(v, "payeeMemberId"))})
    own = own_members.filter("member is not null").select(F.col("member").cast("string").alias("m")).distinct()
    for side in ("payer", "payee"):
        ready = lookup_join(ready, own.select(F.col("m").alias(side), F.lit(True).alias(f"{side}_own")), side)
    payer, payee = is_true(F.col("payer_own")), is_true(F.col("payee_own"))
    way = rules.settlement_direction(F.col("type"), rules.direction_of_legs(F.col("type"), v), payer, payee)
    other_member = F.when(payer & ~payee, F.col("payee")).when(payee & ~payer, F.col("payer"))
    ready = ready.withColumns({"direction": way, "other_member": other_member})
    incoming = F.col("direction") == "IN"
    sender = F.upper(at(v, "actor")) == "SENDER"
    mine = F.when(incoming, leg(v, "receivedIn", "to")).otherwise(F.coalesce(leg(v, "paidFrom", "receivedIn"), F.when(is_true(sender), leg(v, "from"))))
    ready = ready.withColumns({"cp": F.when(incoming, leg(v, "paymentPayerParty", "from")).otherwise(leg(v, "paymentReceiver", "to")), "own": mine})
    ready = ready.withColumn("_tool", decode_json(F.col("instruments"))).withColumn("_tool", F.coalesce(F.try_variant_get("_tool", "$[0]", "variant"), "_tool"))
    cp, mine = F.col("cp"), F.col("own")
    paise = _least_zero(long_at(v, "amount"), long_at(mine, "amount"), long_at(cp, "amount"), long_at(F.col("_tool"), "amount"))
    contact = filled(F.col("contact_data"))
    phone = F.coalesce(text_at(cp, "phone", "upiNumber"), F.when(contact.rlike("^[0-9]+$"), contact))
    address, stated, shown = text_at(cp, "fullVpa", "vpa"), text_at(cp, "cbsName", "accountHolderName"), at(cp, "name")
    hidden = stated.isNull() & is_true(shown.startswith("*") | is_masked(shown))
    ready = ready.withColumns({"paise": paise, "cp_phone": phone, "cp_vpa": address, "masked": hidden, "cp_name": F.coalesce(stated, F.when(hidden, F.coalesce(phone, address, shown)).otherwise(filled(shown)), contact)})
    veiled = F.col("masked") | is_masked(F.col("cp_name"))
    ready = ready.withColumns({"_phone": F.when(veiled & ~is_masked(F.col("cp_phone")), norm_phone(F.col("cp_phone"))), "_vpa": F.when(veiled & ~is_masked(F.col("cp_vpa")), F.lower("cp_vpa"))})
    merchant = is_true(at(cp, "type") == "MERCHANT")
    house = is_true(at(cp, "firstPartyMerchant") == "true")
    # what the payloads say is read before the lookups, which then carry plain values and neither payloads nor legs
    said = ready.select(
        "id", F.coalesce(text_at(v, "globalPaymentId"), filled(F.col("payment_reference")), F.col("id")).alias("global_id"), "type", F.coalesce("state", F.lit("UNKNOWN")).alias("state"), "direction", "paise", "cp_name", "cp_phone", "cp_vpa",
        at(cp, "userId").alias("counterparty_user_id"), rules.classify_by_leg(at(cp, "type"), house, F.col("type")).alias("classification"),
        at(mine, "accountHolderName").alias("self_holder"), at(mine, "accountNumber").alias("self_account"), at(mine, "vpa").alias("self_vpa"), at(mine, "ifsc").alias("self_ifsc"), at(mine, "utr").alias("utr"), text_at(v, "context.transferMode").alias("stated_mode"),
        at(v, "context.initiationMode").alias("initiation_mode"), rules.stated_mode(v, "QR_SCAN").alias("is_qr_scan"), rules.stated_mode(v, "INTENT").alias("is_intent"), F.coalesce(text_at(v, "responseCode"), at(mine, "transactionResponseCode")).alias("response_code"), F.when(merchant, at(cp, "merchantId")).alias("merchant_id"),
        F.when(merchant, first_filled(shown, at(cp, "merchantId"))).when(house, at(cp, "accountHolderName")).alias("merchant_name"), norm_ms(F.col("created")).alias("ms"), norm_ms(F.col("updated")).alias("updated_ms"),
        decode_id_ts(first_filled(F.col("id"), F.col("payment_reference"))).alias("id_ms"), F.when(F.col("show_on_history").isNull(), False).otherwise(~is_true(tri_bool(F.col("show_on_history")))).alias("dismissed"),
        "ref", "_phone", "_vpa", F.when(F.col("cp_name").isNull(), F.col("other_member")).alias("_member"),
    )
    dim = lambda df, key, to: df.select(F.col(key).alias(to), F.struct("name", "full_phone").alias(f"{to}_hit"))
    said = lookup_join(lookup_join(said, dim(by_phone, "phone", "_phone"), "_phone"), dim(by_address, "address", "_vpa"), "_vpa")
    said = lookup_join(said, dim(by_member.withColumn("member", F.col("member").cast("string")), "member", "_member"), "_member")
    told = tag_fields(tags, "ref", LEG_TAGS).join(search_tokens(tokens, "ref"), "ref", "full")
    said = lookup_join(said, told, "ref")
    hit = F.coalesce(F.when(filled(F.col("_phone_hit.name")).isNotNull(), F.struct(F.col("_phone_hit.name").alias("name"), F.col("_phone_hit.full_phone").alias("full"), F.lit("phone").alias("by"))), F.when(filled(F.col("_vpa_hit.name")).isNotNull(), F.struct(F.col("_vpa_hit.name").alias("name"), F.col("_vpa_hit.full_phone").alias("full"), F.lit("address").alias("by"))))
    return said.withColumn("hit", hit).select(
        "id", "global_id", "type", "state", "direction", "paise", "category", "received_in_type",
        F.coalesce("cp_name", "_member_hit.name").alias("counterparty"), F.col("hit.name").alias("resolved"), F.col("hit.by").alias("resolved_by"), F.when(F.col("hit").isNotNull(), F.coalesce("hit.full", F.when(~is_masked(F.col("cp_phone")), F.col("cp_phone")))).alias("phone_full"),
        F.coalesce("cp_phone", "_member_hit.full_phone").alias("counterparty_phone"), F.col("cp_vpa").alias("counterparty_vpa"), "counterparty_user_id", "classification",
        "self_holder", "self_account", "self_vpa", "self_ifsc", "utr", F.coalesce("stated_mode", "mode_tag").alias("transfer_mode"),
        "initiation_mode", "is_qr_scan", "is_intent", "response_code", "merchant_id",
        "merchant_name", F.coalesce("search_text", F.lit("")).alias("search_text"), "ms", "updated_ms",
        "id_ms", "dismissed", is_true(safe_long(F.col("internal_tag")) != 0).alias("is_internal"),
    )


def tag_transactions(rows: DataFrame, tags: DataFrame) -> DataFrame:
    """Rows of the tag layout as transactions: (pk, id, global_id, type, state, data, tags_data, created), and ``tags`` (pk, seq, tag, value).

    The type alone says the direction.  The counterparty is the sending leg of what came in and the receiving leg of the rest, else the tag ``sentTo``; the amount is the tag payload's, the payload's, the owner
    leg's, the tag's: the first that is a number of at least zero.
    """
    ready = lookup_join(rows, tag_fields(tags, "pk", {"sent_to": "sentTo", "amount_tag": "amount"}), "pk")
    ready = ready.withColumns({"v": decode_json(F.col("data")), "w": decode_json(F.col("tags_data")), "type": F.coalesce("type", F.lit("UNKNOWN"))})
    v = F.col("v")
    incoming = rules.direction_of_type(F.col("type")) == "IN"
    ready = ready.withColumns({"cp": F.when(incoming, leg(v, "from", only_object=True)).otherwise(leg(v, "to", "paidTo", only_object=True)), "other": F.when(incoming, leg(v, "to", only_object=True)).otherwise(leg(v, "from", only_object=True)), "own": leg(v, "receivedIn", "paidFrom")})
    cp, other, own, to = F.col("cp"), F.col("other"), F.col("own"), F.col("sent_to")
    inner = F.when(long_at(v, "amount") != 0, long_at(v, "amount"))
    return ready.select(
        "pk", "id", "global_id", "type", F.coalesce("state", F.lit("UNKNOWN")).alias("state"), rules.direction_of_type(F.col("type")).alias("direction"), _least_zero(long_at(F.col("w"), "amount"), F.coalesce(inner, long_at(own, "amount"), long_at(v, "amount")), safe_long(F.col("amount_tag"))).alias("paise"),
        F.coalesce(text_at(cp, "name", "cbsName"), to).alias("counterparty"), F.coalesce(text_at(cp, "phone"), F.when(to == digits(to), to)).alias("counterparty_phone"), F.coalesce(text_at(cp, "vpa", "upiNumber"), F.when(to.contains("@"), to)).alias("counterparty_vpa"),
        at(cp, "userId").alias("counterparty_user_id"), at(own, "accountHolderName").alias("self_holder"), F.coalesce(text_at(other, "vpa"), at(own, "vpa")).alias("self_vpa"), at(own, "ifsc").alias("self_ifsc"), at(own, "utr").alias("utr"), at(v, "context.transferMode").alias("transfer_mode"),
        at(v, "responseCode").alias("response_code"), norm_ms(F.col("created")).alias("ms"), decode_id_ts(first_filled(F.col("global_id"), F.col("id"))).alias("id_ms"),
    )


def owner_identity(transactions: DataFrame) -> DataFrame:
    """(kind, value, n): what the owner's own legs say about the owner, in long form."""
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in (("holder", "self_holder"), ("address", "self_vpa"), ("branch", "self_ifsc"))])
    return transactions.select(F.explode(pairs).alias("p")).filter(filled(F.col("p.value")).isNotNull()).groupBy("p.kind", "p.value").agg(F.count(F.lit(1)).alias("n"))
