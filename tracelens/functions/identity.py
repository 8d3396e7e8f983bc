"""Phones, payment addresses and masked labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Patterns for identifiers in free text.
PHONE_PATTERN = r"(?:\+91[-\s]?|\+91|0?91)?([6-9]\d{9})\b"
ADDRESS_PATTERN = r"[A-Za-z0-9._-]+@[A-Za-z0-9._-]+"


def digits(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), r"[^0-9]", "")


def norm_phone(c: Column) -> Column:
    """Last ten digits, all digits when fewer, null when none."""
    d = F.right(digits(c), F.lit(10))
    return F.when(d != "", d)


def is_masked(c: Column) -> Column:
    """Masked at the source: a star anywhere, or a leading XX with a digit after it."""
    return F.coalesce(c.rlike(r"\*") | c.rlike(r"^[xX]{2}.*[0-9]"), F.lit(False))


def is_full_phone(c: Column) -> Column:
    return F.coalesce(~c.contains("*") & (F.length(digits(c)) >= 10), F.lit(False))


def looks_like_phone(c: Column) -> Column:
    return F.coalesce(digits(c).rlike(r"^(0?91)?[6-9][0-9]{9}$"), F.lit(False))


def phones_in(text: Column) -> Column:
    """All ten-digit phone cores in a text."""
    return F.regexp_extract_all(text, F.lit(PHONE_PATTERN), 1)


def addresses_in(text: Column) -> Column:
    """All address-like tokens (``local@handle``) in a text."""
    return F.regexp_extract_all(text, F.lit(ADDRESS_PATTERN), 0)


def norm_address(c: Column) -> Column:
    """Trimmed lower-case address, null without an ``@``."""
    v = F.lower(F.trim(c))
    return F.when(v.contains("@"), v)


def psp(c: Column) -> Column:
    """The handle after the last ``@``."""
    return F.when(c.contains("@"), F.lower(F.substring_index(c, "@", -1)))


def same_name(c: Column) -> Column:
    """Name with inner and outer blanks collapsed."""
    v = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(v != "", v)


def mask_agrees(phone: Column, mask: Column) -> Column:
    """The last four digits of a full phone equal those of the masked form."""
    return F.coalesce(F.right(phone, F.lit(4)) == F.right(digits(mask), F.lit(4)), F.lit(False))


def strong_ids(user_id: Column, connection_id: Column, phone: Column, address: Column) -> Column:
    """The collision-free identifiers of a counterparty (never names, never masked phones)."""
    return F.array_compact(
        F.array(
            F.when(user_id != "", F.concat(F.lit("uid:"), user_id)),
            F.when(connection_id != "", F.concat(F.lit("cid:"), connection_id)),
            F.when(is_full_phone(phone), F.concat(F.lit("ph:"), phone)),
            F.concat(F.lit("vpa:"), norm_address(address)),
        )
    )
