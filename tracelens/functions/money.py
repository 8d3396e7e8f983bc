"""Money as whole paise; rupees only for display."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tracelens.functions.values import safe_long


def paise_to_inr(paise: Column) -> Column:
    """Rupees with two decimals; negative or missing amounts are null."""
    n = safe_long(paise)
    return F.when(n >= 0, (n / F.lit(100).cast("decimal(3,0)")).try_cast("decimal(18,2)"))


def rupees_to_paise(text: Column) -> Column:
    """Exact paise of a rupee text such as ``1,200.50`` (half-even beyond two decimals)."""
    exact = F.trim(F.regexp_replace(text.cast("string"), ",", "")).try_cast("decimal(24,6)")
    return F.bround(exact * 100, 0).try_cast("bigint")


# Amount pattern and money words of bank messages.
SMS_AMOUNT = r"(?iU)(?:rs\.?|inr|₹)\s*([0-9][0-9,]*(?:\.[0-9]{1,2})?)"
SMS_MONEY_WORDS = r"(?i)debit|credit|sent|received|paid|withdraw|spent|txn|transaction|a/c|upi"


def sms_paise(body: Column) -> Column:
    """Paise of the first amount in a message that also uses a money word; else null."""
    amount = F.regexp_extract(body, SMS_AMOUNT, 1)
    return F.when((amount != "") & body.rlike(SMS_MONEY_WORDS), rupees_to_paise(amount))


def rupee_text(amount: Column) -> Column:
    return F.concat(F.lit("₹"), F.format_number(amount, 2))


def payment_title(direction: Column, amount_inr: Column, kind: Column, party: Column) -> Column:
    """``OUT ₹1,234.50 → name``; without an amount the type stands in its place."""
    arrow = F.when(direction == "OUT", F.lit("→")).when(direction == "IN", F.lit("←")).otherwise(F.lit("·"))
    who = F.coalesce(party, F.lit("?"))
    head = F.when(
        amount_inr.isNotNull(), F.concat(F.coalesce(direction, F.lit("?")), F.lit(" "), rupee_text(amount_inr))
    ).otherwise(kind)
    return F.concat_ws(" ", head, arrow, who)


# Payment states by meaning (compared on the trimmed upper-case text).
SUCCESS_STATES = ["COMPLETED", "SUCCESS", "SETTLED", "SUCCEEDED"]
FAILED_STATES = [
    "ERRORED", "ERROR", "FAILED", "FAILURE", "REJECTED", "DECLINED",
    "CANCELLED", "CANCELED", "TIMED_OUT", "EXPIRED",
]
PENDING_STATES = ["PENDING", "IN_PROGRESS", "INITIATED", "CREATED"]


def norm_state(state: Column) -> Column:
    return F.upper(F.trim(F.coalesce(state, F.lit(""))))


def is_success(state: Column) -> Column:
    return norm_state(state).isin(SUCCESS_STATES)


def is_failed(state: Column) -> Column:
    return norm_state(state).isin(FAILED_STATES)


def is_pending(state: Column) -> Column:
    return norm_state(state).isin(PENDING_STATES)


def is_unknown(state: Column) -> Column:
    """A state is present but in none of the known sets."""
    s = norm_state(state)
    return (s != "") & ~s.isin(SUCCESS_STATES + FAILED_STATES + PENDING_STATES)
