"""Null, number, boolean and set helpers used by every other module."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Decimal or scientific notation, without the type suffixes that a cast would take.
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def filled(c: Column) -> Column:
    """The text, or null when it is empty or blank."""
    return F.when(F.trim(c) != "", c)


def first_filled(*cols: Column) -> Column:
    """First non-empty text."""
    return F.coalesce(*[filled(c) for c in cols])


def not_none_text(c: Column) -> Column:
    """Stores that write the word for an absent value: read it as absent."""
    return F.when(~F.trim(c).isin("", "None", "null", "NULL", "nil"), c)


def safe_long(c: Column) -> Column:
    """Whole number or null: fractions are cut, other text and numbers beyond 64 bits are null."""
    text = F.trim(c.cast("string"))
    number = F.when(text.rlike(_NUMBER), text.try_cast("double"))
    exact = F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))
    return F.coalesce(exact, F.when(F.abs(number) < F.lit(9.2e18), number.try_cast("bigint")))


def safe_double(c: Column) -> Column:
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def tri_bool(c: Column) -> Column:
    """True, false or null: unknown words and missing values stay null."""
    text = F.lower(F.trim(c.cast("string")))
    return (
        F.when(text.isin("true", "yes", "1"), F.lit(True))
        .when(text.isin("false", "no", "0"), F.lit(False))
    )


def sorted_set(c: Column) -> Column:
    """Sorted distinct values as an array; only for columns from a small fixed domain."""
    return F.array_sort(F.collect_set(c))


def is_true(c: Column) -> Column:
    """Two-valued truth: null counts as false."""
    return F.coalesce(c, F.lit(False))
