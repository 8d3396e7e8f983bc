"""Filters over whole tables, pages with whole counts, and pages by key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracelens.functions.text import row_text
from tracelens.functions.values import is_true

#: Rows of a page at most. Fixed value.
MOST_ROWS = 5_000


def matching(df: DataFrame, text: str | None = None, contains: Mapping[str, str] | None = None) -> Column:
    """Rows that hold the text anywhere and, column by column, every given part; letters in either case, null columns never."""
    tests = [F.lit(True)]
    if text and text.strip():
        tests.append(is_true(row_text(df).contains(text.lower().strip())))
    tests += [is_true(F.lower(F.col(c).cast("string")).contains(part.lower())) if c in df.columns else F.lit(False) for c, part in (contains or {}).items() if part]
    return reduce(lambda a, b: a & b, tests)


def filter_table(df: DataFrame, text: str | None = None, contains: Mapping[str, str] | None = None) -> DataFrame:
    return df.filter(matching(df, text, contains))


def counted_view(df: DataFrame, wanted: Column, order: Sequence[Column], limit: int) -> DataFrame:
    """The first ``limit`` wanted rows with ``total`` (all rows), ``matched`` and ``truncated``, none of which the limit changes.

    The counts are one aggregate beside the page, of which the plan reads only the columns of the test.
    """
    counts = df.agg(F.struct(F.count(F.lit(1)).alias("total"), F.count_if(wanted).alias("matched")).alias("c")).scalar()
    page = df.filter(wanted).orderBy(*order).limit(limit).withColumn("_c", counts)
    return page.select(*df.columns, F.col("_c.total").alias("total"), F.col("_c.matched").alias("matched"), (F.col("_c.matched") > limit).alias("truncated"))


def observed_view(df: DataFrame, wanted: Column, order: Sequence[Column], limit: int, observation) -> DataFrame:
    """The same page in one pass over the table: the counts are in ``observation`` (total, matched) once an action has read the page."""
    seen = df.observe(observation, F.count(F.lit(1)).alias("total"), F.count_if(wanted).alias("matched"))
    return seen.filter(wanted).orderBy(*order).limit(limit)


def _beyond(keys: Sequence[tuple[str, bool]], last: Sequence[object]) -> Column:
    """Rows after ``last`` in the order of the keys (column, descending), nulls last in either direction."""
    out, same = F.lit(False), F.lit(True)
    for (name, down), value in zip(keys, last, strict=True):
        c = F.col(name)
        after = F.lit(False) if value is None else (c < F.lit(value) if down else c > F.lit(value)) | c.isNull()
        out = out | same & is_true(after)
        same = same & c.eqNullSafe(F.lit(value))
    return out


def key_page(df: DataFrame, keys: Sequence[tuple[str, bool]], limit: int, after: Sequence[object] | None = None) -> DataFrame:
    """A page of at most 5 000 rows in the order of ``keys`` with ``has_more``; ``after`` holds the key values of the last row of the page before.

    The keys together must be unique.  A page costs a filter and a bounded top, however far it lies, where an offset would sort and throw away
    all rows before it.
    """
    limit = max(1, min(limit, MOST_ROWS))
    order = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in keys]
    rest = df if after is None else df.filter(_beyond(keys, after))
    top = rest.orderBy(*order).limit(limit + 1)
    # the window spans limit + 1 rows at most
    place = F.row_number().over(Window.orderBy(*order))
    return top.withColumns({"_place": place, "has_more": F.count(F.lit(1)).over(Window.partitionBy()) > limit}).filter(F.col("_place") <= limit).drop("_place")


def day_bounds(ms: Column, first: date | None, last: date | None, zone: str) -> list[Column]:
    """Tests that a time lies from the start of one day to the end of another, as clocks in ``zone`` show them; undated rows fail any bound."""
    day = F.to_date(F.from_utc_timestamp(F.timestamp_millis(ms), zone))
    return [is_true(day >= F.lit(first))] * (first is not None) + [is_true(day <= F.lit(last))] * (last is not None)


def payment_tests(
    df: DataFrame, text: str | None = None, equal: Mapping[str, str] | None = None, same: Mapping[str, str] | None = None, part: Mapping[str, str] | None = None, anywhere: tuple[Sequence[str], str] | None = None,
    either: tuple[Sequence[str], str] | None = None, first: date | None = None, last: date | None = None, zone: str = "UTC", least: int | None = None, most: int | None = None,
) -> Column:
    """All criteria of the payment lists as one test.

    ``text`` in the JSON of the row, names of columns included; ``equal``: equal in either case; ``same``: exactly equal; ``part``: contained, case told apart; ``anywhere``: (columns, text) contained in any of
    them, in either case; ``either``: (columns, value) exactly one of them; days in ``zone``; amounts in paise.  A criterion on a null value fails.
    """
    tests = [F.lit(True)]
    if text and text.strip():
        tests.append(is_true(F.lower(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).contains(text.lower().strip())))
    tests += [is_true(F.upper(F.col(c)) == v.upper()) for c, v in (equal or {}).items() if v]
    tests += [is_true(F.col(c) == v) for c, v in (same or {}).items() if v]
    tests += [is_true(F.col(c).contains(v)) for c, v in (part or {}).items() if v]
    if anywhere and anywhere[1]:
        tests.append(reduce(lambda a, b: a | b, [is_true(F.lower(F.col(c).cast("string")).contains(anywhere[1].lower())) for c in anywhere[0]]))
    if either and either[1]:
        tests.append(reduce(lambda a, b: a | b, [is_true(F.col(c) == either[1]) for c in either[0]]))
    tests += day_bounds(F.col("ms"), first, last, zone)
    tests += [is_true(F.col("paise") >= least)] if least is not None else []
    tests += [is_true(F.col("paise") <= most)] if most is not None else []
    return reduce(lambda a, b: a & b, tests)


#: Orders of a payment list by name; ``seq`` settles ties.
SORTS = {
    "date_desc": [F.desc_nulls_last, "ms"], "date_asc": [F.asc_nulls_first, "ms"], "amount_desc": [F.desc_nulls_last, "paise"], "amount_asc": [F.asc_nulls_last, "paise"], "counterparty": [F.asc_nulls_first, "party"],
}


def sort_payments(df: DataFrame, sort: str, seq: str, limit: int) -> DataFrame:
    """The first ``limit`` payments by date, amount (unknown last) or counterparty (letters in either case); an unknown order is by date, newest first."""
    way, column = SORTS.get(sort, SORTS["date_desc"])
    key = F.lower(F.coalesce(F.col(column).cast("string"), F.lit(""))) if column == "party" else F.col(column)
    return df.withColumn("_key", key).orderBy(way("_key"), seq).limit(limit).drop("_key")
