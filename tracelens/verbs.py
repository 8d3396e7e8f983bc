"""Hunting verbs: composable filters, rankings and statistics over any table.

Predicates are two-valued (null is false), comparisons coerce numbers and text, and every ordering ends with
an explicit sequence column, so results do not depend on how rows are partitioned.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracelens.functions.text import as_text
from tracelens.functions.values import is_true, safe_double
from tracelens.operators.skew import pick_first

MOST_PATTERN = 200


def _text(c: Column) -> Column:
    return c.cast("string")


def eq(c: Column, value: object) -> Column:
    """Equal as numbers where both are numbers, else as text; null equals only null."""
    if value is None:
        return c.isNull()
    number, given = safe_double(c), safe_double(F.lit(str(value)))
    return is_true(F.when(number.isNotNull() & given.isNotNull(), number == given).otherwise(_text(c) == F.lit(str(value))))


def ne(c: Column, value: object) -> Column:
    return ~eq(c, value)


def compare(c: Column, op: str, value: object) -> Column:
    """``<``, ``<=``, ``>`` or ``>=``: numbers with numbers, text with text; null or a mix is false."""
    ops = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
    number, given = safe_double(c), safe_double(F.lit(str(value)))
    return is_true(F.when(given.isNotNull(), ops[op](number, given)).when(number.isNull(), ops[op](_text(c), F.lit(str(value)))))


def like(c: Column, glob: str) -> Column:
    """Whole-value match of a glob (``*``, ``?``, ``[...]``), in either case."""
    parts, i = [], 0
    while i < len(glob):
        ch, end = glob[i], glob.find("]", i + 2)
        if ch == "[" and end > 0:
            inside = glob[i + 1 : end]
            inside = "^" + inside[1:] if inside.startswith("!") else inside
            parts.append("[" + inside.replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&") + "]")
            i = end
        else:
            parts.append({"*": ".*", "?": "."}.get(ch, re.sub(r"([\\.^$|()\[\]{}+*?-])", r"\\\1", ch)))
        i += 1
    return is_true(_text(c).rlike("(?isu)^" + "".join(parts) + "\\z"))


def _java_pattern(pattern: str) -> str | None:
    """The pattern as Spark's engine writes it, or None if it is not valid in both dialects."""
    try:
        re.compile(pattern)
    except re.error:
        return None
    # names of groups, references to them, and the end of the text are written differently
    java = re.sub(r"(?<!\\)((?:\\\\)*)\(\?P<", r"\1(?<", pattern)
    java = re.sub(r"(?<!\\)((?:\\\\)*)\(\?P=(\w+)\)", r"\1\\k<\2>", java)
    java = re.sub(r"(?<!\\)((?:\\\\)*)\\Z", r"\1\\z", java)
    try:
        SparkSession.active()._jvm.java.util.regex.Pattern.compile(java)
    except (IllegalArgumentException, Py4JJavaError):
        return None
    return java


def matches(c: Column, pattern: str) -> Column:
    """Regular-expression search in either case; an overlong pattern, and one that is not valid both in Python and in Spark's engine, matches nothing."""
    java = _java_pattern(pattern) if len(pattern) <= MOST_PATTERN else None
    return F.lit(False) if java is None else is_true(_text(c).rlike(f"(?i){java}"))


def contains(c: Column, value: str) -> Column:
    return is_true(F.lower(_text(c)).contains(value.lower()))


def startswith(c: Column, value: str) -> Column:
    return is_true(F.lower(_text(c)).startswith(value.lower()))


def endswith(c: Column, value: str) -> Column:
    return is_true(F.lower(_text(c)).endswith(value.lower()))


def is_in(c: Column, values: Sequence[object]) -> Column:
    """Exact membership; None in the list stands for null."""
    known = [v for v in values if v is not None]
    return is_true(c.isin(*known)) | (c.isNull() if None in values else F.lit(False))


def where(df: DataFrame, predicate: Column) -> DataFrame:
    return df.filter(is_true(predicate))


def search(df: DataFrame, term: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows in which any column contains the term, nested values as their JSON text."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    found = [is_true(F.lower(as_text(f)).contains(term.lower())) for f in fields]
    return df.filter(F.exists(F.array(*found), lambda x: x)) if found else df.limit(0)


def search_all(tables: Mapping[str, DataFrame], term: str) -> DataFrame:
    """The matching rows of every table, tagged ``_index``."""
    out = None
    for name, df in tables.items():
        part = search(df, term).withColumn("_index", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no table to search")
    return out


def order(field: str, seq: str, desc: bool = False) -> list[Column]:
    """Nulls last both ways; numbers before text ascending, after it descending; ties by ``seq``."""
    c = F.col(field)
    number, text = safe_double(c), _text(c)
    if desc:
        return [c.isNull().asc(), number.isNull().desc(), number.desc_nulls_last(), text.desc_nulls_last(), F.col(seq).asc()]
    return [c.isNull().asc(), number.isNull().asc(), number.asc_nulls_last(), text.asc_nulls_last(), F.col(seq).asc()]


def sort(df: DataFrame, field: str, seq: str, desc: bool = False) -> DataFrame:
    return df.orderBy(*order(field, seq, desc))


def head(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n)


def tail(df: DataFrame, n: int, seq: str) -> DataFrame:
    """The last n rows by ``seq``, in their order."""
    return df.orderBy(F.col(seq).desc()).limit(n).orderBy(seq)


def _value_counts(df: DataFrame, field: str, seq: str) -> DataFrame:
    return df.filter(F.col(field).isNotNull()).groupBy(field).agg(F.count(F.lit(1)).alias("count"), F.min(seq).alias("_first"))


def top(df: DataFrame, n: int, field: str, seq: str) -> DataFrame:
    """The n most frequent values, ties by first appearance."""
    return _value_counts(df, field, seq).orderBy(F.col("count").desc(), "_first").limit(n).drop("_first")


def rare(df: DataFrame, n: int, field: str, seq: str) -> DataFrame:
    """The n least frequent values, listed by descending count."""
    least = _value_counts(df, field, seq).orderBy("count", F.col("_first").desc()).limit(n)
    return least.orderBy(F.col("count").desc(), "_first").drop("_first")


def aggregate(fn: str, field: str | None = None) -> Column:
    """``count`` or fn(field) over the numbers of a field: sum (2 decimals), avg (4), min, max, distinct_count; null without a number."""
    if fn == "count":
        return F.count(F.lit(1)).alias("count")
    number = safe_double(F.col(field))
    some = F.count(number) > 0
    value = {
        "sum": lambda: F.round(F.sum(number), 2), "avg": lambda: F.round(F.avg(number), 4), "min": lambda: F.min(number),
        "max": lambda: F.max(number), "distinct_count": lambda: F.count_distinct(number),
    }[fn]()
    return F.when(some, value).alias(f"{fn}({field})")


def stats(df: DataFrame, fn: str, field: str | None = None, by: str | None = None) -> DataFrame:
    """One row, or one for each value of ``by`` (null is a value), largest first and nulls last."""
    value = aggregate(fn, field)
    if by is None:
        return df.agg(value)
    name = "count" if fn == "count" else f"{fn}({field})"
    return df.groupBy(by).agg(value).orderBy(F.col(f"`{name}`").desc_nulls_last(), F.col(by).asc_nulls_last())


def dedup(df: DataFrame, field: str, seq: str) -> DataFrame:
    """The first row by ``seq`` of each value, null among the values."""
    return pick_first(df, [field], F.col(seq)).select(*df.columns)


def table(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The named fields; one that is absent is null."""
    return df.select(*[F.col(f) if f in df.columns else F.lit(None).cast("string").alias(f) for f in fields])


def rename(df: DataFrame, old: str, new: str) -> DataFrame:
    """``old`` under the name ``new``, in place of a column that had it; without ``old`` nothing changes."""
    if old not in df.columns or old == new:
        return df
    return df.drop(new).withColumnRenamed(old, new)
