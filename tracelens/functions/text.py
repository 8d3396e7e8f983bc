"""Cell guards, previews, URL parts and stable keys for nested values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import AtomicType, ArrayType, StringType, StructField, VariantType


def guard_cell(c: Column) -> Column:
    """Neutralise spreadsheet formulas; plain signed numbers stay as they are."""
    risky = c.rlike(r"^[=+\-@\t\r]") & ~c.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$")
    return F.when(risky, F.concat(F.lit("'"), c)).otherwise(c)


def preview(c: Column, chars: int = 300) -> Column:
    return F.substring(c, 1, chars)


def host(c: Column) -> Column:
    return F.try_parse_url(c, F.lit("HOST"))


def looks_like_json(c: Column) -> Column:
    return F.coalesce(F.ltrim(c).rlike(r"^[\[{]"), F.lit(False))


def as_text(field: StructField, nested_as_json: bool = True) -> Column:
    """A column as text; nested values as JSON."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, StringType):
        return c
    if isinstance(field.dataType, VariantType) or (nested_as_json and not isinstance(field.dataType, AtomicType)):
        return F.to_json(c)
    return c.cast("string")


def group_key(df: DataFrame, name: str) -> Column:
    """A value usable as a grouping key: nested values by their JSON text."""
    return as_text(df.schema[name]) if not isinstance(df.schema[name].dataType, AtomicType) else F.col(f"`{name}`")


def row_text(df: DataFrame, columns: list[str] | None = None) -> Column:
    """All listed columns as one lower-case text (nulls skipped)."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    return F.lower(F.concat_ws(" ", *[as_text(f) for f in fields]))


def cell(field: StructField) -> Column:
    """Export form of a column: timestamp structs as ISO, arrays joined, other nested values as JSON."""
    c = F.col(f"`{field.name}`")
    kind = field.dataType
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, AtomicType):
        return F.array_join(c.cast("array<string>"), "; ")
    if kind.typeName() == "struct" and "epoch_ms" in kind.fieldNames():
        from tracelens.functions.time import iso

        return iso(c["epoch_ms"])
    if kind.typeName() == "timestamp":
        from tracelens.functions.time import iso

        return iso(F.unix_millis(c))
    return as_text(field)
