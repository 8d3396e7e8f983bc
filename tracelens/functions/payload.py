"""Decoded JSON payloads as VARIANT values, and legs that may be an object or a list."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tracelens.functions.values import filled


def decode_json(c: Column) -> Column:
    """VARIANT of a JSON object or list; other text stays itself, as a VARIANT string.

    Of a repeated key the last value holds (a setting of ``tracelens.session.tune``).
    """
    return F.coalesce(F.when(c.rlike(r"(?U)^\s*[\[{]"), F.try_parse_json(c)), c.cast("variant"))


def decode_b64_json(c: Column) -> Column:
    """VARIANT of base64 text whose padding was stripped; null on any failure."""
    raw = F.trim(c)
    padded = F.concat(raw, F.repeat(F.lit("="), F.pmod(-F.length(raw), F.lit(4))))
    return F.try_parse_json(F.try_to_binary(padded, F.lit("base64")).cast("string"))


def at(v: Column, path: str, as_type: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{path}", as_type)


def text_at(v: Column, *paths: str) -> Column:
    """First non-empty text among several paths."""
    return F.coalesce(*[filled(at(v, p)) for p in paths])


def kind_at(v: Column, path: str) -> Column:
    """The type at a path, as Spark names it (``STRING``, ``BIGINT``, ``OBJECT<...>``, ``VOID`` for a JSON null); null without the path."""
    return F.schema_of_variant(F.try_variant_get(v, f"$.{path}", "variant"))


def long_at(v: Column, path: str) -> Column:
    """Whole number at a path, also when stored as text; fractions of numbers are cut, booleans are not numbers."""
    text = F.trim(at(v, path))
    number = F.when(kind_at(v, path).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), at(v, path, "decimal(38,6)").try_cast("bigint"))
    return F.coalesce(F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint")), number)


class Leg:
    """One party leg of a payment; a list counts as its first element."""

    def __init__(self, payload: Column, name: str, only_object: bool = False):
        self.payload, self.name, self.only_object = payload, name, only_object

    def raw(self, field: str) -> Column:
        direct = at(self.payload, f"{self.name}.{field}")
        return direct if self.only_object else F.coalesce(at(self.payload, f"{self.name}[0].{field}"), direct)

    def text(self, *fields: str) -> Column:
        return F.coalesce(*[filled(self.raw(f)) for f in fields])

    def amount(self, field: str = "amount") -> Column:
        return F.coalesce(*[long_at(self.payload, p) for p in self._paths(field)])

    def is_true(self, field: str) -> Column:
        """The field is the boolean true, not the word."""
        return F.coalesce(*[at(self.payload, p) == "true" for p in self._paths(field)], F.lit(False)) & (self.kind(field) == "BOOLEAN")

    def kind(self, field: str) -> Column:
        return F.coalesce(*[kind_at(self.payload, p) for p in self._paths(field)], F.lit(""))

    def present(self) -> Column:
        """The leg, or the first element of its list, is an object with some field."""
        places = [self.name] if self.only_object else [f"{self.name}[0]", self.name]
        return F.coalesce(F.coalesce(*[kind_at(self.payload, p) for p in places]).rlike("^OBJECT<[^>]"), F.lit(False))

    def stated(self) -> Column:
        """Anything but an absent, null, empty, zero or false value stands there."""
        whole = at(self.payload, self.name)
        return F.coalesce(~whole.isin("", "{}", "[]", "0", "false"), F.lit(False))

    def _paths(self, field: str) -> list[str]:
        direct = f"{self.name}.{field}"
        return [direct] if self.only_object else [f"{self.name}[0].{field}", direct]


def flatten(json: Column, depth: int = 3) -> Column:
    """Dotted keys of a JSON object as an array of ``(key, value)``, nested objects to ``depth``.

    Only objects are opened: text that looks like JSON stays text, and lists stay lists in their JSON form.
    """
    def fields(v: Column) -> Column:
        return F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))

    def opened(e: Column) -> Column:
        inner = F.transform(fields(e["value"]), lambda i: F.struct(F.concat_ws(".", e["key"], i["key"]).alias("key"), i["value"].alias("value")))
        return F.when(F.schema_of_variant(e["value"]).rlike("^OBJECT<[^>]"), inner).otherwise(F.array(F.struct(e["key"].alias("key"), e["value"].alias("value"))))

    entries = fields(F.try_parse_json(json))
    for _ in range(depth - 1):
        entries = F.flatten(F.transform(entries, opened))
    return F.transform(entries, lambda e: F.struct(e["key"].alias("key"), F.try_variant_get(e["value"], "$", "string").alias("value")))


def provenance(source: str, table: str, row_key: Column, id_column: str, id_value: Column, payload: Column, route: str) -> Column:
    """Where a record came from, with the hash of its stored bytes."""
    return F.struct(
        F.lit(source).alias("source"),
        F.lit(table).alias("source_table"),
        row_key.cast("string").alias("row_key"),
        F.lit(id_column).alias("id_column"),
        id_value.cast("string").alias("id_value"),
        F.sha2(payload.cast("binary"), 256).alias("payload_sha256"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.lit(route).alias("decode_route"),
    )
