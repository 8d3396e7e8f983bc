"""Recovered records that are no longer live: comparison on the part that was decoded reliably, duplicates, and confidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tracelens.functions.values import is_true
from tracelens.operators.skew import pick_first

#: Leading bytes of a binary value that are compared, and decimals of a fraction. Fixed values.
BLOB_BYTES, DECIMALS = 64, 6


def comparable(df: DataFrame, columns: Sequence[str]) -> Column:
    """The columns as an array of text in which equal values, and only they, are equal: kinds are told apart, null is a value."""
    kinds = dict(df.dtypes)

    def one(c: str) -> Column:
        kind, v = kinds[c], F.col(c)
        if kind == "binary":
            text, mark = F.hex(F.substring(v, 1, BLOB_BYTES)), "b"
        elif kind in ("double", "float"):
            text, mark = (F.round(v.cast("double"), DECIMALS) + F.lit(0.0)).cast("string"), "n"  # + 0.0: a negative zero is zero
        elif kind in ("tinyint", "smallint", "int", "bigint") or kind.startswith("decimal"):
            text, mark = v.cast("string"), "i"
        else:
            text, mark = v.cast("string"), "t"
        return F.coalesce(F.concat(F.lit(mark), text), F.lit("0"))

    return F.array(*map(one, columns))


def _part(values: Column, side: Column, k: Column) -> Column:
    """What of the values counts: the first k of them, or for a damaged head all but the first k."""
    return F.when(side == "head", F.slice(values, 1, F.greatest(k, F.lit(0)))).otherwise(F.slice(values, k + 1, F.greatest(F.size(values) - k, F.lit(0))))


def _form(recovered: DataFrame) -> DataFrame:
    """``recovered`` with side, k and print: the values that are compared."""
    lost, whole = F.coalesce("lost", F.lit(0)), F.size("values")
    side = F.when(lost > 0, "tail").otherwise("head")
    k = F.when(lost > 0, lost).otherwise(F.least(F.coalesce("reliable", whole), whole))
    formed = recovered.withColumns({"side": side, "k": k})
    return formed.withColumn("print", _part(F.col("values"), F.col("side"), F.col("k")))


def _key(table: Column, side: Column, k: Column, values: Column) -> Column:
    """Table, side, width and compared values as one text in which only equal ones are equal: each value with its length before it; null without a table."""
    cells = F.transform(values, lambda v: F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("-")))
    return F.concat(F.array_join(cells, ""), side, k.cast("string"), F.lit(" "), table)


def _known(formed: DataFrame, live: DataFrame) -> DataFrame:
    """(key) of the live rows, each once, in just the widths that occur for their table, at most two for each column."""
    forms = formed.select(F.explode("tables").alias("table"), "side", "k").distinct()
    side, k = F.col("side"), F.col("k")
    return live.join(F.broadcast(forms), "table").select(_key(F.col("table"), side, k, _part(F.col("values"), side, k)).alias("key")).distinct()


def still_live(recovered: DataFrame, live: DataFrame) -> DataFrame:
    """(seq) of the recovered rows that some live row of one of their tables equals on the compared values.

    ``recovered``: (seq, tables, values, reliable, lost); an overflow row has only ``reliable`` leading values, a row with a damaged head lacks its first ``lost``.
    ``live``: (table, values).  The values themselves are joined, as one text, so that no collision can hide a row.
    """
    formed = _form(recovered)
    return _live_of(formed, _known(formed, live))


def _live_of(formed: DataFrame, known: DataFrame) -> DataFrame:
    asked = formed.select("seq", F.explode("tables").alias("table"), "side", "k", "print")
    return asked.select("seq", _key(F.col("table"), F.col("side"), F.col("k"), F.col("print")).alias("key")).join(known.hint("merge"), "key", "left_semi").select("seq").distinct()


def not_live(recovered: DataFrame, live: DataFrame) -> DataFrame:
    """The recovered rows that are not live, each set of compared values once, by the least seq; without values nothing is compared.

    Rows of one table go to the live keys themselves, as they come from their reader, so that no task sorts what it has not yet been dealt; hot keys are split by the
    adaptive planner. Only rows of several tables are told by their seq. Of equal rows the first is taken from what is left, which carries each value once.
    """
    formed = _form(recovered)
    known = _known(formed, live)
    several = F.coalesce(F.size("tables"), F.lit(0)) > 1
    own = _key(F.get("tables", F.lit(0)), F.col("side"), F.col("k"), F.col("print"))
    # what no live row can equal is dealt out by itself
    key = F.coalesce(own, F.concat(F.lit("no key "), F.col("seq").cast("string")))
    apart = formed.filter(~several).withColumn("key", key).join(known.hint("merge"), "key", "left_anti").select(*recovered.columns)
    shared = formed.filter(several)
    shared = shared.join(_live_of(shared, known).hint("merge"), "seq", "left_anti").select(*recovered.columns)
    left = _form(apart.unionByName(shared))
    head, k = F.col("side") == "head", F.greatest("k", F.lit(0))
    rest = F.when(head, F.slice("values", k + 1, F.size("values"))).otherwise(F.slice("values", 1, k))
    first = pick_first(left.withColumn("rest", rest), ["print"], F.col("seq"), ["side", "rest", *[c for c in recovered.columns if c != "values"]])
    return first.withColumn("values", F.when(head, F.concat("print", "rest")).otherwise(F.concat("rest", "print"))).select(*recovered.columns)


def out_of_domain(recovered: DataFrame, domains: DataFrame) -> DataFrame:
    """``recovered`` with ``implausible``: the columns whose whole number is not in the domain that live rows show for it.

    ``domains``: (table, column, domain) of enumerations, at most one row for each column; ``recovered`` has ``columns`` beside ``values`` (as ``comparable`` makes
    them) and one table or, when several fit, the first of them.  The domains are few and come as one value, so that the rows stay where they are.
    """
    by_column = domains.groupBy("table").agg(F.map_from_entries(F.collect_list(F.struct("column", "domain"))).alias("of"))
    known = by_column.agg(F.map_from_entries(F.collect_list(F.struct("table", "of")))).scalar()
    own = F.try_element_at(known, F.get("tables", F.lit(0)))

    def strange(cell: Column) -> Column:
        number = F.substring(cell["values"], 2, 40).try_cast("long")
        return cell["values"].startswith("i") & ~F.array_contains(F.try_element_at(F.col("_own"), cell["columns"]), number)

    cells = F.filter(F.arrays_zip("columns", "values"), strange)
    named = F.coalesce(F.transform(cells, lambda cell: cell["columns"]), F.array().cast("array<string>"))
    return recovered.withColumn("_own", own).withColumn("implausible", named).drop("_own")


def graded(recovered: DataFrame) -> DataFrame:
    """``extent`` (do we know where the record began and ended) and ``trust`` in its values, two separate claims.

    A damaged head that the next freed cell anchors has a sure extent, but its values are inferred; a value outside its column's
    domain makes the values doubtful whatever the extent.  ``ambiguous`` and ``table`` tell whether several tables fit.
    """
    lost = F.coalesce("lost", F.lit(0)) > 0
    extent = F.when(~lost | is_true(F.col("anchored")), "high").otherwise("medium")
    trust = F.when(F.size("implausible") > 0, "low").when(lost, "inferred").otherwise("high")
    several = F.size("tables") > 1
    return recovered.withColumns({"extent": extent, "trust": trust, "ambiguous": several, "table": F.when(~several, F.col("tables")[0])})


def packed(recovered: DataFrame) -> DataFrame:
    """Rows for an export: the values by column name as one JSON text, null where a value is; lists joined by ``; ``."""
    named = F.map_from_entries(F.transform(F.arrays_zip("columns", "values"), lambda x: F.struct(x["columns"].alias("k"), F.when(x["values"] != "0", F.substring(x["values"], F.lit(2), F.length(x["values"]))).alias("v"))))
    return recovered.withColumns({"row_json": F.to_json(named, {"ignoreNullFields": "false"}), "candidate_tables": F.array_join("tables", "; "), "implausible": F.array_join("implausible", "; ")}).drop("tables", "values", "columns")


def recovered_summary(recovered: DataFrame) -> DataFrame:
    """Recovered rows by table, extent and trust."""
    return recovered.groupBy("table", "extent", "trust").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ambiguous")).alias("n_ambiguous"))


def recovered_view(recovered: DataFrame, table: str | None = None, text: str | None = None) -> DataFrame:
    """Rows of a table or with it among their candidates, that hold the text in any value, in either case."""
    if table is not None:
        recovered = recovered.filter(F.array_contains("tables", table))
    if text:
        recovered = recovered.filter(F.exists("values", lambda v: F.lower(F.substring(v, F.lit(2), F.length(v))).contains(text.lower())))
    return recovered
