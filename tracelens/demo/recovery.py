"""Queries of recovered rows over the given tables: lineitem rows read back in part, against those that are still live."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelens.demo.adapter import table
from tracelens.demo.queries import register
from tracelens.operators import recovered as rec

_COLUMNS = ("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_returnflag")
#: Rows of line 2 and 4, and of one supplier in seven, are gone from the live table. Of the recovered ones a third is whole, a third lacks its tail or its head; two in nine orders are read twice.
_X = """x AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, copy) AS seq, l_orderkey % 9 AS kind, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE l_extendedprice END AS l_extendedprice, l_returnflag
    FROM lineitem, (SELECT unnest([0, 1]) AS copy) WHERE copy = 0 OR l_orderkey % 9 < 2),
  live AS (SELECT l_partkey, l_suppkey, l_linenumber, CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE l_extendedprice END AS l_extendedprice, l_returnflag FROM lineitem WHERE l_linenumber NOT IN (2, 4) AND l_suppkey % 7 <> 0),
  r AS (SELECT *, CASE WHEN kind IN (3, 4) THEN 2 WHEN kind = 5 THEN 3 END AS reliable, CASE WHEN kind = 6 THEN 1 WHEN kind IN (7, 8) THEN 3 ELSE 0 END AS lost FROM x),
  f AS (SELECT *, CASE WHEN lost = 0 THEN l_partkey END AS a, CASE WHEN lost <= 1 AND coalesce(reliable, 9) >= 2 THEN l_suppkey END AS b, CASE WHEN lost <= 2 AND coalesce(reliable, 9) >= 3 THEN l_linenumber END AS c,
    CASE WHEN coalesce(reliable, 9) >= 4 THEN l_extendedprice END AS d, CASE WHEN coalesce(reliable, 9) >= 5 THEN l_returnflag END AS e FROM r),
  left_over AS (SELECT * FROM f WHERE NOT (
    lost = 0 AND reliable IS NULL AND EXISTS (SELECT 1 FROM live v WHERE v.l_partkey = f.l_partkey AND v.l_suppkey = f.l_suppkey AND v.l_linenumber = f.l_linenumber AND v.l_extendedprice IS NOT DISTINCT FROM f.l_extendedprice AND v.l_returnflag = f.l_returnflag)
    OR coalesce(reliable, 0) = 2 AND EXISTS (SELECT 1 FROM live v WHERE v.l_partkey = f.l_partkey AND v.l_suppkey = f.l_suppkey)
    OR coalesce(reliable, 0) = 3 AND EXISTS (SELECT 1 FROM live v WHERE v.l_partkey = f.l_partkey AND v.l_suppkey = f.l_suppkey AND v.l_linenumber = f.l_linenumber)
    OR lost = 1 AND EXISTS (SELECT 1 FROM live v WHERE v.l_suppkey = f.l_suppkey AND v.l_linenumber = f.l_linenumber AND v.l_extendedprice IS NOT DISTINCT FROM f.l_extendedprice AND v.l_returnflag = f.l_returnflag)
    OR lost = 3 AND EXISTS (SELECT 1 FROM live v WHERE v.l_extendedprice IS NOT DISTINCT FROM f.l_extendedprice AND v.l_returnflag = f.l_returnflag))),
  k AS (SELECT * FROM left_over QUALIFY row_number() OVER (PARTITION BY coalesce(reliable, 5) - lost, a, b, c, d, e ORDER BY seq) = 1)"""


def _rows(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    price = F.when(F.col("l_orderkey") % 10 != 0, F.col("l_extendedprice"))
    shown = items.withColumn("l_extendedprice", price)
    values = rec.comparable(shown, _COLUMNS).alias("values")
    live = shown.filter("l_linenumber not in (2, 4) and l_suppkey % 7 <> 0").select(F.lit("lineitem").alias("table"), values)
    kind = F.col("l_orderkey") % 9
    copies = F.explode(F.when(kind < 2, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    tables = F.when(F.col("l_linenumber") % 5 == 4, F.array(F.lit("lineitem"), F.lit("orders"))).otherwise(F.array(F.lit("lineitem")))
    read = shown.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", values, kind.alias("kind"), tables.alias("tables"), copies)
    seq = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "copy")
    kind = F.col("kind")
    found = read.select(
        seq.alias("seq"), "tables", "values", F.when(kind.isin(3, 4), 2).when(kind == 5, 3).alias("reliable"), F.when(kind == 6, 1).when(kind.isin(7, 8), 3).otherwise(0).alias("lost"),
        (kind == 6).alias("anchored"),
    )
    return found, live


@register(f"WITH {_X} SELECT seq, reliable, lost FROM k")
def recovered_rows(spark, sf_dir):
    return rec.not_live(*_rows(spark, sf_dir)).select("seq", "reliable", "lost")


#: The domain of line numbers that live rows show has no 2 and no 4.
_GRADED = f"""WITH {_X}, g AS (SELECT seq, CASE WHEN l_linenumber % 5 <> 4 THEN 'lineitem' END AS "table", CASE WHEN lost = 0 OR kind = 6 THEN 'high' ELSE 'medium' END AS extent,
    CASE WHEN l_linenumber IN (2, 4) THEN 'low' WHEN lost > 0 THEN 'inferred' ELSE 'high' END AS trust, l_linenumber % 5 = 4 AS ambiguous FROM k)"""


def _graded(spark, sf_dir):
    found, live = _rows(spark, sf_dir)
    number = F.substring(F.col("values")[2], 2, 40).cast("long")
    domain = live.agg(F.array_sort(F.collect_set(F.when(F.abs(number) <= 16, number))).alias("domain"))
    domains = domain.select(F.lit("lineitem").alias("table"), F.lit("l_linenumber").alias("column"), "domain")
    # one table's columns are the same for every row, so they need not travel with the rows
    left = rec.not_live(found, live).withColumn("columns", F.array(*map(F.lit, _COLUMNS)))
    return rec.graded(rec.out_of_domain(left, domains))


@register(f"{_GRADED} SELECT * FROM g")
def recovered_confidence(spark, sf_dir):
    return _graded(spark, sf_dir).select("seq", "table", "extent", "trust", "ambiguous")


@register(f'{_GRADED} SELECT "table", extent, trust, count(*) AS n, count(*) FILTER (ambiguous) AS n_ambiguous FROM g GROUP BY 1, 2, 3')
def recovered_summary(spark, sf_dir):
    return rec.recovered_summary(_graded(spark, sf_dir))


@register(f"""WITH {_X} SELECT seq, 'lineitem' || CASE WHEN l_linenumber % 5 = 4 THEN '; orders' ELSE '' END AS candidate_tables,
    '{{"l_partkey":"' || l_partkey || '","l_suppkey":"' || l_suppkey || '","l_linenumber":"' || l_linenumber || '","l_returnflag":"' || l_returnflag || '"}}' AS row_json, CASE WHEN l_linenumber IN (2, 4) THEN 'l_linenumber' ELSE '' END AS implausible
  FROM k""")
def recovered_export(spark, sf_dir):
    four = F.filter("columns", lambda c: c != "l_extendedprice")
    kept = _graded(spark, sf_dir).withColumns({"values": F.filter("values", lambda v, i: i != 3), "columns": four})
    return rec.packed(kept).select("seq", "candidate_tables", "row_json", "implausible")


@register(f"WITH {_X} SELECT seq, l_returnflag FROM k WHERE l_linenumber % 5 = 4 AND (contains(CAST(l_partkey AS VARCHAR), '77') OR contains(CAST(l_suppkey AS VARCHAR), '77') OR contains(CAST(l_linenumber AS VARCHAR), '77') OR l_extendedprice IS NOT NULL AND contains(CAST(l_extendedprice AS VARCHAR), '77'))")
def recovered_view(spark, sf_dir):
    found = rec.recovered_view(rec.not_live(*_rows(spark, sf_dir)), "orders", "77")
    return found.select("seq", F.substring(F.col("values")[4], 2, 9).alias("l_returnflag"))
