"""URL filters: host-suffix and path-prefix expressions, joined by short hash prefixes and confirmed by full digests.

Each distinct URL is expanded into every suffix of its host (at the dots) with every prefix of its path that is as
long as some rule's path.  The first eight hex digits of an expression's SHA-256 are joined with those
of the rules; the full digest confirms a match, and the longest confirmed rule wins.  All of it is built-in functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Hex digits of the hash prefix that is joined.
PREFIX = 8


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://`` or for null."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def rule_table(documents: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rules (verdict, host, path) as a table in the session of ``documents``."""
    return documents.sparkSession.createDataFrame(list(rules), "verdict string, host string, path string")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """``pages`` with _host, _path, _rule (host and path joined, else null) and _verdict.

    A rule (verdict, host, path) fits its host and all subdomains where the URL's path starts with its path.  The longest
    fitting rule wins, host and path together; among equal rules "allow" goes before "block".  Rules with a null
    host or path fit nothing.  Null URLs and those without ``://`` have an empty host, no rule and the default verdict.
    All rows come back, repeated ones as often as they came, with all their columns.
    """
    usable = rules.filter("host is not null and path is not null and host <> ''").select(
        F.concat("host", "path").alias("rule"), F.length("path").alias("size"), "verdict", _digest(F.concat("host", F.lit("\n"), "path")).alias("digest")
    )
    # a rule named twice is one row, so that a match never multiplies
    known = usable.groupBy("digest", "rule", "size").agg(F.min("verdict").alias("verdict")).withColumn("short", F.substring("digest", 1, PREFIX))
    sizes = known.agg(F.array_sort(F.collect_set("size")).alias("sizes"))  # lengths of rule paths: a handful
    urls = pages.filter(F.col(url).contains("://")).groupBy(F.col(url).alias("_url")).agg(F.lit(1).alias("_one")).drop("_one")
    lengths = F.lit(sizes.first()["sizes"] or []).cast("array<int>")
    parts = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    expressions = (
        urls.withColumns({"host": url_host(F.col("_url")), "path": url_path(F.col("_url"))})
        .select("_url", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes")).filter("suffix <> ''")
        .select("_url", "suffix", F.explode("prefixes").alias("prefix"))
        .select("_url", _digest(F.concat("suffix", F.lit("\n"), "prefix")).alias("full"))
        .withColumn("short", F.substring("full", 1, PREFIX))
    )
    fitting = expressions.join(known, "short").filter("full = digest")
    best = fitting.groupBy("_url").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), "rule")).alias("_best"))
    judged = pages.withColumn("_url", F.col(url)).filter(F.col(url).isNotNull()).join(best, "_url", "left").drop("_url")
    rest = pages.filter(F.col(url).isNull()).withColumn("_best", F.lit(None).cast(best.schema["_best"].dataType))
    return judged.unionByName(rest).withColumns(
        {"_host": url_host(F.col(url)), "_path": url_path(F.col(url)), "_rule": F.col("_best.rule"), "_verdict": F.coalesce("_best.verdict", F.lit(default))}
    ).drop("_best")
