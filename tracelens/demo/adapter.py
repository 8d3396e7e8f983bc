"""The given tables as payments, ledger rows, cards, messages and dated sources; every row of a table is used."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracelens.functions.time import epoch_ms
from tracelens.session import tune


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, party, paise, state, direction, type, ms from ``orders``."""
    o = table(spark, sf_dir, "orders")
    state = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "PENDING").when(F.col("o_orderstatus") == "P", "FAILED")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("party"), F.round(F.col("o_totalprice") * 100).cast("long").alias("paise"),
        state.alias("state"), F.when(F.col("o_orderkey") % 2 == 0, "OUT").otherwise("IN").alias("direction"),
        F.col("o_orderpriority").alias("type"), epoch_ms(F.col("o_orderdate")).alias("ms"),
    )


def ledger_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows with aliases from ``lineitem``: group, row, kind, paise, ms."""
    li = table(spark, sf_dir, "lineitem")
    row = F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return li.select(
        F.col("l_orderkey").alias("grp"), row.alias("tie"), F.col("l_partkey").alias("row"), F.col("l_returnflag").alias("kind"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("paise"), epoch_ms(F.col("l_shipdate")).alias("ms"),
    )


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards from ``events``: two candidate ids, some of which no order has."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("card"), (F.col("event_id") * 3).alias("first_id"), (F.col("event_id") * 3 + 1).alias("second_id"),
        F.round(F.col("value") * 100).cast("long").alias("paise"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages from ``conversations``: party is the conversation."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("party"), "turn", "role", "text")
