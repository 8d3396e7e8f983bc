"""Ordered scans over a whole table: global row index and balanced neighbour windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracelens.session import materialise

_LOCAL_BITS = 33                      # monotonically_increasing_id keeps the row number in the low 33 bits
BUCKET = 1_000_000


def with_row_index(df: DataFrame, order: Sequence[str], name: str = "_g") -> DataFrame:
    """Zero-based position of each row in the total order ``order``.

    Range partitioning on the full (unique) order splits even one hot leading key over many
    tasks.  The per-partition counts are one row per partition, which bounds the broadcast.
    The written table pins the partition numbers before they are used twice.
    """
    laid_out = materialise(
        df.repartitionByRange(*[F.col(c) for c in order])
        .sortWithinPartitions(*order)
        .withColumn("_m", F.monotonically_increasing_id())
    )
    part = F.shiftright("_m", _LOCAL_BITS)
    local = F.col("_m").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    counts = laid_out.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (
        laid_out.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + local)
        .drop("_m", "_part", "_offset")
    )


def with_neighbours(df: DataFrame, neighbours: dict[str, tuple[str, int]], index: str = "_g", bucket: int = BUCKET) -> DataFrame:
    """Add columns of rows a fixed distance away: ``{new: (column, distance)}``.

    Buckets are equal ranges of the row index, so window groups are balanced whatever the keys
    are.  Rows near a border are copied to the neighbour bucket as context and dropped afterwards.
    """
    reach = max(abs(d) for _, d in neighbours.values())
    home = F.floor(F.col(index) / bucket)
    edges = F.array_distinct(
        F.array(F.floor((F.col(index) - reach) / bucket), home, F.floor((F.col(index) + reach) / bucket))
    )
    copied = df.withColumn("_bucket", F.explode(edges))
    window = Window.partitionBy("_bucket").orderBy(index)
    out = copied.select(
        "*",
        *[
            (F.lead(c, d) if d > 0 else F.lag(c, -d)).over(window).alias(name)
            for name, (c, d) in neighbours.items()
        ],
    )
    return out.filter(F.col("_bucket") == home).drop("_bucket")


def running_last(df: DataFrame, values: dict[str, Column], index: str = "_g", backwards: bool = False, bucket: int = BUCKET) -> DataFrame:
    """Add, per name, the last non-null value at or before each row (after it, if ``backwards``).

    Values must grow along the scan (lead a struct with the row index).  Each bucket contributes
    one row to the carry table, so that table has rows / bucket size rows.
    """
    step = -F.col(index) if backwards else F.col(index)
    names = list(values)
    tagged = df.withColumns({f"_v_{n}": v for n, v in values.items()}).withColumns(
        {"_step": step, "_bucket": F.floor(step / bucket)}
    )
    tops = tagged.groupBy("_bucket").agg(*[F.max(f"_v_{n}").alias(f"_top_{n}") for n in names])
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = tops.select("_bucket", *[F.max(f"_top_{n}").over(before).alias(f"_carry_{n}") for n in names])
    local = Window.partitionBy("_bucket").orderBy("_step").rowsBetween(Window.unboundedPreceding, 0)
    filled = tagged.join(carry, "_bucket").withColumns(
        {n: F.coalesce(F.max(f"_v_{n}").over(local), F.col(f"_carry_{n}")) for n in names}
    )
    return filled.drop("_step", "_bucket", *[f"_v_{n}" for n in names], *[f"_carry_{n}" for n in names])
