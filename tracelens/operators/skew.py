"""Group picks and lookups that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def pick_first(df: DataFrame, keys: Sequence[str], order: Column, columns: Sequence[str] | None = None) -> DataFrame:
    """The row with the smallest ``order`` per key.

    ``min_by`` is combined on the map side, so a hot key costs one row per task in the shuffle;
    a ``row_number`` window would sort the whole key in one task.  ``order`` must be unique per key.
    """
    columns = [c for c in (columns or df.columns) if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*columns), order).alias("_row"))
    return picked.select(*keys, *[F.col("_row").getField(c).alias(c) for c in columns])


def null_spread_join(facts: DataFrame, dim: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Equi-join to ``dim`` (unique on ``key``) in which null keys of ``facts`` take no part.

    A left join would hash all null keys to one task although they can match nothing, so they
    go round the join; hot keys are split by the adaptive planner.
    """
    joined = facts.filter(F.col(key).isNotNull()).join(dim, key, how)
    if how == "inner":
        return joined
    lone = facts.filter(F.col(key).isNull())
    return joined.unionByName(lone, allowMissingColumns=True)


def lookup_join(facts: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Left equi-join to ``dim`` (unique on ``key``) that deals rows with a null key out by their other values.

    A plain left join hashes all null keys to one task, although they can match nothing.  Here a second key, the hash of the first or for null that of the
    row, takes part in the dealing, so that chains of lookups read their input once; ``null_spread_join`` reads it twice for each link.  Hot keys are
    split by the adaptive planner.
    """
    plain = [f"`{n}`" for n, t in facts.dtypes if t in ("string", "int", "bigint", "boolean", "double", "date", "timestamp")]
    own = F.xxhash64(F.col(key).cast("string"))
    left = facts.withColumn("_deal", F.when(F.col(key).isNull(), F.xxhash64(*plain)).otherwise(own))
    return left.join(dim.withColumn("_deal", own), [key, "_deal"], "left").drop("_deal")


#: Rows up to which a dimension is broadcast. A larger one is joined by its key.
SMALL_DIM = 50_000


def dim_join(facts: DataFrame, dim: DataFrame, key: str, most: int = SMALL_DIM) -> DataFrame:
    """Left equi-join to a dimension (unique on ``key``): broadcast, so that the facts stay where they are, if it has no more than ``most`` rows, else by lookup.

    The size is counted before the plan is made, ``most`` + 1 rows of the dimension at most.
    """
    if dim.limit(most + 1).count() <= most:
        return facts.join(F.broadcast(dim), key, "left")
    return lookup_join(facts, dim, key)
