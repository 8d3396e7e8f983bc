"""Session settings and durable lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split skewed join partitions even when a later operator then needs a shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # of a repeated key in a JSON payload the last value holds; by default the whole payload would be lost
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings every job relies on (no cluster sizing)."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(app: str = "tracelens", cores: str = "8", partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


_own_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir`` as the cluster names it.

    Only a session whose executors are threads of this process (``local[n]``) may do without
    the setting: on a cluster a machine-local path is lost together with the machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if context.applicationId not in _own_folders:
        _own_folders[context.applicationId] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _own_folders[context.applicationId]


def fresh_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing has written to."""
    return f"{shared_dir(spark).rstrip('/')}/tracelens/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The written table cuts the lineage, survives lost executors, keeps column pruning for its
    readers and gives the optimizer real sizes, so small results are broadcast on their own.
    """
    spark = df.sparkSession
    path = fresh_path(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
