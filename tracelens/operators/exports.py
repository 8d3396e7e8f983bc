"""Exports that are whole or absent, and records of what they and their sources were."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from tracelens.operators.reports import export_rows
from tracelens.sources.files import file_inventory, file_name, read_files

#: Groups of files whose hashes are folded before they meet, by the first hex digits of the hash of the path.
FOLD_DIGITS = 2


def manifest_root(inventory: DataFrame) -> DataFrame:
    """One row (n_files, bytes, root): a hash over path and sha256 of every file, in the order of paths within groups and of groups.

    Files are folded to one hash for each group of paths first, so that neither a task nor a row holds the whole list.
    """
    line = F.concat_ws(":", "path", "sha256")
    group = F.left(F.sha2("path", 256), F.lit(FOLD_DIGITS)).alias("g")
    folded = inventory.groupBy(group).agg(
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", line.alias("l")))), lambda x: x["l"]), "\n"), 256).alias("h"),
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"),
    )
    hashes = F.transform(F.array_sort(F.collect_list(F.struct("g", "h"))), lambda x: x["h"])
    return folded.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_files"), F.coalesce(F.sum("b"), F.lit(0)).alias("bytes"), F.sha2(F.array_join(hashes, "\n"), 256).alias("root"))


def custody_record(inventory: DataFrame, health: DataFrame, about: Mapping[str, str]) -> DataFrame:
    """One row that makes an exhibit attributable: who and what it is about, the root hash of its sources, and what was wrong with them.

    ``health``: (source, detail, status, n) as ``reports.health`` gives it; its rows are as many as tables have gaps.  The list of single hashes stays a table of its own, ``inventory``.
    """
    bad = F.col("status") != "ok"
    warnings = F.array_sort(F.collect_list(F.when(bad, F.concat_ws(": ", "source", "status", "detail"))))
    told = health.agg(warnings.alias("warnings"), F.count_if(bad).alias("n_warnings"))
    row = manifest_root(inventory)
    return row.select(*[F.lit(v).alias(k) for k, v in about.items()], *row.columns, told.select("n_warnings").scalar().alias("n_warnings"), F.array_join(told.select("warnings").scalar(), "; ").alias("warnings"))


def write_export(df: DataFrame, path: str, columns: Sequence[str], scope: str, form: str = "csv") -> None:
    """Rows as guarded CSV or as JSON lines under ``path/data``, then ``path/files`` with their hashes, then ``path/manifest``, last.

    The manifest is one row with the scope, the number of rows, the columns and the root of the hashes; a job that ends before it leaves
    an export that ``read_export`` refuses.  A path that exists is never written over.
    """
    spark, seen = df.sparkSession, Observation()
    rows = (export_rows(df, columns) if form == "csv" else df.select(*columns)).observe(seen, F.count(F.lit(1)).alias("n"))
    if form == "csv":
        rows.write.option("header", True).option("escape", '"').option("emptyValue", '""').csv(f"{path}/data")
    else:
        rows.write.option("ignoreNullFields", False).json(f"{path}/data")
    listed = _listing(spark, path)
    listed.write.parquet(f"{path}/files")
    root = manifest_root(spark.read.parquet(f"{path}/files"))
    about = {"scope": scope, "form": form, "columns": ",".join(columns)}
    root.select(*[F.lit(v).alias(k) for k, v in about.items()], F.lit(int(seen.get["n"])).cast("long").alias("n_rows"), *root.columns).write.json(f"{path}/manifest")


def _listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256) of the data files by name."""
    return file_inventory(read_files(spark, f"{path}/data")).select(file_name(F.col("path")).alias("path"), "size", "sha256")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of a whole export; FileNotFoundError if it has none."""
    schema = "scope string, form string, columns string, n_rows long, n_files long, bytes long, root string"
    try:
        return spark.read.schema(schema).json(f"{path}/manifest")
    except AnalysisException as missing:
        raise FileNotFoundError(f"{path}: the export was not finished") from missing


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a whole export as text (CSV) or by their types (JSON); ValueError if its files are not those of the manifest."""
    about = read_manifest(spark, path).first()
    if manifest_root(_listing(spark, path)).first()["root"] != about["root"]:
        raise ValueError(f"{path}: the files differ from the manifest")
    names = about["columns"].split(",")
    if about["form"] == "csv":
        text = ", ".join(f"`{c}` string" for c in names)
        return spark.read.schema(text).option("header", True).option("escape", '"').option("emptyValue", "").csv(f"{path}/data")
    return spark.read.json(f"{path}/data")


def with_raw(rows: DataFrame, raw: DataFrame, key: str) -> DataFrame:
    """(summary, raw): each row beside the raw record with its id (key, provenance, decoded), null without one; ``raw`` has one row for each key."""
    told = raw.select(key, F.struct(*[c for c in raw.columns if c != key]).alias("raw"))
    return rows.select(key, F.struct(*rows.columns).alias("summary")).join(told, key, "left").select("summary", "raw")


def write_catalog(catalog: Mapping[str, tuple[DataFrame, Sequence[str]]], path: str, form: str = "csv") -> None:
    """Every table of the catalogue (name -> rows and fixed columns) as an export of its own below ``path``."""
    for name, (df, columns) in catalog.items():
        write_export(df, f"{path}/{name}", columns, "all", form)
