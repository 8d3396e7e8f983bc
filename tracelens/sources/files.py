"""Files as rows: listings with hashes, JSON documents under a size rule, and typed preference files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from tracelens.functions.values import safe_double, safe_long

#: Larger documents are listed but not read. Fixed value.
MOST_BYTES = 8 << 20
#: How a plain database file begins; a container without it is encrypted. Fixed values.
PLAIN_HEADER, CONTAINERS = b"SQLite format 3\x00", (".db", ".sqlite", ".sqlite3")
#: Image endings, and the folder of an app's own pictures. Fixed values.
IMAGES, ASSETS = (".png", ".jpg", ".jpeg", ".webp"), "Bundles"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of every file below ``path``; a reader that does not use the content does not read it.

    Spark's readers pass over empty files and over names that begin with a dot or an underscore: list those by another source of (path, length, content).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", "content")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """``.ext`` in lower case; ``(noext)`` without a dot after the first character of the name."""
    found = F.regexp_extract(file_name(path), r"(?s)[^.].*(\.[^.]*)\z", 1)
    return F.when(found != "", F.lower(found)).otherwise("(noext)")


def file_inventory(files: DataFrame, hashed: bool = True) -> DataFrame:
    """path, name, ext, size, sha256 and ``encrypted``: true of a database container whose header is not the plain one, null of other files.

    Hashes are taken where a file is read; ``hashed=False`` lists without reading.
    """
    ext = extension(F.col("path"))
    listed = files.select("path", file_name(F.col("path")).alias("name"), ext.alias("ext"), F.col("length").cast("long").alias("size"), *(["content"] if hashed else []))
    if not hashed:
        return listed
    plain = F.coalesce(F.substring("content", 1, len(PLAIN_HEADER)) == F.lit(PLAIN_HEADER), F.lit(False))
    encrypted = F.when(F.col("ext").isin(*CONTAINERS) & (F.col("size") > 0), ~plain)
    return listed.withColumns({"sha256": F.sha2("content", 256), "encrypted": encrypted}).drop("content")


def extension_counts(files: DataFrame) -> DataFrame:
    """Files and bytes by extension, from the listing alone."""
    return file_inventory(files, hashed=False).groupBy("ext").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


def read_json_docs(files: DataFrame, max_bytes: int = MOST_BYTES) -> DataFrame:
    """path, size, ``status`` and ``doc`` (VARIANT): what is within the size rule is parsed, the rest is listed unread.

    Status: ``parsed``, ``not json`` (begins with neither brace nor bracket), ``undecodable``, ``over size cap``.  The rule is on the listing's length, so that large files are
    never opened; a malformed byte becomes a replacement character.
    """
    small = files.filter(F.col("length") <= max_bytes)
    text = F.decode("content", "UTF-8")
    looks = text.rlike(r"(?U)^\s*[\[{]")
    doc = F.when(looks, F.try_parse_json(text))
    status = F.when(~F.coalesce(looks, F.lit(False)), "not json").when(doc.isNull(), "undecodable").otherwise("parsed")
    size = F.col("length").cast("long").alias("size")
    read = small.select("path", size, status.alias("status"), doc.alias("doc"))
    large = files.filter(F.col("length") > max_bytes).select("path", size, F.lit("over size cap").alias("status"), F.lit(None).cast("variant").alias("doc"))
    return read.unionByName(large)


def merged_docs(docs: DataFrame, folder: Column, kinds: dict[str, str], fields: dict[str, list[str]]) -> DataFrame:
    """One row for each folder, from the documents whose file name is in ``kinds`` (name -> kind): ``fields`` maps a result to ``kind:path`` places, first filled wins."""
    known = docs.withColumns({"folder": folder, "kind": F.element_at(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]), file_name(F.col("path")))}).filter("kind is not null")
    out = []
    for name, places in fields.items():
        # several places of one kind are tried in their order within the document
        tries = [F.struct(F.lit(k).alias("place"), F.col("path").alias("path"), F.when(F.col("kind") == kind, F.try_variant_get("doc", f"$.{at}", "string")).alias("value")) for k, (kind, at) in enumerate(p.split(":", 1) for p in places)]
        best = F.array_min(F.filter(F.array(*tries), lambda t: t["value"].isNotNull()))
        out.append(F.min(best)["value"].alias(name))
    return known.groupBy("folder").agg(*out)


def _pairs(fields: list[str]) -> ArrayType:
    return ArrayType(StructType([StructField(f, ArrayType(StringType()) if f == "string" else StringType()) for f in fields]))


#: The elements of a preference file: texts between tags, other values in an attribute, sets as nested texts.
_MAP = StructType([StructField("string", _pairs(["_name", "text"])), *[StructField(k, _pairs(["_name", "_value"])) for k in ("int", "long", "float", "boolean")], StructField("set", _pairs(["_name", "string"]))])


def read_prefs_xml(spark: SparkSession, path: str) -> DataFrame:
    """(file, key, value, value_type) of every entry of the preference files below ``path``.

    Values are text in the form of their type (whole numbers, true or false, sets as JSON lists); one that does not fit its type is null.  Each map of a
    file is a row, entries without a name are left out; a file is read by one task, so a writer of many maps should make many files.
    """
    maps = spark.read.format("xml").option("rowTag", "map").option("valueTag", "text").option("recursiveFileLookup", "true").schema(_MAP).load(path)
    rows = maps.select(F.col("_metadata.file_name").alias("file"), *_MAP.fieldNames())
    forms = {
        "string": lambda e: e["text"], "int": lambda e: safe_long(e["_value"]).cast("string"), "long": lambda e: safe_long(e["_value"]).cast("string"),
        "float": lambda e: safe_double(e["_value"]).cast("string"), "boolean": lambda e: (e["_value"] == "true").cast("string"), "set": lambda e: F.to_json(e["string"]),
    }
    entry = lambda kind, form: F.transform(F.coalesce(F.col(kind), F.array().cast(_MAP[kind].dataType)), lambda e: F.struct(e["_name"].alias("key"), form(e).alias("value"), F.lit(kind).alias("value_type")))
    entries = rows.select("file", F.explode(F.concat(*[entry(k, f) for k, f in forms.items()])).alias("e"))
    return entries.select("file", "e.*").filter("key is not null")


def prefs_table(entries: DataFrame) -> DataFrame:
    """One row for each file and key with its number of entries: of a repeated key the least type and value holds, whatever the order of rows."""
    best = F.min(F.struct("value_type", F.coalesce("value", F.lit("")).alias("sure"), "value"))
    return entries.groupBy("file", "key").agg(best.alias("e"), F.count(F.lit(1)).alias("n_entries")).select("file", "key", "e.value", "e.value_type", "n_entries")


def media_rows(files: DataFrame, codes: DataFrame) -> DataFrame:
    """Pictures of the listing, told apart as the app's own and the user's, and the owner's payment codes (filename, qr_payload) beside them."""
    listed = file_inventory(files, hashed=False).filter(F.col("ext").isin(*IMAGES))
    kind = F.when(F.col("path").contains(ASSETS), "asset").otherwise("media")
    pictures = listed.select(F.col("path").alias("name"), "size", kind.alias("kind"), F.lit(None).cast("string").alias("qr_payload"))
    return pictures.unionByName(codes.select(F.col("filename").alias("name"), F.lit(0).cast("long").alias("size"), F.lit("code").alias("kind"), "qr_payload"))
