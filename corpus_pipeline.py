"""A corpus pipeline over ``documents``: each stage reads what its predecessor kept.

Toxic documents go; one document of each group of near copies stays; contaminated documents go; secrets are
replaced by their kinds; what is left is packed into training windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracelens.llm.decontaminate import contamination, hit_words, is_contaminated
from tracelens.llm.jaccard_join import bloom_filter, by_bloom, jaccard_classes
from tracelens.llm.packing import pack_documents
from tracelens.llm.queries import TOKENIZER, TOXIC_FROM, table, toxic_held_out
from tracelens.llm.secret_scan import fit_grammars, without_secrets
from tracelens.llm.toxicity import fit_toxicity, without_toxic
from tracelens.session import materialise


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; the model learns from the labelled rows of the input."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), toxic_held_out())
    return without_toxic(docs, model, TOXIC_FROM)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each class of linked texts, once; rows without doc_id stay."""
    classes = materialise(jaccard_classes(docs))
    first = materialise(classes.filter("component_id = doc_id").groupBy("doc_id").agg((F.count(F.lit(1)) > 1).alias("_again")))
    # most documents stay, once: only the others, and a few more, are dealt out for the join
    others = materialise(classes.filter("component_id <> doc_id").select("doc_id").unionByName(first.filter("_again").select("doc_id")))
    bloom = spark.sparkContext.broadcast(bloom_filter(others, others.count()))
    named = docs.filter("doc_id is not null")
    sure = named.mapInArrow(lambda b: by_bloom(b, bloom.value, False), docs.schema)
    kept = named.mapInArrow(lambda b: by_bloom(b, bloom.value, True), docs.schema).join(first, "doc_id").select(*docs.columns, "_again")
    repeated = kept.filter("_again").drop("_again").dropDuplicates(["doc_id", "text"])
    return sure.unionByName(kept.filter("not _again").drop("_again")).unionByName(repeated).unionByName(docs.filter("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth lie in windows of benchmark items."""
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.filter(~is_contaminated(hit_words(), F.col("_words"))).select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kinds; n_chars follows the text where it changed."""
    masked = without_secrets(docs.withColumn("_chars", F.length("text")), fit_grammars(docs))
    changed = F.length("text") - F.col("_chars")
    return masked.withColumn("n_chars", (F.col("n_chars") + F.coalesce(changed, F.lit(0))).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of every document in one piece of one sequence of at most 1024 tokens, with its ids."""
    return pack_documents(docs, TOKENIZER)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack_windows),
]

#: Learned models and token ids are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole of ``documents``, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs)
    return docs
