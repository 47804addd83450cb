"""From raw documents to packed training sequences.

Stages, each on all that the one before kept: the quality classifier rejects documents,
line deduplication takes repeated lines out of texts, near-copy removal leaves one document of
each group, and best-fit packing cuts and packs what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe.llm.line_dedup import without_similar_lines
from spanframe.llm.packing import pack_documents
from spanframe.llm.quality import learn, with_scores
from spanframe.llm.simhash import without_simhash_copies
from spanframe.session import scratch_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it is fitted on the labelled ones among them."""
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return with_scores(docs, model).filter("_predicted = 1").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that near-repeat an earlier one; n_chars follows the text."""
    out = without_similar_lines(docs).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: fingerprints of five-word shingles that link at four or fewer bits."""
    return without_simhash_copies(docs, words=5)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents left."""
    return pack_documents(docs)


STAGES = [
    ("quality_classifier", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("best_fit_packing", pack_sequences),
]

#: SQL has no SimHash of the kind and no byte-level BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
