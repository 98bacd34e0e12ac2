"""Corpus pipeline: quality rules, near duplicates, personal data, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the runner writes it
as Parquet and reads it back as the next stage's ``docs``.  All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorage.llm.jaccard_join import jaccard_components
from anchorage.llm.mixing import mixed
from anchorage.llm.packing import pack_documents
from anchorage.llm.pii import masked
from anchorage.llm.repetition import keep_good
from anchorage.session import hand_small_batches, materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go.

    From here on the session hands Python small batches, since what a worker once took for large ones stays with it in later stages.
    """
    hand_small_batches(spark)
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones (sets of five words, similarity 0.8) stays: that of the least id.

    A row without id is in no group and stays.  Rows of one id are one document; of these
    the one whose values come first stays.
    """
    kept = materialize(jaccard_components(docs, k=5, percent=80).where("doc_id = component_id").groupBy("doc_id").count(), "llm", "kept")
    # what is kept grows with the documents: merge joins at every size, which share one shuffle of the texts
    once, again = (docs.join(kept.where(rows).select("doc_id").hint("merge"), "doc_id", "left_semi").select(*docs.columns)
                   for rows in ("count = 1", "count > 1"))
    again = again.groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return once.unionByName(again).unionByName(docs.where("doc_id is null"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal spans become marks; ``n_chars`` follows the text."""
    return masked(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their places in sequences."""
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("packing", packing),
]

#: The packing plan and the tokenizer are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "llm", name)
    return STAGES[-1][1](spark, docs, sf_dir)
