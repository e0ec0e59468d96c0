"""From raw documents to a mix: five stages, each written before the next reads it.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents.  Extra columns go through under their
names, whatever these are; an empty table stays empty through all stages; very
long texts are read whole; a null doc_id is an id like any other.  What each
stage does with nulls, ties and repeated rows is stated with it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from terragrain.llm.decontaminate import decontaminated
from terragrain.llm.line_dedup import deduplicated
from terragrain.llm.mixing import mix
from terragrain.llm.ngram_join import one_of_each
from terragrain.llm.quality_rules import passing
from terragrain.llm.session import checkpoint_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the robust outlier test accept.

    Null and empty texts have no ten words and go; rows that repeat get one
    verdict each; null languages and sources are groups of their own.
    """
    return passing(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later copies of repeated line runs.

    A null text stays null and an empty one empty; of equal runs the first by
    doc_id and place stays, so of repeated rows without an id one does.
    """
    return deduplicated(docs)


def ngram_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies.

    The least doc_id stays, a row key decides between rows of one id; rows of
    no word link with none and stay; of rows that repeat whole one stays.
    """
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item.

    Null and wordless texts leak nothing and stay, repeated rows go or stay
    together, and items that are null or wordless match nothing.
    """
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document that is left.

    Null texts have size 0, null sources are one source, and rows that repeat
    count each for themselves; ties of the seeded order go by doc_id and size.
    """
    return mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing", mixing),
]

#: SQL cannot express the robust estimates of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a table folder."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
