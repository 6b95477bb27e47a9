"""Corpus pipeline: documents through the operators of ``assay.llm``, stage by stage.

Each stage works on what its predecessor kept and returns the columns of ``documents``; the
last returns pieces of packed sequences.
"""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm import packing, partenum, pii, quality, toxicity
from assay.llm.common import prepare, table
from assay.session import checkpoint_dir


def restated(docs: DataFrame) -> DataFrame:
    """The length column follows the text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, and lines above their host's limit."""
    prepare(spark)
    return restated(quality.kept_documents(docs))


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the lexicon is learned from the labels."""
    prepare(spark)
    return toxicity.clean_documents(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays."""
    prepare(spark)
    return partenum.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and words that disclose it are replaced."""
    prepare(spark)
    return restated(pii.sanitise(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of the documents."""
    prepare(spark)
    return packing.packed_documents(docs)


STAGES = [("quality rules", quality_rules), ("toxicity", toxic_documents), ("n-gram Jaccard join", near_copies),
          ("PII", personal_data), ("packing", pack)]
# The stages learn from labels, search near copies and tokenize: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    prepare(spark)
    base = posixpath.join(checkpoint_dir(spark), f"pipeline-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = posixpath.join(base, str(i))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
