"""A corpus from raw documents to packed sequences, in five stages that each write their result before the next reads it.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of ``documents``. A row is judged by its own
text: null and empty texts fail the rules' least number of words, rows that repeat an id or have none are rows of their
own, and empty tables give empty results. Further columns stay as they are until packing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import op2, op4, op7, op8, op9
from loomspark.llm.common import remove, shared_dir, table

#: Stages use a learnt classifier, graph components and a tokenizer, which SQL does not express.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model rejects go."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return op8.accepted(docs, op8.fit(docs, labels), 0.3)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a base rule or a risk-controlled cutoff rejects go."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return op2.passing(docs, labels)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: sets of five-word shingles with a Jaccard similarity of 0.8 or more."""
    return op7.keep_one(docs, words=5, similarity=(4, 5))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data give way to their kind in brackets."""
    clean = op9.redact(docs)
    return clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.coalesce(F.length("text").cast("long"), F.col("n_chars")))) if "n_chars" in docs.columns else clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece with its place in a sequence of at most 4096 tokens.

    By now the executors' heaps are as large as they get, so workers remember fewer ids than in the operator alone."""
    import public_tokenizers

    return op4.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), most=50_000)


STAGES = [("quality_classifier", quality_classifier), ("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in a row; each result is written as Parquet in the shared folder and read again, and goes once the next is written."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for number, (name, stage) in enumerate(STAGES):
        own = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(own)
        docs = spark.read.parquet(own)
        if before:
            remove(spark, before)
        before = own
    return docs


def queries() -> dict:
    return {"pipeline": run}
