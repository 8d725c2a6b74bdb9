"""A corpus pipeline: quality, near copies, benchmark passages, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage
before it kept, and returns documents with the columns of ``documents``; the
last returns the packed pieces.  ``run`` writes every stage's result to the
shared folder and reads it again, so a lost executor costs one stage at most.

Defined cases, for every stage: an empty table gives an empty result; null in
``lang``, ``source`` or ``n_chars`` is a value like any other and is kept; columns
beside those of ``documents`` stay, whatever their names; repeated rows are
documents each until the second stage, which keeps one row of each group.  What a
stage does with null, empty and long texts and with null ids, it states itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import decontaminate, jaccard, packing, quality, secrets
from lattica.llm.shared import table, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likelier good than not, and not likelier toxic; the others go.

    Texts without words, null ones included, go; a null id has no label and is judged like any other;
    texts of any length are scored whole.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), host=F.col("source"), path=F.concat_ws("/", "source", "lang"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies, the one with the smallest id.

    Texts without words stay as they are; a null id counts as larger than all others; ties between rows of
    one id go by the hash of the text, and of equal rows one stays; texts of any length are compared whole.
    """
    return jaccard.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item.

    Null and empty texts have no window and stay, as do null ids; items without words or without an id are not looked for.
    """
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark and their lengths counted anew.

    A null text stays null with the length it came with; overlapping secrets become one mark.
    """
    return secrets.redact(docs).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences.

    A null or empty text has the closing id alone; long ones are cut; rows of one id are packed each.
    """
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("packing", sequence_packing),
]

#: A fitted classifier, a random field and a tokenizer are not SQL; the pipeline is tested against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
