"""From raw documents to packed sequences: judge, drop copies, drop near copies, mix, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each one's rows
to the shared folder and reads them again as the next one's documents.  All stages but the
last return the columns of ``documents``.  They work on any rows, as their operators do:
missing texts are empty, rows that repeat an id are rows of their own unless they repeat
the text too, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from railbird.llm.exact_dedup import drop_exact_copies
from railbird.llm.mixing import mixed_documents
from railbird.llm.packing import pack
from railbird.llm.quality import good_documents
from railbird.llm.simhash import one_of_each_group
from railbird.session import written


def judge(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on ``labels``, doesn't reject."""
    return good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of close fingerprints."""
    return one_of_each_group(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it."""
    return mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their places in sequences."""
    return pack(docs)


STAGES = [
    ("quality classifier", judge),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("source mixing", mix),
    ("best-fit packing", pack_sequences),
]
#: SQL has no tokenizer, no trained classifier and no fingerprints; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what the stages leave of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
