"""A corpus pipeline over the table of documents: each stage takes what the one before kept, as a written table.

Stages but the last return the columns of `documents`, and any further ones whatever their names; the last returns the
pieces of packed sequences. Texts of any length are taken whole; an empty table gives an empty table at every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from histoframe.llm.near_dedup import keep_one_of_each
from histoframe.llm.packing import pack_documents
from histoframe.llm.quality import keep_passing
from histoframe.llm.secrets import redact_secrets, train
from histoframe.llm.suffix_dedup import cut_repeats
from histoframe.scratch import Scratch
from histoframe.session import bound_batches, ship_package


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the word rules and the compression bands pass.

    Null and empty texts have no words and go; every row has its own verdict, repeated rows and null ids too; ties don't arise.
    """
    ship_package(spark)
    bound_batches(spark)
    return keep_passing(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more.

    The smallest doc_id stays; of rows equal in id and text one; null and empty texts and rows without an id all stay.
    """
    return keep_one_of_each(docs, words=5, percent=80)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 100 bytes or more that an earlier document, or an earlier place, has.

    All rows stay; null and empty texts as they are; rows of one id go by a hash of their text; those without an id are left alone.
    """
    return cut_repeats(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced by a mark; clean documents stay as they are.

    All rows stay; null and empty texts as they are; repeated rows and null ids are treated like any other.
    """
    return redact_secrets(docs, train(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed training sequences, one row each.

    Null and empty texts are their end id alone; repeated rows are packed as often as they occur; null ids stay null.
    """
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("secret_scans", secret_scans),
    ("packing", packing),
]

#: Compression, sketches, suffix order, models and tokenizers have no SQL form; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each is written to the shared folder and read again."""
    scratch = Scratch(spark, "corpus-pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
