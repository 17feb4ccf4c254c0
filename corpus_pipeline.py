"""From raw documents to packed training sequences, one Parquet table between two stages.

Every stage takes documents with nulls in any column, empty and very long texts, repeated rows, ties and further columns
with any names, and an empty table, which gives an empty one. What it does with each is stated below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siteloom.llm import neardup, outliers, packing, pfair, secret_scan
from siteloom.llm.common import discard, documents, materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    Null and empty texts fail the base rules and go. Null languages and sources are groups of their own; repeated rows are
    judged each, and a null doc_id doesn't matter. Further columns go.
    """
    return outliers.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the smallest id.

    Rows of one doc_id count as one document, of which the smallest row stays. Rows without a doc_id all stay, and so do
    documents without words. Further columns go.
    """
    return neardup.keep_one_each(docs, size=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts, and n_chars follows; every row stays, null and repeated ones too. Further columns go."""
    return secret_scan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents get their slot of the mix and their place in it; every row stays.

    A null source is a source of its own; equal rows go where the first of them goes. Further columns go.
    """
    return pfair.placed_documents(docs, power=0.5)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their training sequences, which are numbered in the order of the mix.

    A null or empty text is the end id alone; a null doc_id stays null; equal rows are packed each.
    """
    return packing.pack_documents(docs, order=("slot", "place"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mix", mix), ("pack", pack)]
#: Robust covariances, components and tokenizers are beyond SQL. tests/llm/test_pipeline.py holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    written: list[DataFrame] = []
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        discard(*written)  # what the stage before wrote is used up
        written = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
