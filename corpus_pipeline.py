"""The corpus pipeline: rules, near-duplicates, repeated passages, mixture, packing.

Each stage takes all that its predecessor kept, written as Parquet and read again, and all but the last return the columns of
documents. The last returns a row for each packed piece.

All stages take nulls in any column (a null text is empty, a null source is a source, a null doc_id is an id that comes last),
texts of any length, rows that repeat one another, further columns of any name, which they carry along, and tables without rows,
for which they give none.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotwise.llm.mixing import mix_sources
from plotwise.llm.near_dedup import drop_near_duplicates
from plotwise.llm.packing import pack_documents
from plotwise.llm.quality_rules import keep_good
from plotwise.llm.shared import shared_folder
from plotwise.llm.substrings import remove_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; the others stay as they are. Rows that repeat one another stay or go together; a null or
    empty text goes, as it has too few words."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, that of the least doc_id; of rows that repeat it one. All texts without a
    character, null ones included, are one class."""
    return drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words under repeated windows go; n_chars follows; a document that has no word left, or had none, goes. Rows that repeat one
    another all lose what they share."""
    kept = remove_repeats(docs, untouched=True)
    return kept.where("n_words > n_removed").withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as drawn, in a global random order. Rows that repeat one another are drawn the same number of times each."""
    return mix_sources(docs).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences; a null text has one piece, its end. Copies are packed each."""
    return pack_documents(docs)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mixing", mixing), ("packing", packing)]

#: Near-duplicates by BagMinHash and byte-level BPE ids have no form in SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
