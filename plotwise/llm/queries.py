"""The queries of this folder, each over its whole table with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat
from .html_text import extract
from .mixing import mix_sources
from .near_dedup import near_duplicate_classes
from .oracles import ORACLES  # noqa: F401
from .packing import pack_documents
from .quality_model import classify, trusted_ids
from .quality_rules import quality_verdicts
from .shared import table
from .spotsigs import edited_fingerprints
from .substrings import remove_repeats
from .suffix_tree import SuffixTree, score_texts


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, is_kept for every document."""
    return near_duplicate_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "is_kept")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every drawn copy of every document, in the global order of `place`."""
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", F.col("__copy").cast("long").alias("copy"), F.col("__place").alias("place"), "lang", "n_chars", "text")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every formatted conversation and of conversation -1, read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(chat.probe(spark))
    return chat.digests(rows.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts")))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and offset."""
    return pack_documents(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity, threshold and verdict for every document."""
    return classify(table(spark, sf_dir, "documents"), trusted_ids(table(spark, sf_dir, "labels")))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_words, n_removed and the hash of the kept words for every document."""
    kept = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by a tree taught on those whose crc32 of the id is not 2 modulo 7."""
    train = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 != 2
    return score_texts(table(spark, sf_dir, "documents"), train, SuffixTree(common=True))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the measures, n_left_words, base_failed, kept for every document."""
    verdicts = quality_verdicts(table(spark, sf_dir, "documents"))
    each = verdicts.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n_rows")))
    return each.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_left_words", "base_failed", "kept")


def op10_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return edited_fingerprints(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_mix_sources": op2_mix_sources,
    "op3_chat_format": op3_chat_format,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_lm_score": op7_lm_score,
    "op8_html_text": op8_html_text,
    "op9_quality_rules": op9_quality_rules,
    "op10_spotsigs": op10_spotsigs,
}
