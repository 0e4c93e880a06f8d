"""The queries p2, p7, p8 and p9 over the tables of the test data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm.garble import find_garbled
from strandweave.llm.leaks import find_leaks
from strandweave.llm.pieces import split_oversized
from strandweave.llm.sql import SQL  # noqa: F401
from strandweave.llm.tokens import encode_texts
from strandweave.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(table(spark, d, "fasta_entries"), "entry_no", "sequence")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_texts(table(spark, d, "documents"), "doc_id", "text")


def _leaks(spark: SparkSession, d: str, paraphrases: bool) -> DataFrame:
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), "doc_id", "text", "eval_id", "text", paraphrases=paraphrases)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d, False).select("doc_id", "eval_id")


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Copied passages and paraphrases, with what they share."""
    found = _leaks(spark, d, True)
    return found.select("doc_id", "eval_id", "run_words", *[F.round(c, 3).alias(c) for c in ("cosine", "lcs_share", "answer_share")])


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return find_garbled(table(spark, d, "documents"), "doc_id", "text").select("doc_id")


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    """The restored texts, where anything could be restored."""
    found = find_garbled(table(spark, d, "documents"), "doc_id", "text")
    return found.select("doc_id", F.round("gain", 3).alias("gain"), "restored", "lost")


QUERIES = {f.__name__: f for f in (p2_found, p7_ids, p8_found, p8_leaks, p9_found, p9_restored)}
