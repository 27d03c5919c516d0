"""From raw documents to token ids in five stages; each is written as Parquet and read again by the next.

Every stage works on all rows that its predecessor kept and applies the operator's decisions: rejected documents go, one
document of each near-duplicate group stays, documents repeat or go as the mix takes them. All stages but the last return
the columns of ``documents``; the last returns doc_id, n_tokens, ids_sha256 and decoded_sha256 of each remaining row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from feedloom.llm import bpe, langid, minhash, mixing, quality
from feedloom.llm.common import save


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; null, empty and letterless texts go.

    Ambiguous texts stay, and repeated rows each do. Labels may be null or missing altogether. No rows give no rows.
    """
    return langid.keep_identified(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that are too frequent on their source.

    Null and empty texts fail the rules; a null source is a source of its own; repeated rows are judged alike and each stay
    or go. Other columns come back as they were, ``n_chars`` with the new length. No rows give no rows.
    """
    return quality.filter_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest doc_id, a null one last.

    Of rows that repeat a text under one doc_id one stays; of different texts under it that with the smallest hash. Texts
    without words are linked with nothing and all stay. No rows give no rows.
    """
    return minhash.drop_near_duplicates(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: never, once, or up to three times.

    Null and empty texts have no words and are never taken; a null source is a source of its own; repeated rows are drawn
    one by one. No rows give no rows.
    """
    return mixing.mixed_documents(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids of each document and of the text they decode to.

    A null text counts as an empty one, which has no tokens; a null doc_id stays null; repeated rows each come back. No
    rows give no rows.
    """
    import public_tokenizers

    return bpe.encoded_digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("bpe_encoding", bpe_encoding),
]

#: Language identification and token ids have no SQL form; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
