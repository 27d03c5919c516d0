"""The opN_ queries: thin digests of what the operators return, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm import bpe, embedding, html, langid, licenses, minhash, mixing, negatives, packing, periodic, quality, repeats, warc
from feedloom.llm.oracles import ORACLES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~langid.held_out()))
    found = langid.identify(docs.select("doc_id", "text", langid.held_out().alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded_digests(_table(spark, sf_dir, "documents"), _tokenizer())


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summarise(licenses.scan(_table(spark, sf_dir, "documents")))


def op5_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_vectors(_table(spark, sf_dir, "embeddings"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), _tokenizer())


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = periodic.plant_periods(_table(spark, sf_dir, "documents"))
    return periodic.run_digest(periodic.periodic_runs(planted))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(negatives.relabelled(_table(spark, sf_dir, "embeddings")))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_digest(repeats.without_repeats(_table(spark, sf_dir, "documents")))


def license_base_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op4 returns of the given phrases, without the method's own labels."""
    return op4_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def mixing_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op2 returns but for the draw: sizes and targets, and that each row takes one of the two copy counts next to its share."""
    found = op2_source_mixing(spark, sf_dir)
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.col("taken") == F.col("copies") * F.col("size")
    within = (F.col("copies") >= F.floor(share)) & (F.col("copies") <= F.ceil(share)) & (F.col("taken") <= mixing.MOST * F.col("size"))
    return found.select("doc_id", "size", "source_size", "target", whole.alias("whole_copies"), within.alias("within"))


def mixing_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op2 takes of each source together: within one per cent of its target."""
    taken = op2_source_mixing(spark, sf_dir).groupBy("source", "source_size", "target").agg(F.sum("taken").alias("taken"))
    return taken.select("source", "source_size", "target", (F.abs(F.col("taken") - F.col("target")) <= 0.01 * F.col("target")).alias("near"))


def language_undetermined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts for which op1 gives no language."""
    return op1_language_id(spark, sf_dir).select("doc_id", (F.col("lang_pred") == langid.UNDETERMINED).alias("undetermined"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_source_mixing": op2_source_mixing,
    "op3_bpe_codec": op3_bpe_codec,
    "op4_license_scan": op4_license_scan,
    "op5_warc_archive": op5_warc_archive,
    "op6_html_extraction": op6_html_extraction,
    "op7_minhash_dedup": op7_minhash_dedup,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_packing": op10_packing,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_suffix_dedup": op13_suffix_dedup,
    "license_base_places": license_base_places,
    "mixing_bounds": mixing_bounds,
    "mixing_totals": mixing_totals,
    "language_undetermined": language_undetermined,
}

__all__ = ["ORACLES", "QUERIES"]
