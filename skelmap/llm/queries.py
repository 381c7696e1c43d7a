"""The driver's queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann_forest, byte_bpe, chat_preference, collocations, exact_dedup, importance, language_id, license_scan, mixing, quality, sentencepiece_codec, simhash, substring_dedup
from .common import tables_dir

#: Target weights of the mixture; other sources have weight 1.
MIX_WEIGHTS = {"src0": 4, "src1": 3, "src2": 2, "src3": 2}
KEEP_ABOVE = 0.35


def model_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_chat_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat_preference.format_preferences(chat_preference.conversation_pairs(tables_dir(spark, sf_dir, "conversations")))
    return out.withColumns({c: chat_preference.spans_text(c) for c in ("chosen_spans", "rejected_spans")})


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables_dir(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.train(docs))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(tables_dir(spark, sf_dir, "documents"), words=3)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(tables_dir(spark, sf_dir, "documents")).drop("n_keep")


def op5_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_forest.nearest(tables_dir(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def quality_model(spark: SparkSession, sf_dir: str) -> quality.OrdinalModel:
    return quality.train(tables_dir(spark, sf_dir, "documents"), quality.grades_of(tables_dir(spark, sf_dir, "labels")))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(tables_dir(spark, sf_dir, "documents"), quality_model(spark, sf_dir), keep_above=KEEP_ABOVE)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(tables_dir(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(tables_dir(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(tables_dir(spark, sf_dir, "documents").select("doc_id", "source"), MIX_WEIGHTS)
    return mixed.select("doc_id", "source", "mix_phase", "mix_block", "mix_slot", "mix_release", "mix_deadline", "mix_at")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.code_texts(tables_dir(spark, sf_dir, "documents"), model_file())


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(tables_dir(spark, sf_dir, "documents"), tables_dir(spark, sf_dir, "benchmark"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(tables_dir(spark, sf_dir, "documents"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.code_texts(tables_dir(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_chat_preference, op2_language_id, op3_simhash, op4_exact_dedup, op5_ann_forest, op6_quality, op7_license_scan, op8_substring_dedup, op9_mixing, op10_sentencepiece, op11_importance, op12_collocations, op13_byte_bpe)}
