"""A training corpus from documents: grade, drop copies, drop near copies, mix sources, encode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skelmap.llm import exact_dedup, mixing, quality, sentencepiece_codec, simhash
from skelmap.llm.common import cut, discard, recorded
from skelmap.llm.queries import KEEP_ABOVE, MIX_WEIGHTS, model_file, quality_model


def grade(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of the top grade is over KEEP_ABOVE; the model is fitted on the corpus's labels."""
    return quality.keep_good(docs, quality_model(spark, sf_dir), keep_above=KEEP_ABOVE)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, on shingles of five words."""
    return simhash.drop_near_copies(docs, words=5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order that keeps the sources' target weights."""
    return mixing.interleave(docs, MIX_WEIGHTS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, in the order of the mixture and with its mix_slot and mix_at.

    Files come back from a reread in no order of their own, so the mixture is worked out again: it depends on the documents alone.
    """
    mixed = mixing.mix(docs, MIX_WEIGHTS).orderBy("mix_slot", "mix_at")
    return sentencepiece_codec.code_texts(mixed, model_file(), emit_ids=True, carry=("mix_slot", "mix_at"))


STAGES = [("quality classifier", grade), ("exact dedup", drop_copies), ("simhash near-dedup", drop_near_copies), ("mixing sources", mix), ("sentencepiece", encode)]

#: SQL can't express the classifier, the fingerprints or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: list[DataFrame] = []
    for name, stage in STAGES[:-1]:
        with recorded() as made:
            staged = stage(spark, docs, sf_dir)
        docs = cut(staged, name.replace(" ", "-"))
        discard(*made.values(), *before)  # nothing reads them now
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
