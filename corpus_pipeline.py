"""The corpus pipeline: each stage's result is written as Parquet and reread by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import langid, mixing, packing, resemblance, store, substrings


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language isn't recognised go: no letter, or a score under the calibrated threshold.

    Where no language was learned (no labelled text with a letter), only texts without a letter go.
    """
    model = langid.train(docs)
    if not model.languages:
        return langid.with_letters(docs)
    return langid.predict(docs, model, "__langid_").where("__langid_accepted").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies (five-word shingles, similarity of 0.8 or more) the document with the smallest doc_id stays.

    SimHash finds them at up to two differing bits, minimum hashes beyond; every link is verified.
    """
    return resemblance.deduplicate(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of words that stand more than once are cut out; documents without such a run keep their text as it is."""
    done = substrings.without_repeats(docs, changed_only=True)
    text = F.when(F.col("__n_removed") > 0, F.col("__kept")).otherwise(F.col("text"))
    done = done.withColumn("text", text)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("__n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.sample(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of power-of-two lengths."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), "bytes", end_id=0)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("source_mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Language scores, XXH64 fingerprints and tokenizers can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
