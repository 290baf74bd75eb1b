"""A corpus pipeline of four stages: language ID, near-duplicates, mixing, SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; run() writes
every stage's result as Parquet into the shared folder and reads it back for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.llm import language_id, mixing, near_dedup, piece_codec
from rosterlake.llm._common import load, stored


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough certainty; null, letterless and doubtful ones go."""
    model = language_id.fit(docs)
    told = language_id.predict(docs, model, into=("__lang", "__score", "__accepted"))
    return told.filter(F.col("__accepted") & (F.col("__lang") != "und")).select(docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more)."""
    return near_dedup.drop_near_duplicates(docs, k=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Three quarters of the tokens, by the target weights of domains, languages and sources."""
    return mixing.mix(docs, mixing.levels_of(), mixing.WEIGHTS, 0.75, epochs=1, seed=6).select(docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids of the whole text, their number, and the checks of the encoding."""
    import public_tokenizers

    done = piece_codec.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return done.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_ids"), "parity", "round_trip")


STAGES = [("language_id", identify), ("near_dedup", deduplicate), ("mixing", mix), ("sentencepiece", tokenize)]

#: Hash-seeded order, trained model and tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
