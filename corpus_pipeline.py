"""Corpus pipeline: language ID, exact dedup, near-dedup, source mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ampspark.llm import dart_minhash, exact_dedup, lang_id, mixing, packing
from ampspark.llm.common import stored, table
from ampspark.llm.queries import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, whether or not a language was learned."""
    return lang_id.language_of(docs, docs, keep=True).where("lettered").select("row.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for white space stays: the smallest id, null ids last; null texts are equal to empty ones; an empty table stays empty."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies stays: the smallest id, null ids last; texts without words all stay, as do all columns; an empty table stays empty."""
    return dart_minhash.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as their source's rate says, at most three times; a null source is one of its own; equal ids are drawn alike; an empty table stays empty."""
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's ids (of null texts: the final id alone) in sequences; only the columns of the pieces are returned; an empty table gives no rows."""
    return packing.packed(docs, tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("source_mixing", mix_sources),
    ("packing", pack),
]

#: Automata, signatures and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet and reread by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
