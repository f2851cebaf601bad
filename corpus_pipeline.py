"""The corpus pipeline: quality rules, exact and near copies, mixing, token ids. Each stage reads what the one before kept."""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

sys.path[:0] = [root] if (root := str(Path(__file__).resolve().parent)) not in sys.path else []

from caseloom.llm import extendible, mixing, piece_viterbi, simhash, weak_rules  # noqa: E402
from caseloom.llm.common import table  # noqa: E402
from caseloom.session import materialize  # noqa: E402


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return weak_rules.accept(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return extendible.drop_copies(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_per_group(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.emit(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every copy that the mix emits, and whether decoding gives the text back."""
    return piece_viterbi.encode(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("simhash near-dedup", simhash_dedup),
    ("mixing sources", mix_sources),
    ("sentencepiece", encode_pieces),
]
#: XXH64 fingerprints and token ids have no SQL form; tests/llm holds the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
