"""The registered queries of this package: thin digests of the operators over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm import (
    bit_planes,
    extendible,
    filter_audit,
    forced_bpe,
    mixing,
    piece_viterbi,
    quotes,
    simhash,
    token_counts,
    turn_repair,
    url_filter,
    warc,
    weak_rules,
)
from caseloom.llm.common import shared_folder, table
from caseloom.llm.sql import ORACLES  # noqa: F401


def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Pages whose id has a label are the evidence; toxic and poor ones count as blocked."""
    pages = table(spark, folder, "pages")
    labels = table(spark, folder, "labels")
    blocked = F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False))
    labelled = pages.join(labels, pages["page_id"] == labels["doc_id"]).select("url", blocked.alias("blocked"))
    rules = url_filter.index(spark, url_filter.GIVEN, url_filter.mine(labelled))
    return url_filter.judge(pages, rules)


def op2_quotation_linking(spark: SparkSession, folder: str) -> DataFrame:
    """Formatted conversations in reply order, and the links of their messages."""
    parts = quotes.conversations(quotes.reply_order(table(spark, folder, "conversations")))
    messages = F.col("messages")
    return parts.select(
        "conv_id", "part", F.size(messages).cast("long").alias("n_messages"), "formatted", quotes.links_text(messages).alias("links")
    )


def op3_bit_planes(spark: SparkSession, folder: str) -> DataFrame:
    out = shared_folder(spark, f"ids-{uuid.uuid4().hex}")
    bit_planes.write(table(spark, folder, "documents"), out)
    ids = F.col("ids")
    return bit_planes.read(spark, out).select(
        "doc_id", "start", (F.octet_length(ids) / 4).cast("long").alias("n_tokens"), F.crc32(ids).alias("ids_crc32")
    )


def op4_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return extendible.exact_copies(table(spark, folder, "documents"))


def op5_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return piece_viterbi.encode(table(spark, folder, "documents"))


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = weak_rules.quality(table(spark, folder, "documents"))
    return judged.withColumn("p_good", F.round("p_good", 6))


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_copies(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.section_tokens(table(spark, folder, "documents"))


def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    out = shared_folder(spark, f"warc-{uuid.uuid4().hex}")
    warc.write(table(spark, folder, "pages"), out)
    return warc.read(spark, out, payloads=False).drop("url")


def op10_mix(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op11_forced_bpe(spark: SparkSession, folder: str) -> DataFrame:
    found = forced_bpe.encode(table(spark, folder, "documents"), decoded=True)
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op13_turn_repair(spark: SparkSession, folder: str) -> DataFrame:
    return turn_repair.report(table(spark, folder, "conversations"))


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_quotation_linking": op2_quotation_linking,
    "op3_bit_planes": op3_bit_planes,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_quality_rules": op6_quality_rules,
    "op7_simhash": op7_simhash,
    "op8_token_counts": op8_token_counts,
    "op9_warc": op9_warc,
    "op10_mix": op10_mix,
    "op11_forced_bpe": op11_forced_bpe,
    "op12_filter_audit": op12_filter_audit,
    "op13_turn_repair": op13_turn_repair,
}
