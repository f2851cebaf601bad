"""Code dictionaries (code → description)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions.codes import strip
from caseloom.operators.joins import BROADCAST_BYTES, lookup_join
from caseloom.sources.encounters import require_columns


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Dictionary CSV with ``Code`` and ``Description``; extra columns are ignored and the last row of a code wins."""
    raw = require_columns(spark.read.option("header", True).option("enforceSchema", False).csv(path), ["Code", "Description"])
    line = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    return last_description(raw.select("Code", "Description", line.alias("line")), "Code", "Description", "line")


def last_description(rows: DataFrame, code: str, description: str, line: str) -> DataFrame:
    """``(code, description)`` with trimmed unique codes; of a repeated code the row with the highest ``line`` wins."""
    key = strip(F.col(code).cast("string")).alias("code")
    return rows.groupBy(key).agg(F.max_by(description, line).alias("description")).where("code IS NOT NULL")


def describe_codes(
    facts: DataFrame,
    dictionary: DataFrame,
    code: str,
    spread_by: list[str],
    out: str = "description",
    broadcast_bytes: int = BROADCAST_BYTES,
    measured: DataFrame | None = None,
) -> DataFrame:
    """Add the description of ``code``, NULL for an unknown code. See ``lookup_join`` for the strategy."""
    trimmed = strip(F.col(code))
    keyed = facts.withColumn("_code", trimmed)
    if measured is not None:
        measured = measured.select(trimmed.alias("_code"))
    names = dictionary.select(F.col("code").alias("_code"), F.col("description").alias(out))
    joined = lookup_join(keyed, names, ["_code"], spread_by, "left", broadcast_bytes, measured=measured)
    return joined.drop("_code")
