"""Narrative and tokenized datasets, and the sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.functions.numbers import lenient_double
from caseloom.sources.encounters import require_columns

NARRATIVE_SCHEMA = T.StructType([T.StructField("prompt", T.StringType()), T.StructField("label", T.LongType())])
TOKEN_SCHEMA = T.StructType(
    [
        T.StructField("label", T.LongType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("input_ids", T.ArrayType(T.IntegerType())),
        T.StructField("attention_mask", T.ArrayType(T.ByteType())),
    ]
)


def narratives(df: DataFrame) -> DataFrame:
    """Typed ``(prompt, label)``; other columns are dropped."""
    require_columns(df, ["prompt", "label"])
    return df.select(F.col("prompt").cast("string"), lenient_double(F.col("label")).cast("long").alias("label"))


def read_narratives(spark: SparkSession, path: str, form: str = "csv") -> DataFrame:
    """Narratives from CSV (quotes doubled inside fields, line breaks allowed) or Parquet."""
    if form == "csv":
        reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
        return narratives(reader.csv(path))
    return narratives(spark.read.parquet(path))


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema``, in its order and types; an unsafe cast is an error."""
    return df.to(schema)


def fixed_length(column: str, size: int) -> Column:
    """The array, or a failed job when its length differs from ``size``."""
    message = F.concat(F.lit(f"{column} must have {size} elements, found "), F.size(column).cast("string"))
    return F.when(F.size(column) == size, F.col(column)).otherwise(F.raise_error(message))


def write_tokens(df: DataFrame, path: str, size: int) -> None:
    """Write a tokenized dataset as Parquet with its declared schema and array lengths checked."""
    checked = df.withColumns({c: fixed_length(c, size) for c in ("input_ids", "attention_mask")})
    typed(checked, TOKEN_SCHEMA).write.mode("overwrite").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return typed(spark.read.parquet(path), TOKEN_SCHEMA)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header; quotes inside fields are doubled, so ``read_narratives`` reads them back."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append_summary(summary: DataFrame, path: str) -> None:
    """Append ``(run_id, section, key, value)`` rows with the write time."""
    summary.withColumn("written_at", F.current_timestamp()).write.mode("append").parquet(path)


def preview(df: DataFrame, rows: int = 5) -> DataFrame:
    return df.limit(rows)
