"""Stored layouts that spare later work: tables bucketed by encounter, and partitioned by month of admission."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.session import checkpoint_root

#: Buckets of a stored table. Tables are joined without a shuffle where they have the same number.
BUCKETS = 16


def store_bucketed(df: DataFrame, key: str, buckets: int = BUCKETS, name: str | None = None) -> DataFrame:
    """Write ``df`` as a table bucketed and sorted by ``key``, and return the table.

    The rows are dealt out by the key first, so that each bucket is one file. Choose the number of buckets so that a bucket
    fits a task: the files of one bucket are read together.
    """
    name = name or f"caseloom_{uuid.uuid4().hex}"
    path = f"{checkpoint_root(df.sparkSession)}/caseloom/{name}"
    writer = df.repartition(buckets, F.col(key)).write.bucketBy(buckets, key).sortBy(key)
    writer.option("path", path).mode("errorifexists").saveAsTable(name)
    return df.sparkSession.table(name)


def store_by_month(df: DataFrame, day: str, path: str, out: str = "month") -> DataFrame:
    """Write ``df`` partitioned by the month of ``day`` as ``yyyy-MM`` and read it back; filters on it skip whole folders."""
    dated = df.withColumn(out, F.date_format(day, "yyyy-MM"))
    dated.repartition(out).write.partitionBy(out).parquet(path)
    return df.sparkSession.read.schema(dated.schema).parquet(path)
