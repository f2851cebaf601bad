"""Small fixed tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def constant_table(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    """A driver-side list of rows as a local relation, whose size Catalyst knows."""
    return spark.createDataFrame(pa.table({name: [row[i] for row in rows] for i, name in enumerate(columns)}))
