"""Scoring at admission: the batch expressions and a fitted model on a stream of encounters."""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from caseloom.operators.models import score


def read_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stream of the Parquet files of a table, whether the table is one file or a folder that files are added to.

    The path is given as a pattern that only the path itself matches, which lets the source list either kind.
    """
    path = path.rstrip("/")
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


def first_arrivals(stream: DataFrame, key: str, event_time: str, delay: str | None = None) -> DataFrame:
    """Drop repeated messages of the same key.

    Without ``delay`` every key is remembered, on disk, and no message is too late. With it a key is forgotten after that
    time, and messages older than that are dropped; the query's progress counts them as ``numRowsDroppedByWatermark``.
    """
    if delay is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def score_stream(stream: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    return score(model, stream, keep)


def start_sink(scored: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append scored rows as Parquet; a restart goes on from ``checkpoint``.

    Without ``every`` the query processes what is there and stops, else it runs at that interval, such as ``1 minute``.
    """
    writer = scored.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.outputMode("append").trigger(**trigger).start()
