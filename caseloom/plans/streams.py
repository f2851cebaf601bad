"""Streaming queries: later events arrive as admissions and are scored by a model fitted on the earlier ones."""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions.codes import chapter
from caseloom.functions.numbers import lenient_double
from caseloom.operators.comorbidity import add_array_score
from caseloom.operators.readmission import WINDOW_DAYS
from caseloom.plans import views
from caseloom.session import checkpoint_root, materialize
from caseloom.streaming import admission, readmission


def arrivals(events: DataFrame) -> DataFrame:
    """Events as admissions: a primary code, a secondary code, and the amount. Works on tables and on streams."""
    k = lenient_double(F.get_json_object("props", "$.k")).cast("int")
    primary = F.concat(F.char(65 + (k % 26).cast("long")), F.lpad((F.col("user_id") % 100).cast("string"), 2, "0"))
    secondary = F.concat(F.lit("I"), F.lpad((k % 100).cast("string"), 2, "0"))
    rows = events.select(
        F.col("event_id").alias("n"),
        F.col("ts").cast("timestamp").alias("arrived"),
        primary.alias("dx"),
        F.array(primary, secondary).alias("codes"),
        F.col("value").alias("amount"),
        (F.col("event_type") == "error").cast("int").alias("label"),
    )
    return add_array_score(rows.withColumn("title", chapter(F.col("dx"))), "codes")


#: Share of the time span of the events that is history; what comes later arrives on the stream.
HISTORY = 0.8


def stream_score(spark: SparkSession, folder: str) -> DataFrame:
    """Later events, read as a stream and scored by a model that was fitted on the earlier ones."""
    events = views.table(spark, folder, "events")
    span = events.agg(F.unix_micros(F.min("ts").cast("timestamp")), F.unix_micros(F.max("ts").cast("timestamp"))).first()
    cut = F.timestamp_micros(F.lit(int(span[0] + (span[1] - span[0]) * HISTORY) if span[0] is not None else 0))
    history = arrivals(events).where(F.col("arrived") < cut)
    pipeline = Pipeline(
        stages=[
            VectorAssembler(inputCols=["score", "amount"], outputCol="features"),
            LogisticRegression(maxIter=20),
        ]
    )
    model = pipeline.fit(history)
    stream = arrivals(admission.read_stream(spark, f"{folder}/events.parquet", events.schema)).where(F.col("arrived") >= cut)
    fresh = admission.first_arrivals(stream, "n", "arrived")
    scored = admission.score_stream(fresh, model, ["n", "arrived", "title", "score", "label"])
    run = f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"
    query = admission.start_sink(scored, f"{run}/scored", f"{run}/progress")
    query.awaitTermination()
    return spark.read.schema(scored.schema).parquet(f"{run}/scored")


def stream_rows(spark: SparkSession, folder: str) -> DataFrame:
    """What the stream must deliver whatever the model: every later event once, with its chapter and score."""
    rows = stream_score(spark, folder)
    agrees = F.col("predicted_label") == (F.col("predicted_probability") > 0.5).cast("int")
    return rows.select(
        "n", "title", "score", "label", (agrees & F.col("predicted_probability").between(0, 1)).alias("valid")
    )


#: Runs of the label stream: each finds the admissions of the next share of the time span, and goes on from the last.
LABEL_RUNS = 3
LABEL_DELAY_DAYS = 2


def streamed_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The readmission label from a stream-stream join, for admissions whose window the watermark has passed.

    The admissions arrive in order of time, in ``LABEL_RUNS`` portions; after each the query is stopped and started anew.
    """
    admissions = materialize(views.admissions(spark, folder).select("n", "patient_id", F.col("admit").cast("timestamp").alias("admit")))
    first, last = admissions.agg(F.unix_seconds(F.min("admit")), F.unix_seconds(F.max("admit"))).first()
    run = f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"
    first, last = first or 0, last or 0
    step = (last - first) // LABEL_RUNS + 1
    sent = None
    for i in range(LABEL_RUNS):
        inside = F.unix_seconds("admit").between(first + i * step, first + (i + 1) * step - 1)
        admissions.where(inside).write.mode("append").parquet(f"{run}/arrived")
        streams = [admission.read_stream(spark, f"{run}/arrived", admissions.schema) for _ in range(2)]
        sent = readmission.readmissions(*streams, delay=f"{LABEL_DELAY_DAYS} days")
        admission.start_sink(sent, f"{run}/sent", f"{run}/progress").awaitTermination()
    found = readmission.labels(spark.read.schema(sent.schema).parquet(f"{run}/sent"))
    closed = F.timestamp_seconds(F.lit(last - (LABEL_DELAY_DAYS + WINDOW_DAYS + 1) * 86400))
    return found.where(F.col("admit") < closed).select("n", "label")
