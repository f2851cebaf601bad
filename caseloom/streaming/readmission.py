"""The readmission label on a stream: each admission meets the patient's later admissions within the window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.operators.readmission import WINDOW_DAYS


def readmissions(
    index: DataFrame,
    later: DataFrame,
    key: str = "n",
    patient: str = "patient_id",
    admit: str = "admit",
    days: int = WINDOW_DAYS,
    delay: str = "0 days",
) -> DataFrame:
    """``key, patient, admit, next_n``: each admission with every later one of the patient within ``days``, or with NULL.

    ``index`` and ``later`` are two streams of the same admissions. Admissions may arrive ``delay`` late. An admission leaves
    the state once the watermark has passed its window; without a match it is sent on with NULL at that moment, so the state
    holds the admissions of one window and one delay, whatever the length of the stream. Of two admissions at the same time
    the one with the greater key is later.
    """
    first = index.select(key, patient, admit).withWatermark(admit, delay)
    names = {key: "next_n", patient: "next_patient", admit: "next_admit"}
    second = later.select(*[F.col(c).alias(n) for c, n in names.items()]).withWatermark("next_admit", delay)
    follows = F.expr(f"next_admit > {admit} OR (next_admit = {admit} AND next_n > {key})")
    inside = F.expr(f"next_admit >= {admit} AND next_admit <= {admit} + INTERVAL {days} DAYS")
    met = first.join(second, (first[patient] == second["next_patient"]) & inside & follows, "left_outer")
    return met.select(key, patient, admit, "next_n")


def labels(sent: DataFrame, key: str = "n", patient: str = "patient_id", admit: str = "admit") -> DataFrame:
    """``key, patient, admit, label`` from what the stream has sent: 1 where a later admission was met."""
    return sent.groupBy(key, patient, admit).agg(F.max(F.col("next_n").isNotNull().cast("int")).alias("label"))
