"""Queries over stored layouts: bucketed tables that are joined without a shuffle, and folders by month."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.operators.comorbidity import mask_score
from caseloom.plans import views
from caseloom.session import checkpoint_root
from caseloom.sources import layout

MONTHS = ("1995-01", "1995-06")


def bucketed_score(spark: SparkSession, folder: str) -> DataFrame:
    """The comorbidity score from encounters, masks and labels that are stored by encounter: no exchange in the plan."""
    stored = [
        layout.store_bucketed(df, "n")
        for df in (views.admissions(spark, folder).select("n"), views.masks(spark, folder), views.encounters(spark, folder).select("n", "label"))
    ]
    encounters, masks, labels = stored
    scores = masks.select("n", mask_score(F.col("mask")).alias("score")).hint("merge")
    joined = encounters.join(scores, "n", "left").join(labels.hint("merge"), "n", "left")
    return joined.select("n", F.coalesce("score", F.lit(0)).alias("score"), "label")


def monthly_admissions(spark: SparkSession, folder: str) -> DataFrame:
    """Admissions of a few months from a table stored by month: only their folders are read."""
    path = f"{checkpoint_root(spark)}/caseloom/months-{uuid.uuid4().hex}"
    stored = layout.store_by_month(views.admissions(spark, folder).select("n", "admit", "los"), "admit", path)
    chosen = stored.where(F.col("month").between(*MONTHS))
    return chosen.groupBy("month").agg(F.count("*").alias("encounters"), F.sum("los").alias("days"))
