"""Encounter views over the star-schema tables: an order is an encounter, its lines are the codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.operators.comorbidity import add_score, condition_mask
from caseloom.operators.readmission import readmission_label
from caseloom.session import materialize
from caseloom.sources.encounters import first_positions

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def admissions(spark: SparkSession, folder: str) -> DataFrame:
    """Encounters without the label: one scan of orders, no shuffle."""
    status = F.col("o_orderstatus")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("n"),
        F.col("o_custkey").alias("patient_id"),
        F.col("o_orderdate").alias("admit"),
        F.when(status == "O", "1").when(status == "F", "3").otherwise("7").alias("disposition"),
        (F.col("o_custkey") % 73 + 18).alias("age"),
        (F.col("o_orderkey") % 14 + 1).alias("los"),
    )


def encounters(spark: SparkSession, folder: str) -> DataFrame:
    return readmission_label(admissions(spark, folder))


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """``(n, patient_id, label)`` written once, for work that reads the label in several passes."""
    return materialize(encounters(spark, folder).select("n", "patient_id", "label"))


def code_lines(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order line with its diagnosis and procedure code; no positions, no shuffle."""
    base = F.concat(
        F.char(65 + F.col("l_partkey") % 26),
        F.lpad(((F.col("l_partkey") * 37 + F.col("l_suppkey")) % 100).cast("string"), 2, "0"),
        (F.col("l_quantity").cast("int") % 10).cast("string"),
    )
    dx = (
        F.when(F.col("l_discount") == 0.1, F.lit(None).cast("string"))
        .when(F.col("l_tax") == 0.0, F.substring(base, 1, 2))
        .when(F.col("l_linestatus") == "O", F.lower(base))
        .otherwise(base)
    )
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("n"), dx.alias("dx"), F.col("l_partkey").cast("string").alias("cpt"), *LINE_ORDER
    )


def positioned_codes(spark: SparkSession, folder: str, limit: int) -> DataFrame:
    """The first ``limit`` codes of every encounter as ``(n, pos, dx, cpt)``."""
    lines = first_positions(code_lines(spark, folder), "n", LINE_ORDER, limit)
    return lines.select("n", "pos", "dx", "cpt")


def dictionary(spark: SparkSession, folder: str) -> DataFrame:
    """Procedure dictionary from part names; every tenth key is left out so that lookups can miss."""
    part = table(spark, folder, "part").where(F.col("p_partkey") % 10 != 0)
    return part.select(F.col("p_partkey").cast("string").alias("code"), F.col("p_name").alias("description"))


def masks(spark: SparkSession, folder: str) -> DataFrame:
    return condition_mask(code_lines(spark, folder), "n", "dx")


def scored_encounters(spark: SparkSession, folder: str) -> DataFrame:
    return add_score(
        encounters(spark, folder), masks(spark, folder), "n", measured=admissions(spark, folder)
    )
