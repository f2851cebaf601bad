"""Cohort profiles: distributions, group means, descriptive statistics, truncation statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions.numbers import guarded_ratio, percent_text
from caseloom.operators.ranks import ROWS_PER_BUCKET, exact_quantiles

# Display names of the group comparison.
COMPARISON_HEADINGS = {
    "mean_age": "Mean Age",
    "mean_los": "Mean Length of Stay",
    "mean_score": "Mean CCI Score",
    "mean_dx": "Mean # of ICD Codes",
    "mean_cpt": "Mean # of CPT Codes",
}


def group_means(df: DataFrame, by: str, means: dict[str, str]) -> DataFrame:
    """Row count and mean of each column in ``means`` (output name → input column) per group; NULL groups dropped."""
    return (
        df.where(F.col(by).isNotNull())
        .groupBy(by)
        .agg(F.count("*").alias("encounters"), *[F.avg(column).alias(name) for name, column in means.items()])
    )


def display_means(means: DataFrame, decimals: int = 2, headings: dict[str, str] = COMPARISON_HEADINGS) -> DataFrame:
    """Round half to even and use the display headings."""
    rounded = {name: F.bround(name, decimals) for name in headings if name in means.columns}
    return means.withColumns(rounded).withColumnsRenamed(headings)


def value_counts(df: DataFrame, column: str, count: str = "encounters") -> DataFrame:
    """Rows per value, largest first; NULLs are not counted."""
    counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias(count))
    return counted.orderBy(F.desc(count), column)


def shares(counts: DataFrame, count: str = "encounters", out: str = "pct") -> DataFrame:
    """Add each row's share of the total in percent. The total is a scalar subquery, so ``counts`` may have any size."""
    total = counts.agg(F.sum(count)).scalar()
    return counts.withColumn(out, 100.0 * F.col(count) / total)


def share_table(df: DataFrame, column: str) -> DataFrame:
    """``value_counts`` with the share and its one-decimal text."""
    table = shares(value_counts(df, column)).withColumn("share_text", percent_text(F.col("pct"), 1))
    return table.orderBy(F.desc("encounters"), column)


def distribution(df: DataFrame, group: Column, order: tuple[str, ...]) -> DataFrame:
    """Percentage of rows per category in a fixed order; categories without rows do not appear."""
    counted = df.groupBy(group.alias("category")).agg(F.count("*").alias("encounters"))
    place = F.array_position(F.array(*[F.lit(name) for name in order]), F.col("category")).cast("int")
    return shares(counted).withColumn("ord", place).where(F.col("ord") > 0).orderBy("ord")


def truncation_stats(df: DataFrame, length: str, limit: int) -> DataFrame:
    """How many rows exceed ``limit`` and how much they lose; means over all rows and over the truncated ones."""
    over = F.col(length) > limit
    lost = F.when(over, F.col(length) - limit).otherwise(0)
    totals = df.agg(
        F.count("*").alias("narratives"),
        F.count_if(over).alias("truncated"),
        F.coalesce(F.sum(lost), F.lit(0)).alias("lost"),
        F.coalesce(F.max(lost), F.lit(0)).alias("max_lost"),
    )
    return totals.select(
        "narratives",
        "truncated",
        (guarded_ratio(F.col("truncated"), F.col("narratives")) * 100).alias("pct_truncated"),
        guarded_ratio(F.col("lost"), F.col("narratives")).alias("mean_lost_all"),
        guarded_ratio(F.col("lost"), F.col("truncated")).alias("mean_lost_truncated"),
        "max_lost",
    )


def describe(df: DataFrame, column: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles, as one row."""
    moments = df.agg(
        F.count(column).alias("count"),
        F.avg(column).alias("mean"),
        F.stddev_samp(column).alias("std"),
        F.min(column).alias("min"),
        F.max(column).alias("max"),
    )
    shares_by_name = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    quartiles = exact_quantiles(df, column, shares_by_name, rows_per_bucket)
    found = quartiles.select(F.struct(*shares_by_name)).scalar()
    return moments.withColumn("_q", found).select(
        "count", "mean", "std", "min", *[F.col("_q")[name].alias(name) for name in shares_by_name], "max"
    )
