"""Distinct counts and quantiles from sketches that are stored per batch and merged.

A batch of rows leaves one small row per group behind; later batches are sketched alone and merged with the stored ones, so
no batch is read twice. Distinct counts are HyperLogLog sketches, quantiles KLL sketches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2 ** bits registers; the standard error of a distinct count is 1.04 over the root of their number.
HLL_BITS = 14
#: Size of a KLL sketch; the rank of a quantile is off by about 2.3 over this, of all rows, with 99 percent confidence.
KLL_SIZE = 800


def distinct_error(bits: int = HLL_BITS) -> float:
    """Three standard errors of a distinct count, as a share of it."""
    return 3 * 1.04 / 2 ** (bits / 2)


def rank_error(size: int = KLL_SIZE) -> float:
    """The bound of a quantile's rank error that is kept in 99 of 100 cases, doubled for sketches of sketches."""
    return 2 * 2.296 / size**0.9021


def level_sketches(rows: DataFrame, groups: list[str], value: str, bits: int = HLL_BITS) -> DataFrame:
    """``groups…, sketch``: one sketch of the distinct values per group, combined map-side. NULL is no value."""
    return rows.groupBy(*groups).agg(F.hll_sketch_agg(value, bits).alias("sketch"))


def merged_levels(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """``groups…, levels``: estimated distinct values over all stored sketches of a group."""
    return sketches.groupBy(*groups).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("levels"))


def length_sketches(rows: DataFrame, groups: list[str], value: str, size: int = KLL_SIZE) -> DataFrame:
    """``groups…, sketch``: one quantile sketch of a whole-number column per group."""
    return rows.groupBy(*groups).agg(F.kll_sketch_agg_bigint(F.col(value).cast("long"), F.lit(size)).alias("sketch"))


def merged_quantiles(sketches: DataFrame, groups: list[str], quantiles: dict[str, float], size: int = KLL_SIZE) -> DataFrame:
    """``groups…, rows`` and a column per named quantile, over all stored sketches of a group."""
    merged = sketches.groupBy(*groups).agg(F.kll_merge_agg_bigint("sketch", F.lit(size)).alias("sketch"))
    found = [F.kll_sketch_get_quantile_bigint("sketch", F.lit(share)).alias(name) for name, share in quantiles.items()]
    return merged.select(*groups, F.kll_sketch_get_n_bigint("sketch").alias("rows"), *found)
