"""Feature encodings learned from a table and applied to another."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.functions.numbers import embedding_size
from caseloom.operators.joins import BROADCAST_BYTES, HOT_FLOOR, hot_keys, lookup_join, with_fan
from caseloom.operators.ranks import ROWS_PER_BUCKET, prefix_sums, random_order, text_bucket
from caseloom.operators.sampling import SEED
from caseloom.session import materialize

UNSEEN = -1


def level_table(codes: DataFrame, column: str, code: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """``(column, code, ordinal)``: sorted levels of every feature column numbered from 0.

    ``codes`` is in long form: ``column`` names the feature, ``code`` its value. All columns are fitted in one pass, and
    the numbering ranks only inside a range of codes.
    """
    levels = materialize(codes.where(F.col(code).isNotNull()).select(column, code).distinct())
    bucketed = text_bucket(levels, code, "_bucket", rows_per_bucket)
    return prefix_sums(bucketed, [column], "_bucket", [code], {"ordinal": F.lit(1).cast("long")}).drop("_bucket")


def ordinal_encode(
    codes: DataFrame,
    levels: DataFrame,
    column: str,
    code: str,
    spread_by: list[str],
    broadcast_bytes: int = BROADCAST_BYTES,
    measured: DataFrame | None = None,
) -> DataFrame:
    """Add ``ordinal`` from a fitted level table; values it does not hold get -1. Hot values are split.

    Only rows of columns with many levels are shuffled. They are joined by code first: rows are sorted by the first bytes of the
    first key, and those of a column's name are alike.
    """
    joined = lookup_join(codes, levels, [code, column], spread_by, "left", broadcast_bytes, measured=measured, part=column)
    kept = [c for c in codes.columns if c not in (column, code)]
    return joined.select(column, code, *kept, F.coalesce("ordinal", F.lit(UNSEEN).cast("long")).alias("ordinal"))


def decode_levels(
    coded: DataFrame, levels: DataFrame, column: str, code: str, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """The reverse mapping: add the code that an ``ordinal`` of a feature column stands for."""
    joined = lookup_join(coded, levels, ["ordinal", column], coded.columns, "left", broadcast_bytes, part=column)
    return joined.select(*coded.columns, code)


def embedding_sizes(levels: DataFrame, column: str) -> DataFrame:
    """Number of levels per feature column and the embedding width it asks for."""
    counted = levels.groupBy(column).agg(F.count("*").alias("levels"))
    return counted.withColumn("width", embedding_size(F.col("levels")))


def level_counts(codes: DataFrame, column: str, code: str) -> DataFrame:
    """Distinct non-NULL values per feature column."""
    return codes.groupBy(column).agg(F.count_distinct(F.col(code)).alias("levels"))


def fit_scaler(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column, in one pass; a constant column gets deviation 1."""
    pairs = [F.struct(F.avg(c), F.stddev_pop(c)).alias(c) for c in columns]
    found = df.agg(*pairs).first()
    return {c: (found[c][0] or 0.0, found[c][1] or 1.0) for c in columns}


def standardize(df: DataFrame, scaler: dict[str, tuple[float, float]], suffix: str = "") -> DataFrame:
    return df.withColumns({f"{c}{suffix}": (F.col(c) - mean) / F.lit(dev) for c, (mean, dev) in scaler.items()})


def smoothed_mean(positives: Column, rows: Column, prior: Column, smoothing: float) -> Column:
    return (positives + prior * smoothing) / (rows + F.lit(smoothing))


@dataclass(frozen=True)
class FoldMeans:
    """Target means of the levels per fold, each from the rows of the other folds, and the priors for unknown levels."""

    table: DataFrame
    prior: Column


def fit_fold_means(
    df: DataFrame, codes: list[str], label: str, fold: str, smoothing: float = 10.0, prior_rows: DataFrame | None = None
) -> FoldMeans:
    """Out-of-fold target means, drawn towards the prior of the other folds.

    The priors are means over ``prior_rows``, such as one row per encounter, else over the rows of ``df``.

    ``codes`` are the columns that name a level, for example the feature position and its code. The rows are combined
    map-side to one per level and fold.
    """
    own = df.dropna(subset=codes).groupBy(*codes, fold).agg(F.sum(label).alias("_own_pos"), F.count(label).alias("_own_rows"))
    level = Window.partitionBy(*codes)  # a row per fold
    every = own.withColumns({f"_all_{c}": F.sum(f"_own_{c}").over(level) for c in ("pos", "rows")})
    base = df if prior_rows is None else prior_rows
    sizes = base.groupBy(fold).agg(F.sum(label).alias("pos"), F.count(label).alias("rows")).collect()  # one row per fold
    pos, rows = sum(s["pos"] or 0 for s in sizes), sum(s["rows"] for s in sizes)
    prior = F.lit(pos / rows if rows else 0.0)
    for size in sizes:
        others = rows - size["rows"]
        value = (pos - (size["pos"] or 0)) / others if others else 0.0
        prior = F.when(F.col(fold) == size[fold], F.lit(value)).otherwise(prior)
    encoded = smoothed_mean(
        F.coalesce(F.col("_all_pos") - F.col("_own_pos"), F.lit(0)),
        F.col("_all_rows") - F.col("_own_rows"),
        prior,
        smoothing,
    )
    table = every.select(*codes, fold, encoded.alias("encoded"))
    return FoldMeans(materialize(table), prior)


def apply_fold_means(
    df: DataFrame,
    means: FoldMeans,
    codes: list[str],
    fold: str,
    spread_by: list[str],
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Add ``encoded``; a level with a NULL gets the prior. Hot levels are split."""
    joined = lookup_join(df, means.table, [*codes, fold], spread_by, "left", broadcast_bytes)
    return joined.withColumn("encoded", F.coalesce(F.col("encoded"), means.prior))


def fit_target_means(
    df: DataFrame, codes: list[str], label: str, smoothing: float = 10.0, prior: float | None = None
) -> tuple[DataFrame, float]:
    """``(codes…, encoded)`` from all training rows, for rows that are only scored, and the prior for unknown levels."""
    prior = (df.agg(F.avg(label)).first()[0] or 0.0) if prior is None else prior
    stats = df.dropna(subset=codes).groupBy(*codes).agg(F.sum(label).alias("_p"), F.count(label).alias("_r"))
    value = smoothed_mean(F.coalesce("_p", F.lit(0)), F.col("_r"), F.lit(prior), smoothing)
    return materialize(stats.select(*codes, value.alias("encoded"))), prior


def apply_target_means(
    df: DataFrame,
    fitted: tuple[DataFrame, float],
    codes: list[str],
    spread_by: list[str],
    broadcast_bytes: int = BROADCAST_BYTES,
    measured: DataFrame | None = None,
) -> DataFrame:
    table, prior = fitted
    joined = lookup_join(df, table, codes, spread_by, "left", broadcast_bytes, measured=measured)
    return joined.withColumn("encoded", F.coalesce("encoded", F.lit(prior)))


def ordered_means(
    df: DataFrame,
    codes: list[str],
    label: str,
    key: str,
    prior: float,
    smoothing: float = 1.0,
    seed: int = SEED,
    hot_floor: int = HOT_FLOOR,
) -> DataFrame:
    """Add ``encoded``: the mean label of the level's rows that come before the row in a random order, drawn to ``prior``.

    No row's own label enters its value, so the column tells nothing about it. Rows of a level stand in the order of a hash
    of ``key`` and the seed, then of the key itself, which must be unique in a level. A level is ranked in one
    place; only a hot one is split into ranges of the hash, whose sums are joined. The hash is made again after the rows are
    dealt out, so that it is not shuffled. A level with a NULL is a level.
    """
    order, sums = random_order(key, seed), {"_pos": F.coalesce(F.col(label), F.lit(0)).cast("long"), "_rows": F.col(label).isNotNull().cast("long")}
    hot, parts, rows = hot_keys(df, codes, hot_floor=hot_floor), list(codes), df
    if hot is not None:
        place = F.conv(F.substring(order, 1, 4), 16, 10).cast("int")
        bucket = F.floor(place * F.coalesce("_fan", F.lit(1)) / 65536).cast("int")
        rows, parts = with_fan(df, hot, codes).withColumn("_bucket", bucket), [*codes, "_bucket"]
        counted = rows.where("_fan IS NOT NULL").groupBy(*parts).agg(*[F.sum(value).alias(name) for name, value in sums.items()])
        earlier = Window.partitionBy(*codes).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        before = counted.select(*[F.col(c).alias(f"_in_{c}") for c in parts], *[F.sum(s).over(earlier).alias(f"_before{s}") for s in sums])
    level = Window.partitionBy(*parts).orderBy("_order", key).rowsBetween(Window.unboundedPreceding, -1)
    dealt = rows.repartition(*parts).withColumn("_order", order)
    summed = dealt.withColumns({name: F.coalesce(F.sum(value).over(level), F.lit(0)) for name, value in sums.items()})
    if hot is not None:  # a few ranges for each hot level
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_in_{c}")) for c in parts])
        summed = summed.join(F.broadcast(before), same, "left")
        summed = summed.withColumns({s: F.col(s) + F.coalesce(f"_before{s}", F.lit(0)) for s in sums})
    encoded = smoothed_mean(F.col("_pos"), F.col("_rows"), F.lit(prior), smoothing)
    return summed.withColumn("encoded", encoded).select(*df.columns, "encoded")


def position_vector(
    rows: DataFrame, key: str, position: str, value: str, size: int, filler: float, out: str = "features"
) -> DataFrame:
    """``(key, out)``: values at positions 1..size as a dense vector, ``filler`` where a position has no row.

    A key has at most one row per position, which bounds the group; two are an error. The vectors of a batch of keys are filled
    at once: an expression or a lambda per position takes Spark over half a millisecond per key at 135 positions.
    """

    @F.pandas_udf("array<double>")
    def placed(places: pd.Series, values: pd.Series) -> pd.Series:
        filled = np.full((len(places), size), float(filler))
        at = np.repeat(np.arange(len(places)), places.map(len).to_numpy()) * size + np.concatenate([[], *places]).astype(int) - 1
        if len(np.unique(at)) < len(at):
            raise ValueError("a key has two values at one position")
        filled.ravel()[at] = np.concatenate([[], *values])
        return pd.Series(list(filled))

    given = F.coalesce(F.col(value).cast("double"), F.lit(float(filler)))  # a list would leave out a NULL
    lists = [F.collect_list(c).alias(name) for name, c in (("_places", F.col(position).cast("int")), ("_values", given))]
    grouped = rows.where(F.col(position).between(1, size)).groupBy(key).agg(*lists)
    return grouped.select(key, array_to_vector(placed("_places", "_values")).alias(out))


def constant_vector(size: int, filler: float) -> Column:
    """The vector of a key without any value."""
    return array_to_vector(F.array_repeat(F.lit(float(filler)), size))
