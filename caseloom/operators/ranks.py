"""Exact order statistics without a global sort: prefix sums over small buckets, ranks only inside a bucket."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.session import materialize

ROWS_PER_BUCKET = 1_000_000
PREFIX = 256


def random_order(key: str, seed: int) -> Column:
    """Reproducible random sort key of a row: md5 of its id and the seed."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def prefix_sums(df: DataFrame, strata: list[str], bucket: str, order: list, totals: dict[str, Column]) -> DataFrame:
    """Add, for every name in ``totals``, the sum of its value over all earlier rows of the stratum.

    ``bucket`` must be ordered like ``order``. One shuffle spreads the rows by bucket; the totals of earlier buckets
    come from a table with one row per bucket.
    """
    stratum = F.struct(*strata) if strata else F.lit(0)  # a struct, so that NULL strata also meet in the join
    rows = df.select("*", stratum.alias("_stratum"), *[value.alias(f"_{name}") for name, value in totals.items()])
    earlier = Window.partitionBy("_stratum").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("_stratum", bucket).agg(*[F.sum(f"_{name}").alias(f"_sum_{name}") for name in totals])
    offsets = offsets.select(
        "_stratum",
        bucket,
        *[F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in totals],
    )
    inside = Window.partitionBy("_stratum", bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.select("*", *[F.coalesce(F.sum(f"_{n}").over(inside), F.lit(0)).alias(f"_inside_{n}") for n in totals])
    keep = [F.col(c) for c in df.columns]
    return local.join(offsets, ["_stratum", bucket]).select(
        *keep, *[(F.col(f"_before_{n}") + F.col(f"_inside_{n}")).alias(n) for n in totals]
    )


def random_index(df: DataFrame, strata: list[str], key: str, seed: int, out: str = "row_index") -> DataFrame:
    """Number the rows of each stratum 0, 1, 2 … in ``random_order``; ``key`` must be unique."""
    hashed = df.withColumn("_order", random_order(key, seed)).withColumn("_bucket", F.substring("_order", 1, 4))
    numbered = prefix_sums(hashed, strata, "_bucket", ["_order", key], {out: F.lit(1).cast("long")})
    return numbered.drop("_order", "_bucket")


def value_bucket(
    df: DataFrame, value: str, out: str = "_bucket", rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Add an order-preserving bucket of a numeric column, about ``rows_per_bucket`` rows each."""
    buckets = df.count() // rows_per_bucket
    if buckets < 2:
        return df.withColumn(out, F.lit(0.0))
    shares = [i / buckets for i in range(1, buckets)]
    cuts = sorted(set(df.approxQuantile(value, shares, 1 / (4 * buckets))))
    splits = [-float("inf"), *[c for c in cuts if abs(c) != float("inf")], float("inf")]
    if len(splits) < 3:
        return df.withColumn(out, F.lit(0.0))
    return Bucketizer(splits=splits, inputCol=value, outputCol=out, handleInvalid="keep").transform(df)


def text_bucket(df: DataFrame, value: str, out: str = "_bucket", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Add an order-preserving bucket of a text column, about ``rows_per_bucket`` rows each.

    Spark deals the rows out by ranges of the first ``PREFIX`` characters, which bounds what its sample of keys holds; the
    number of a range is the bucket. The rows are written once, so that every reader sees the same buckets. Ranks stay exact.
    """
    buckets = df.count() // rows_per_bucket
    if buckets < 2:
        return df.withColumn(out, F.lit(0))
    return materialize(df.repartitionByRange(buckets, F.left(F.col(value), F.lit(PREFIX))).withColumn(out, F.spark_partition_id()))


def running_totals(
    df: DataFrame, value: str, totals: dict[str, Column], rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """One row per distinct value with the sums in ``totals`` and, as ``before_<name>``, over all smaller values."""
    base = df.select(F.col(value).cast("double").alias(value), *[c.alias(n) for n, c in totals.items()])
    base = value_bucket(base.where(F.col(value).isNotNull()), value, "_bucket", rows_per_bucket)
    distinct = base.groupBy("_bucket", value).agg(*[F.sum(n).alias(n) for n in totals])
    before = {f"before_{n}": F.col(n) for n in totals}
    return prefix_sums(distinct, [], "_bucket", [value], before).drop("_bucket")


def exact_quantiles(
    df: DataFrame, value: str, probabilities: dict[str, float], rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """One row with linearly interpolated quantiles, named by the keys of ``probabilities``."""
    rows = df.where(F.col(value).isNotNull()).count()
    ranked = running_totals(df, value, {"rows": F.lit(1).cast("long")}, rows_per_bucket)

    def value_at(position: int) -> Column:
        inside = (F.col("before_rows") <= position) & (position < F.col("before_rows") + F.col("rows"))
        return F.max(F.when(inside, F.col(value)))

    columns = []
    for name, share in probabilities.items():
        place = share * (rows - 1) if rows else 0.0
        low, part = int(place), place - int(place)
        exact = value_at(low)
        between = exact + (value_at(low + 1) - exact) * part
        columns.append((between if part else exact).alias(name))
    return ranked.agg(*columns)
