"""Reproducible splits and exact-size samples that never sort or shuffle the whole table."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.operators.joins import BROADCAST_BYTES, spread_join, table_bytes
from caseloom.operators.ranks import random_index, random_order

log = logging.getLogger(__name__)

# Seed, test share, rows per class of the balanced set, number of folds.
SEED = 42
TEST_SHARE = 0.2
CLASS_SIZE = 15_000
FOLDS = 3

LITERAL_STRATA = 256


@dataclass(frozen=True)
class Cut:
    """Where to cut the random order of each stratum: the order and key of the last row taken."""

    key: str
    seed: int
    strata: list[str]
    limits: DataFrame
    rows: list = field(default_factory=list)

    def mark(self, df: DataFrame, out: str = "taken") -> DataFrame:
        """Add whether a row lies up to the cut of its stratum. A narrow projection unless there are many strata."""
        place = F.struct(random_order(self.key, self.seed).alias("o"), F.col(self.key).alias("k"))

        def up_to(last_order: Column, last_key: Column) -> Column:
            """One comparison per row; a stratum without a cut has a NULL limit, which sorts before every row."""
            return F.coalesce(place <= F.struct(last_order.alias("o"), last_key.alias("k")), F.lit(False))

        if len(self.rows) <= LITERAL_STRATA:
            key_type = df.schema[self.key].dataType
            last_order, last_key = F.lit(None).cast("string"), F.lit(None).cast(key_type)
            for row in self.rows:
                here = F.lit(True)
                for name in self.strata:
                    here = here & F.col(name).eqNullSafe(F.lit(row[name]))
                last_order = F.when(here, F.lit(row["_last_order"])).otherwise(last_order)
                last_key = F.when(here, F.lit(row["_last_key"]).cast(key_type)).otherwise(last_key)
            return df.withColumn(out, up_to(last_order, last_key))
        stratum = F.struct(*self.strata).alias("_stratum")
        limits = self.limits.select(stratum, "_last_order", "_last_key")
        joined = spread_join(df.select("*", stratum), limits, ["_stratum"], [self.key])
        taken = up_to(F.col("_last_order"), F.col("_last_key"))
        return joined.withColumn(out, taken).drop("_stratum", "_last_order", "_last_key")


def fit_cut(df: DataFrame, key: str, strata: list[str], quota: Column, seed: int = SEED) -> Cut:
    """Find the cut that takes exactly ``quota`` rows of every stratum, the first ones in ``random_order``.

    ``quota`` may use ``stratum_rows``, the size of the stratum; a larger quota takes the whole stratum. A histogram over
    the first hash digits finds the bucket that holds the cut, and only that bucket (one row in 65,536) is ranked. Both
    passes read the key and the strata columns only. ``key`` must be unique.
    """
    base = df.select(*strata, key).withColumn("_order", random_order(key, seed))
    base = base.withColumn("_bucket", F.substring("_order", 1, 4))
    whole = Window.partitionBy(*strata)
    upto = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    histogram = base.groupBy(*strata, "_bucket").agg(F.count("*").alias("_rows"))
    placed = (
        histogram.withColumn("_upto", F.sum("_rows").over(upto))
        .withColumn("stratum_rows", F.sum("_rows").over(whole))
        .withColumn("_quota", F.least(quota, F.col("stratum_rows")).cast("long"))
    )
    before = F.col("_upto") - F.col("_rows")
    cuts = placed.where((F.col("_quota") > before) & (F.col("_quota") <= F.col("_upto")))
    cuts = cuts.select(*strata, "_bucket", (F.col("_quota") - before).alias("_remaining"))
    found = cuts.limit(LITERAL_STRATA + 1).collect()
    if len(found) <= LITERAL_STRATA:
        remaining = F.lit(None).cast("long")
        for row in found:
            here = F.col("_bucket") == row["_bucket"]
            for name in strata:
                here = here & F.col(name).eqNullSafe(F.lit(row[name]))
            remaining = F.when(here, row["_remaining"]).otherwise(remaining)
        candidates = base.withColumn("_remaining", remaining).where(F.col("_remaining").isNotNull())
    else:
        stratum = F.struct(*strata)
        cuts = cuts.select(stratum.alias("_stratum"), "_bucket", "_remaining")
        candidates = base.withColumn("_stratum", stratum).join(cuts, ["_stratum", "_bucket"])
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy("_order", key))
    last = candidates.withColumn("_rank", rank).where(F.col("_rank") == F.col("_remaining"))
    limits = last.select(*strata, F.col("_order").alias("_last_order"), F.col(key).alias("_last_key"))
    rows = limits.limit(LITERAL_STRATA + 1).collect()
    return Cut(key, seed, strata, limits, rows)


def fit_split(df: DataFrame, key: str, strata: list[str], share: float = TEST_SHARE, seed: int = SEED) -> Cut:
    """Test rows of a split: ``ceil(share * rows)`` per stratum, or of the whole table without strata."""
    return fit_cut(df, key, strata, F.ceil(F.round(F.col("stratum_rows") * F.lit(share), 6)), seed)


def split(df: DataFrame, key: str, strata: list[str], share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """Add ``part``: ``test`` or ``train``. Independent of partitioning; the rows themselves are not shuffled."""
    marked = fit_split(df, key, strata, share, seed).mark(df, "_test")
    return marked.withColumn("part", F.when(F.col("_test"), "test").otherwise("train")).drop("_test")


def sample_without(df: DataFrame, key: str, size: int, seed: int = SEED, rows: int | None = None) -> DataFrame:
    """Exactly ``size`` distinct rows; an error when there are fewer. ``rows`` is the row count, where known."""
    rows = df.count() if rows is None else rows
    if rows < size:
        raise ValueError(f"cannot take {size} of {rows} rows without replacement")
    return fit_cut(df, key, [], F.lit(size), seed).mark(df, "_taken").where("_taken").drop("_taken")


def _draw_number(seed: int) -> Column:
    digits = F.substring(F.md5(F.concat(F.col("draw").cast("string"), F.lit(f":draw:{seed}"))), 1, 15)
    return F.conv(digits, 16, 10).cast("long")


def bootstrap(df: DataFrame, key: str, size: int, seed: int = SEED) -> DataFrame:
    """Exactly ``size`` rows drawn with replacement, each with its ``draw`` number from 0.

    Draw d takes row ``md5(d) mod rows`` in ``random_order``. Draws and rows meet through equi-joins on the row index and
    then on the key. A side is broadcast only when its row count times the widest key fits the limit.
    """
    rows, width = df.agg(F.count("*"), F.max(F.octet_length(F.col(key).cast("string")))).first()
    if not rows:
        raise ValueError("cannot draw from an empty table")
    few_draws = size * (width + 32) <= BROADCAST_BYTES
    few_rows = rows * (width + 32) <= BROADCAST_BYTES
    draws = df.sparkSession.range(size).select(F.col("id").alias("draw"))
    draws = draws.withColumn("row_index", _draw_number(seed) % F.lit(rows))
    index = random_index(df.select(key), [], key, seed)
    if few_draws:
        draws = F.broadcast(draws)
    elif few_rows:
        index = F.broadcast(index)
    drawn = index.join(draws, "row_index").select(key, "draw")
    if few_draws:
        drawn = F.broadcast(drawn)
    elif few_rows and table_bytes(df) <= BROADCAST_BYTES:
        df = F.broadcast(df)
    return df.join(drawn, key)


def balanced(
    df: DataFrame, key: str, label: str, size: int = CLASS_SIZE, seed: int = SEED, fall_back: bool = False
) -> DataFrame:
    """``size`` rows of class 0 without replacement and ``size`` rows of class 1 with replacement.

    ``draw`` numbers the drawn rows and is -1 elsewhere, so ``(key, draw)`` is unique. With too few rows of class 0, or
    none of class 1, it is an error, or with ``fall_back`` the input comes back and the decision is logged.
    """
    counts = {row[label]: row["count"] for row in df.where(F.col(label).isin(0, 1)).groupBy(label).count().collect()}
    once = F.lit(-1).cast("long")
    if counts.get(0, 0) < size or not counts.get(1):
        if not fall_back:
            raise ValueError(f"cannot balance classes of {counts} rows to {size} each")
        log.warning("classes of %s rows cannot be balanced to %s each; training on all rows", counts, size)
        return df.withColumn("draw", once)
    majority = sample_without(df.where(F.col(label) == 0), key, size, seed, counts[0]).withColumn("draw", once)
    minority = bootstrap(df.where(F.col(label) == 1), key, size, seed)
    return majority.unionByName(minority)


def shuffled(df: DataFrame, key: str, seed: int = SEED) -> DataFrame:
    """Rows in a reproducible random order. Only for output whose order is read; training does not need it."""
    return df.orderBy(random_order(key, seed), key)


def folds(
    df: DataFrame, key: str, label: str, count: int = FOLDS, seed: int = SEED, out: str = "fold"
) -> DataFrame:
    """Stratified folds 0..count-1, sizes within one row per class; one shuffle, spread evenly by hash bucket."""
    numbered = random_index(df, [label], key, seed, "_index")
    return numbered.withColumn(out, (F.col("_index") % count).cast("int")).drop("_index")
