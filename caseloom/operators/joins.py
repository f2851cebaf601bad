"""Lookup joins that choose a strategy from measured sizes: broadcast, plain shuffle, or salted shuffle."""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 << 20
HOT_SHARE = 1 / 1024
HOT_FLOOR = 1_000_000
HOT_SAMPLE = 20_000_000
#: Hashes by which rows are counted before keys are; many times ``1 / HOT_SHARE``, so that other keys do not fill one.
HOT_PLACES = 16_384
#: Parts of a lookup table that are broadcast, at most.
SMALL_PARTS = 1_000


def _row_bytes(df: DataFrame) -> Column:
    width = F.lit(16 * len(df.columns))
    for name, kind in df.dtypes:
        if kind == "string":
            width = width + F.coalesce(F.octet_length(name), F.lit(0))
    return width.cast("long")


def table_bytes(df: DataFrame) -> int:
    """Measured size of a table: string bytes plus 16 per value."""
    return df.agg(F.sum(_row_bytes(df))).first()[0] or 0


def small_parts(df: DataFrame, part: str, limit: int) -> list:
    """Values of ``part`` whose rows have at most ``limit`` bytes together, those with the fewest bytes first."""
    sizes = df.where(F.col(part).isNotNull()).groupBy(part).agg(F.sum(_row_bytes(df)).alias("_bytes"))
    smallest = sizes.where(F.col("_bytes") <= limit).orderBy("_bytes", part).limit(SMALL_PARTS).collect()
    ends = accumulate(row["_bytes"] for row in smallest)
    return [row[part] for row, end in zip(smallest, ends, strict=True) if end <= limit]


def hot_keys(
    measured: DataFrame, on: list[str], hot_share: float = HOT_SHARE, hot_floor: int = HOT_FLOOR
) -> DataFrame | None:
    """``(on…, _fan)``: the keys above ``max(hot_floor, hot_share * rows)`` rows and over how many tasks to split them.

    Rows are counted by a hash of the key first: where no hash has half as many rows, no key is counted. The keys behind the
    others are recognised in a sample, which only decides a layout: at half the expected count, fewer than ``2 / hot_share``
    keys qualify. None where no key is hot.
    """
    place = F.pmod(F.xxhash64(*on), F.lit(HOT_PLACES)).cast("int")
    placed = {r["_place"]: r["count"] for r in measured.groupBy(place.alias("_place")).count().collect()}  # HOT_PLACES rows at most
    rows = sum(placed.values())
    limit = max(hot_floor, int(rows * hot_share))
    full = [p for p, count in placed.items() if count > limit / 2]
    if rows <= limit or not full:
        return None
    fraction = min(1.0, HOT_SAMPLE / rows)
    keys = measured.select(*on)
    if fraction < 1.0:
        keys = keys.sample(fraction, seed=1)
    keys = keys.where(place.isin(full))
    counted = keys.groupBy(*on).agg(F.count("*").alias("_rows"))
    fan = F.ceil(F.col("_rows") / (limit * fraction)).cast("int").alias("_fan")
    hot = counted.where(F.col("_rows") > limit * fraction / 2).select(*on, fan)
    found = hot.collect()  # fewer than 2 / hot_share rows by the threshold
    return measured.sparkSession.createDataFrame(found, hot.schema) if found else None


def with_fan(side: DataFrame, hot: DataFrame, on: list[str]) -> DataFrame:
    """Add ``_fan`` of the row's key, NULL where it is not hot; NULL keys are keys."""
    renamed = hot.select(*[F.col(k).alias(f"_hot_{k}") for k in on], "_fan")
    same = reduce(lambda a, b: a & b, [side[k].eqNullSafe(renamed[f"_hot_{k}"]) for k in on])
    return side.join(F.broadcast(renamed), same, "left").drop(*[f"_hot_{k}" for k in on])


def lookup_join(
    facts: DataFrame,
    dim: DataFrame,
    on: list[str],
    spread_by: list[str],
    how: str = "left",
    broadcast_bytes: int = BROADCAST_BYTES,
    hot_share: float = HOT_SHARE,
    hot_floor: int = HOT_FLOOR,
    measured: DataFrame | None = None,
    part: str | None = None,
) -> DataFrame:
    """Join a lookup table. It is broadcast only when its measured size allows; beyond that see ``spread_join``.

    ``part``, one of the keys, cuts a table that is too large: its small parts are broadcast while their sizes together allow it,
    and only facts of the others are shuffled. As the facts are then read once for each side, they are not cut where
    ``measured`` says that they are expensive.
    """
    if table_bytes(dim) <= broadcast_bytes:
        return facts.join(F.broadcast(dim), on, how)
    small = small_parts(dim, part, broadcast_bytes) if part and measured is None else []
    if not small:
        return spread_join(facts, dim, on, spread_by, how, hot_share, hot_floor, measured)
    here = F.coalesce(F.col(part).isin(small), F.lit(False))
    near = facts.where(here).join(F.broadcast(dim.where(here)), on, how)
    far = spread_join(facts.where(~here), dim.where(~here), on, spread_by, how, hot_share, hot_floor)
    return near.unionByName(far)


def spread_join(
    facts: DataFrame,
    dim: DataFrame,
    on: list[str],
    spread_by: list[str],
    how: str = "left",
    hot_share: float = HOT_SHARE,
    hot_floor: int = HOT_FLOOR,
    measured: DataFrame | None = None,
) -> DataFrame:
    """Shuffle join that splits every hot key over as many tasks as its own row count asks for.

    A key (NULL included) is hot as ``hot_keys`` says.
    The salt comes from ``spread_by`` columns of the fact row, which keeps retried tasks deterministic; the matching
    lookup rows are repeated once per salt. No row is dropped and cold keys are joined as usual. Rows and keys are counted
    on ``measured``, a cheaper table with the same keys, where ``facts`` itself is expensive.
    """
    if how not in ("left", "inner"):
        raise ValueError("spread_join keeps the fact side: use 'left' or 'inner'")
    hot = hot_keys(facts if measured is None else measured, on, hot_share, hot_floor)
    if hot is None:
        return facts.join(dim, on, how)
    salt = F.pmod(F.xxhash64(*spread_by), F.coalesce("_fan", F.lit(1))).cast("int")
    salted = with_fan(facts, hot, on).withColumn("_salt", salt).drop("_fan")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("_fan", F.lit(1)) - 1))
    repeated = with_fan(dim, hot, on).withColumn("_salt", copies).drop("_fan")
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")
