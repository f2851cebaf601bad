"""Column expressions and small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.session import checkpoint_root, materialize

WORD = r"([^\x20\x09-\x0D]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text, white space being U+0020 and U+0009 to U+000D; none for NULL."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; NULL becomes the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def text_digest(text: str) -> Column:
    """SHA-256 of a text; NULL and the empty text, which are the same document, have the same."""
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def fresh(taken: Iterable[str], name: str) -> str:
    """A column name that clashes with none of ``taken``, whatever its case."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def columns(df: DataFrame) -> list[Column]:
    """All columns, bound to ``df``, whatever their names hold."""
    return [df[f"`{c}`"] for c in df.columns]


def same(left: DataFrame, right: DataFrame, pairs: dict[str, str]) -> Column:
    """Null-safe equality of the paired columns."""
    return reduce(lambda a, b: a & b, [left[a].eqNullSafe(right[b]) for a, b in pairs.items()])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder below the one in ``spark.checkpoint.dir`` that driver and executors share."""
    return f"{checkpoint_root(spark)}/caseloom/{name}"


def arrow_map(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` whose workers find this package where the driver has it, if nothing else ships it to them."""
    environment, root = df.sparkSession.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    paths = [p for p in environment.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        environment["PYTHONPATH"] = ":".join([*paths, root])
    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: int, limit: int = 12 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have up to ``limit`` bytes together; a longer text is a part of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        rows = max(1, int(np.searchsorted(ends[at:], base + limit, "right")))
        yield batch.slice(at, rows)
        at += rows


def range_cuts(df: DataFrame, key: str, shards: int) -> list[float]:
    """Ascending cuts of a numeric key into about equal shards: approximate quantiles, from one scan of the key."""
    keys = df.select(F.col(key).cast("double").alias("key"))
    return sorted(set(keys.approxQuantile("key", [i / shards for i in range(1, shards)], 1 / (4 * shards))))


def range_shards(df: DataFrame, key: str, cuts: list[float], out: str) -> DataFrame:
    """Add the number of cuts at or below the key, 0 for NULL; a projection."""
    from pyspark.ml.feature import Bucketizer  # for the driver alone: workers that import this module stay small

    if not cuts:
        return df.withColumn(out, F.lit(0))
    value = fresh(df.columns, "value")
    infinity = float("inf")
    cast = df.withColumn(value, F.coalesce(F.col(key).cast("double"), F.lit(-infinity)))
    placed = Bucketizer(splits=[-infinity, *cuts, infinity], inputCol=value, outputCol=out).transform(cast)
    return placed.withColumn(out, F.col(out).cast("int")).drop(value)


class Folder:
    """Files of a shared folder, in whatever store its URI names; names become visible only when a file is complete."""

    def __init__(self, uri: str) -> None:
        self.store, self.path = pyarrow.fs.FileSystem.from_uri(uri)

    def make(self) -> None:
        self.store.create_dir(self.path, recursive=True)

    def read(self, name: str):
        return self.store.open_input_file(f"{self.path}/{name}")

    def write(self, name: str):
        return self.store.open_output_stream(f"{self.path}/{name}", compression=None)

    def commit(self, temporary: str, name: str) -> None:
        """Rename. Repeated attempts write the same bytes, so it does not matter which of them is last."""
        self.store.move(f"{self.path}/{temporary}", f"{self.path}/{name}")

    def clear(self) -> None:
        """Delete what failed attempts have left: names that begin with a point. For use once the manifest is there."""
        for info in self.store.get_file_info(pyarrow.fs.FileSelector(self.path)):
            if info.base_name.startswith(".") and info.type == pyarrow.fs.FileType.File and not info.base_name.endswith(".crc"):
                self.store.delete_file(info.path)


def positions(df: DataFrame, group: list[str], order: list[Column], out: str) -> DataFrame:
    """Number the rows of every group 0, 1, 2 … in ``order``; group and order columns may be NULL.

    Rows are spread by ranges of (group, order), so one group may fill many tasks. The sorted rows are written once with
    their partition and place in it; a table with one row per partition and group then gives every range its start.
    Rows equal in ``order`` are interchangeable: their numbers are theirs in some order.
    """
    part, place, first, rows, start = (fresh(df.columns, n) for n in ("part", "place", "first", "rows", "start"))
    keys = [*[F.col(c) for c in group], *order]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    marked = materialize(
        ranged.select(
            "*",
            F.spark_partition_id().alias(part),
            F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias(place),
        )
    )
    heads = marked.groupBy(part, *group).agg(F.min(place).alias(first), F.count("*").alias(rows))
    earlier = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(
        F.col(part),
        *[F.col(c) for c in group],
        (F.coalesce(F.sum(rows).over(earlier), F.lit(0)) - F.col(first)).alias(start),
    )
    heads = heads.toDF("__part", *[f"__group{i}" for i in range(len(group))], start)
    met = same(marked, heads, {part: "__part", **{c: f"__group{i}" for i, c in enumerate(group)}})
    return marked.join(heads, met).select(*columns(marked)[: len(df.columns)], (marked[place] + heads[start]).alias(out))


def one_of_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row of every key, NULL a key like others: of several the one whose columns have the least hash.

    The choice depends on the rows alone, not on their order or partitions; a key with many rows is reduced in every task.
    Maps have no hash and are left out of it.
    """
    hashed = [c for c, kind in zip(columns(rows), rows.dtypes, strict=True) if "map<" not in kind[1]]
    least = F.min_by(F.struct(*columns(rows)), F.struct(F.xxhash64(*hashed), F.hash(*hashed))).alias("__row")
    return rows.groupBy(*[rows[f"`{k}`"] for k in keys]).agg(least).select("__row.*")
