"""Exact deduplication by an extendible-hash index on shared files.

Keys are SHA-256 prefixes of normalised texts. The high bits of a key name its owner task, so an owner holds one range of
keys. Owners receive their keys in order and load buckets one after the other: an overfull bucket splits by the next bit,
which doubles the directory where the bucket had its full depth, and a bucket is written when the keys have passed it. Equal
keys form a chain whose texts are compared byte by byte. Memory holds one bucket, whatever the size of the range.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from caseloom.llm.common import arrow_map, columns, fresh, lower_ascii, one_of_each, same, shuffle_partitions
from caseloom.session import materialize

#: Entries of a bucket before it splits.
CAPACITY = 4096
#: Bits of a key that may address buckets; a bucket of this depth chains whatever it gets.
MAX_DEPTH = 60
#: Bytes of texts that a scanning task holds back to merge copies, and of an output batch.
HELD, BATCH = 32 << 20, 8 << 20


def key_column(text: Column, bits: int) -> Column:
    """The first ``bits`` bits (a multiple of 4) of the SHA-256 of a normalised text, in hex."""
    return F.substring(F.sha2(lower_ascii(text), 256), 1, bits // 4)


def owner_bits(partitions: int) -> int:
    """Owners are the largest power of two that is not above the number of shuffle partitions."""
    return max(1, partitions).bit_length() - 1


def head(key: str) -> int:
    """The first 64 bits of a key in hex, which address buckets."""
    return int(key[:16].ljust(16, "0"), 16)


def merge_copies(batches: Iterator[pa.RecordBatch], bits: int, depth: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """In a scanning task: one row per distinct text and ``HELD`` bytes, with its largest id and its row counts."""
    held: dict[bytes, list] = {}
    weight = 0

    def rows() -> Iterator[pa.RecordBatch]:
        part, size = [], 0
        for body, (top, n, n_top) in held.items():
            key = hashlib.sha256(body).hexdigest()[: bits // 4]
            part.append((head(key) >> (64 - depth), key, body, top, n, n_top))
            size += len(body) + 64
            if size > BATCH:
                yield batch_of(part, schema)
                part, size = [], 0
        if part:
            yield batch_of(part, schema)

    for batch in batches:
        ids = batch.column(0).to_pylist()
        for id, body in zip(ids, batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            body = (body or b"").lower()  # bytes.lower changes A-Z only
            found = held.get(body)
            if found is None:
                held[body] = [id, 1, 1]
                weight += len(body) + 200
            else:
                add(found, id, 1, 1)
            if weight > HELD:
                yield from rows()
                held, weight = {}, 0
    yield from rows()


def add(found: list, id, n: int, n_top: int) -> None:
    """Merge the largest id, the rows, and the rows that have this id; NULL is below every id."""
    found[1] += n
    if id == found[0]:
        found[2] += n_top
    elif id is not None and (found[0] is None or id > found[0]):
        found[0], found[2] = id, n_top


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class Loader:
    """Buckets of one key range, filled in key order; ``bucket`` and ``depth`` name the prefix that a bucket covers."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.bucket, self.depth, self.entries = 0, -1, []
        self.pending: list[tuple[int, int]] = []

    def covers(self, at: int) -> bool:
        return self.depth >= 0 and at >> (64 - self.depth) == self.bucket

    def move(self, at: int, owner: int, depth: int) -> list[tuple]:
        """Make the bucket of ``at`` the current one; return the entries of the bucket that this completes."""
        if self.covers(at):
            return []
        done = self.flush()
        while self.pending:  # siblings that splits left behind, the nearest last; those passed over stay empty
            self.bucket, self.depth = self.pending.pop()
            if self.covers(at):
                return done
        self.bucket, self.depth, self.pending = owner, depth, []
        return done

    def split(self, at: int) -> list[tuple]:
        """Split the current bucket by one more bit; it keeps the half that ``at``, the last key, lies in."""
        self.depth += 1
        low = self.bucket << 1
        if at >> (64 - self.depth) == low:  # all entries are at or below the last key
            self.pending.append((low + 1, self.depth))
            self.bucket = low
            return []
        left = [e for e in self.entries if e[0] >> (64 - self.depth) == low]
        right = self.entries[len(left) :]
        self.bucket, self.entries = low, left
        done = self.flush()
        self.bucket, self.entries = low + 1, right
        return done

    def flush(self) -> list[tuple]:
        done = [(self.bucket, self.depth, *e[1:]) for e in self.entries]
        self.entries = []
        return done


def load_range(batches: Iterator[pa.RecordBatch], depth: int, capacity: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """In an owner task: rows ``(owner, key, body, top, n, n_top)`` in key order become index entries."""
    loader, chain, current = Loader(capacity), [], None

    def place() -> list[tuple]:
        """Put the finished chain into its bucket; return the entries of buckets that are complete."""
        owner, key = current
        at = head(key)
        done = loader.move(at, owner, depth)
        loader.entries += [(at, key, i, len(chain), *entry) for i, entry in enumerate(chain)]
        while len(loader.entries) > loader.capacity and loader.depth < MAX_DEPTH:
            if loader.entries[0][0] >> (64 - MAX_DEPTH) == at >> (64 - MAX_DEPTH):
                break  # no bit within MAX_DEPTH divides these entries: they stay one bucket
            done += loader.split(at)
        return done

    for batch in batches:
        for owner, key, body, top, n, n_top in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if current is not None and key != current[1]:
                yield from batches_of(place(), schema)
                chain = []
            current = (owner, key)
            for entry in chain:
                if entry[0] == body:
                    found = entry[1:]
                    add(found, top, n, n_top)
                    entry[1:] = found
                    break
            else:
                chain.append([body, top, n, n_top])
    if current is not None:
        yield from batches_of(place() + loader.flush(), schema)


def batches_of(entries: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    at = 0
    while at < len(entries):
        end, size = at, 0
        while end < len(entries) and size <= BATCH:
            size += len(entries[end][5])
            end += 1
        yield batch_of(entries[at:end], schema)
        at = end


def build_index(
    docs: DataFrame, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, bits: int = 256
) -> DataFrame:
    """Write the index and return it: ``bucket, depth, key, chain, chained, body, keep_id, group_size, n_top``.

    One row per distinct text: ``chain`` is its place among the ``chained`` texts of its key, ``keep_id`` its largest id,
    ``n_top`` the rows that have it. Copies are merged where they are read, so a text reaches its owner about once per
    scanning task. Spark's writer commits the owners' files, so a lost or repeated task leaves nothing behind.
    """
    kind = docs.schema[id].dataType
    partitions = shuffle_partitions(docs.sparkSession)
    depth = min(owner_bits(partitions), bits)
    sent = pa.schema([
        ("owner", pa.int64()), ("key", pa.string()), ("body", pa.binary()), ("top", to_arrow_type(kind)),
        ("n", pa.int64()), ("n_top", pa.int64()),
    ])
    kept = pa.schema([
        ("bucket", pa.int64()), ("depth", pa.int32()), ("key", pa.string()), ("chain", pa.int32()),
        ("chained", pa.int32()), ("body", pa.binary()), ("keep_id", to_arrow_type(kind)), ("group_size", pa.int64()),
        ("n_top", pa.int64()),
    ])
    name = kind.simpleString()
    merged = arrow_map(
        docs.select(F.col(id).alias("id"), F.col(text).alias("text")),
        lambda batches: merge_copies(batches, bits, depth, sent),
        f"owner long, key string, body binary, top {name}, n long, n_top long",
    )
    owned = merged.repartitionById(1 << depth, F.col("owner").cast("int")).sortWithinPartitions("key")
    loaded = arrow_map(
        owned,
        lambda batches: load_range(batches, depth, capacity, kept),
        f"bucket long, depth int, key string, chain int, chained int, body binary, keep_id {name}, group_size long, n_top long",
    )
    return materialize(loaded)


def directory(index: DataFrame) -> DataFrame:
    """Buckets with the slots of the doubled directory that point to them: ``first_slot`` and ``slots``, and their size.

    The directory has ``2 ** global_depth`` slots; slots without a row are empty.
    """
    buckets = index.groupBy("bucket", "depth").agg(F.count("*").alias("entries"))
    deepest = index.agg(F.max("depth")).first()[0]
    step = F.expr(f"shiftleft(1L, {deepest or 0} - depth)")
    return buckets.select(
        "bucket", "depth", F.lit(deepest).alias("global_depth"), (F.col("bucket") * step).alias("first_slot"),
        step.alias("slots"), "entries",
    )


def look_up(docs: DataFrame, index: DataFrame, id: str = "doc_id", text: str = "text", bits: int = 256) -> DataFrame:
    """``doc_id, text_sha256, keep_id, group_size, n_top`` per row of ``docs``.

    A key with one text needs no more than the key. Keys with a chain compare the normalised texts.
    """
    rows = docs.select(
        F.col(id).alias("doc_id"), F.sha2(lower_ascii(F.col(text)), 256).alias("text_sha256"), F.col(text).alias("__text")
    ).withColumn("key", F.substring("text_sha256", 1, bits // 4))
    keys = index.select("key", "keep_id", "group_size", "n_top", "chained")
    out = ["doc_id", "text_sha256", "keep_id", "group_size", "n_top"]
    found = rows.drop("__text").join(keys.where("chained = 1"), "key").select(*out)
    if index.where("chained > 1").isEmpty():
        return found
    chains = index.where("chained > 1").select("key", "keep_id", "group_size", "n_top", F.decode("body", "utf-8").alias("__body"))
    bodies = rows.withColumn("__body", lower_ascii(F.col("__text"))).join(chains, ["key", "__body"])
    return found.unionByName(bodies.select(*out))


def exact_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, bits: int = 256) -> DataFrame:
    """Per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are the same bytes after lower-casing A-Z; NULL counts as the empty text. The largest id of
    a group stays; a NULL id only where a group has no other. Rows that repeat the staying id are one document and all
    marked. ``group_size`` counts rows. An empty table gives no rows. Other columns are not read.
    """
    index = build_index(docs, id, text, capacity, bits)
    found = look_up(docs, index, id, text, bits)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one per distinct text, unchanged.

    Of rows that share the staying id and the text, ``one_of_each`` names the one.
    """
    index = build_index(docs, id, text)
    stays = look_up(docs, index, id, text).where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    stays = materialize(stays.select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")).distinct())
    stays = stays.hint("merge")  # the same plan at every size
    sha = fresh(docs.columns, "sha")
    hashed = docs.withColumn(sha, F.sha2(lower_ascii(F.col(text)), 256))
    repeated = not index.where("n_top > 1").isEmpty()
    if not repeated and index.agg(F.sum("group_size")).first()[0] == docs.select(id).distinct().count():
        return docs.join(stays, same(docs, stays, {id: "__id"}), "left_semi")  # ids name rows
    kept = hashed.join(stays, same(hashed, stays, {id: "__id", sha: "__sha"}), "left_semi")
    if repeated:
        kept = one_of_each(kept, [id, sha])
    return kept.select(*columns(kept)[: len(docs.columns)])
