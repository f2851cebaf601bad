"""Token ids in binary files: blocks of ids, transposed into planes, each compressed, with a chunk index.

A file holds the documents of one range of ids in ascending order: a header, the blocks, a table of documents, the index and
a trailer. A block has a fixed number of ids; its planes (the k-th byte, or the k-th bit, of every id) are compressed one by
one with zstandard, and planes without a set bit are left out. The index gives every block's place and the sizes of its
planes, so that any range of ids is read by its blocks alone. A manifest, written last, lists the files.
"""

from __future__ import annotations

import json
import struct
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm.common import Folder, arrow_map, range_cuts, range_shards, shuffle_partitions, slices
from caseloom.llm.text_units import UnitEncoder, loaded

TOKENIZER = "byte_bpe_50k.json"
END = 2
BLOCK = 65536
PLANES = {"byte": 4, "bit": 32}
MAGIC = b"IDPLANE1"
#: magic, ids per block, planes per id
HEADER = struct.Struct("<8sII")
#: blocks, ids, documents, offset and size of the document table, offset and size of the index, magic
TRAILER = struct.Struct("<QQQQQQQ8s")
MANIFEST = "manifest.json"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def to_planes(ids: np.ndarray, planes: int) -> list[bytes]:
    """The planes of a block; empty where no bit is set."""
    parts = ids.view(np.uint8).reshape(-1, 4)
    if planes == 4:
        rows = parts.T
    else:
        rows = np.packbits(np.unpackbits(parts, axis=1, bitorder="little").T, axis=1, bitorder="little")
    return [np.ascontiguousarray(row).tobytes() if row.any() else b"" for row in rows]


def from_planes(rows: list[bytes], count: int, planes: int) -> np.ndarray:
    if planes == 4:
        parts = np.zeros((count, 4), np.uint8)
        for k, row in enumerate(rows):
            if row:
                parts[:, k] = np.frombuffer(row, np.uint8)
        return parts.view("<u4").ravel()
    bits = np.zeros((32, count), np.uint8)
    for k, row in enumerate(rows):
        if row:
            bits[k] = np.unpackbits(np.frombuffer(row, np.uint8), count=count, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u4").ravel()


class Writer:
    """Writes one file, block by block."""

    def __init__(self, sink, planes: int, block: int) -> None:
        self.sink, self.planes, self.block, self.at = sink, planes, block, 0
        self.compress = zstandard.ZstdCompressor(level=3).compress
        self.held, self.held_ids, self.total = [], 0, 0
        self.index, self.docs = [], []
        self.put(HEADER.pack(MAGIC, block, planes))

    def put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc is not None, doc or 0, len(ids)))
        self.total += len(ids)
        while len(ids):
            taken = ids[: self.block - self.held_ids]
            self.held.append(taken)
            self.held_ids += len(taken)
            ids = ids[len(taken) :]
            if self.held_ids == self.block:
                self.flush()

    def flush(self) -> None:
        if not self.held_ids:
            return
        start, sizes = self.at, []
        for plane in to_planes(np.concatenate(self.held).astype("<u4"), self.planes):
            data = self.compress(plane) if plane else b""
            sizes.append(len(data))
            self.put(data)
        self.index.append([start, self.held_ids, *sizes])
        self.held, self.held_ids = [], 0

    def close(self) -> dict:
        self.flush()
        table = np.array(self.docs, "<i8").reshape(-1, 3)
        places = []
        for data in (self.compress(table.tobytes()), self.compress(np.array(self.index, "<i8").tobytes())):
            places += [self.at, len(data)]
            self.put(data)
        self.put(TRAILER.pack(len(self.index), self.total, len(table), *places, MAGIC))
        return {"tokens": self.total, "docs": len(table), "bytes": self.at}


class Reader:
    """Reads a file by its index."""

    def __init__(self, source) -> None:
        self.source = source
        source.seek(source.size() - TRAILER.size)
        blocks, self.total, docs, *places, magic = TRAILER.unpack(source.read(TRAILER.size))
        if magic != MAGIC:
            raise ValueError("not a complete file of id planes")
        self.expand = zstandard.ZstdDecompressor().decompress
        self.docs = np.frombuffer(self.part(*places[:2]), "<i8").reshape(docs, 3)
        source.seek(0)
        _, self.block, self.planes = HEADER.unpack(source.read(HEADER.size))
        self.index = np.frombuffer(self.part(*places[2:]), "<i8").reshape(blocks, 2 + self.planes)

    def part(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.expand(self.source.read(size))

    def read_block(self, k: int) -> np.ndarray:
        start, count, *sizes = self.index[k].tolist()
        self.source.seek(start)
        data, at, rows = self.source.read(sum(sizes)), 0, []
        for size in sizes:
            rows.append(self.expand(data[at : at + size]) if size else b"")
            at += size
        return from_planes(rows, count, self.planes)

    def ids(self, start: int, count: int) -> np.ndarray:
        """Any range of ids, by the blocks that hold it."""
        first, last = start // self.block, (start + count - 1) // self.block
        parts = [self.read_block(k) for k in range(first, last + 1)] if count else []
        return np.concatenate(parts)[start - first * self.block :][:count] if parts else np.empty(0, "<u4")

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """``(doc, start, ids)`` in file order; a block at a time is unpacked."""
        at, k, block = 0, -1, np.empty(0, "<u4")
        for known, doc, count in self.docs.tolist():
            parts, start = [], at
            while at < start + count:
                if at // self.block != k:
                    k = at // self.block
                    block = self.read_block(k)
                inside = at - k * self.block
                parts.append(block[inside : inside + start + count - at])
                at += len(parts[-1])
            yield doc if known else None, start, np.concatenate(parts) if parts else np.empty(0, "<u4")


def encode(docs: DataFrame, id: str, text: str, tokenizer: str, end: int | None) -> tuple[DataFrame, str]:
    """``doc_id, ids`` and the type of an id: the ids of whole texts as little-endian bytes, two each where the vocabulary allows, ``end`` last."""
    from tokenizers import Tokenizer

    size = Tokenizer.from_file(tokenizer).get_vocab_size()
    code = "H" if size <= 1 << 16 else "I"
    kind = "<u2" if max(size, (end or 0) + 1) <= 1 << 16 else "<u4"

    def packed(ids: list[int]) -> bytes:
        return array(code, ids).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(
            ("ids", tokenizer),
            lambda: UnitEncoder(tokenizer, lambda unit, found: packed(found.ids), lambda unit, first, second: first + second, packed),
        )
        for batch in batches:
            for part in slices(batch, 1):
                ids, counts = encoder.packed(pc.fill_null(part.column(1), ""))
                ends, ids = np.cumsum(counts), ids.astype(kind)
                if end is not None:
                    ids = np.insert(ids, ends, end)
                    ends += np.arange(1, len(ends) + 1)
                offsets = np.concatenate([[0], ends * ids.itemsize]).astype("<i4")
                buffers = [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids))]
                out = pa.Array.from_buffers(pa.binary(), part.num_rows, buffers)
                yield pa.RecordBatch.from_arrays([part.column(0), out], names=["doc_id", "ids"])

    texts = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return arrow_map(texts, run, "doc_id long, ids binary"), kind


def write(
    docs: DataFrame,
    folder: str,
    id: str = "doc_id",
    text: str = "text",
    tokenizer: str | None = None,
    end: int | None = END,
    planes: str = "byte",
    block: int = BLOCK,
) -> None:
    """Encode whole texts and write them in ascending order of their integer id, NULL first, to ``folder``.

    NULL texts are empty and hold ``end`` alone. Rows with equal ids stand in the order of their ids' bytes. Other columns
    are not read. An empty table gives a manifest without files. Every shard is written under a temporary name and renamed;
    the manifest, renamed last, makes the shards a table.
    """
    files, count = Folder(folder), PLANES[planes]
    files.make()
    shards = shuffle_partitions(docs.sparkSession)
    encoded, kind = encode(docs, id, text, tokenizer or default_tokenizer(), end)
    # The cuts come from the ids alone, so texts are encoded once and only their ids are shuffled.
    ordered = range_shards(encoded, "doc_id", range_cuts(docs, id, shards), "shard")
    ordered = ordered.repartitionById(shards, F.col("shard")).sortWithinPartitions("doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for batch in batches:
            for doc, ids, shard in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if writer is None:
                    name, temporary = f"ids-{shard:05d}.planes", f".ids-{shard:05d}.{uuid.uuid4().hex}"
                    store = Folder(folder)
                    sink = store.write(temporary)
                    writer = Writer(sink, count, block)
                writer.add(doc, np.frombuffer(ids, kind).astype("<u4"))
        if writer is not None:
            summary = writer.close()
            sink.close()
            store.commit(temporary, name)
            row = [name, summary["docs"], summary["tokens"], summary["bytes"]]
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=["name", "docs", "tokens", "bytes"])

    done = arrow_map(ordered, run, "name string, docs long, tokens long, bytes long")
    listed = sorted(done.collect())  # one row per shard
    start, entries = 0, []
    for row in listed:
        entries.append({**row.asDict(), "start": start})
        start += row["tokens"]
    temporary = f".{MANIFEST}.{uuid.uuid4().hex}"
    with files.write(temporary) as sink:
        sink.write(json.dumps({"tokens": start, "files": entries}).encode())
    files.commit(temporary, MANIFEST)
    files.clear()


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, ids`` of every document of a written folder, one task per file.

    ``start`` counts the ids of all documents before it; ``ids`` are little-endian unsigned 32-bit integers as bytes.
    """
    with Folder(folder).read(MANIFEST) as source:
        entries = json.loads(source.read())["files"]
    rows = [(i, e["name"], e["start"]) for i, e in enumerate(entries)]
    files = spark.createDataFrame(rows, "i int, name string, start long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, name, base in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                with Folder(folder).read(name) as source:
                    part, size = [], 0
                    for doc, start, ids in Reader(source).documents():
                        part.append((doc, base + start, ids.tobytes()))
                        size += 4 * len(ids) + 64
                        if size > 8 << 20:
                            yield rows_batch(part)
                            part, size = [], 0
                    yield rows_batch(part)

    spread = files.repartitionById(max(1, len(rows)), F.col("i"))
    return arrow_map(spread, run, "doc_id long, start long, ids binary")


def rows_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"doc_id": pa.int64(), "start": pa.int64(), "ids": pa.binary()}
    columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())]
    return pa.RecordBatch.from_arrays(columns, names=list(kinds))
