"""Web archives: a deterministic sharded writer and its reader.

Records are sorted by page id within ranges of it; every range is one task that writes files of gzip members and rolls them by
compressed size. Headers, digests and record ids are made anew from the payload alone, so any attempt writes the same bytes.
Files get their names when they are complete, and a manifest, renamed last, makes them an archive. Of equal payloads one is
stored as a response; the others are revisit records that point to it.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm.common import Folder, arrow_map, range_cuts, range_shards, shuffle_partitions

MANIFEST = "manifest.json"
ROLL = 1 << 30
#: Payloads below this many bytes are stored each time.
REVISITED = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:page-record")
CHUNK = 1 << 20
#: Characters that a target URI keeps; a URL with others is also stored as it was.
PLAIN = "/:?#[]@!$&'()*+,;=~%"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page: int | None, payload_digest: str, place: int) -> str:
    """The id of the ``place``-th record of a page with a payload."""
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page}:{payload_digest}:{place}')}>"


def headers(pairs: list[tuple[str, object]]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in pairs if v is not None).encode()


def record(page: int | None, url: str | None, payload: bytes, place: int, revisits: tuple | None) -> bytes:
    """One record. ``revisits`` is ``(page id of the response,)`` for a revisit, which has HTTP headers but no payload."""
    sha = digest(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + headers([("Content-Length", len(payload))]) + b"\r\n"
    block = http if revisits else http + payload
    return (
        b"WARC/1.1\r\n"
        + headers([
            ("WARC-Type", "revisit" if revisits else "response"),
            ("WARC-Record-ID", record_id(page, sha, place)),
            ("WARC-Date", DATE),
            ("WARC-Target-URI", None if url is None else quote(url, safe=PLAIN)),
            ("WARC-Source-URL", None if url is None or quote(url, safe=PLAIN) == url else base64.b64encode(url.encode()).decode()),
            ("WARC-Page-ID", page),
            ("WARC-Profile", PROFILE if revisits else None),
            ("WARC-Refers-To", record_id(revisits[0], sha, 0) if revisits else None),
            ("WARC-Refers-To-Page-ID", revisits[0] if revisits else None),
            ("WARC-Payload-Digest", sha),
            ("WARC-Block-Digest", digest(block)),
            ("Content-Type", "application/http; msgtype=response"),
            ("Content-Length", len(block)),
        ])
        + b"\r\n" + block + b"\r\n\r\n"
    )


class Roller:
    """The files of one shard."""

    def __init__(self, store: Folder, shard: int, limit: int) -> None:
        self.store, self.shard, self.limit = store, shard, limit
        self.files, self.sink = [], None

    def add(self, data: bytes) -> None:
        """One gzip member; a file that would grow beyond the limit is closed first."""
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = pack.compress(data) + pack.flush()
        if self.sink is not None and self.size + len(member) > self.limit:
            self.close()
        if self.sink is None:
            self.name = f"pages-{self.shard:05d}-{len(self.files):05d}.warc.gz"
            self.temporary = f".{self.name}.{uuid.uuid4().hex}"
            self.sink, self.size, self.records, self.sha = self.store.write(self.temporary), 0, 0, hashlib.sha256()
        self.sink.write(member)
        self.sha.update(member)
        self.size += len(member)
        self.records += 1

    def close(self) -> None:
        if self.sink is not None:
            self.sink.close()
            self.store.commit(self.temporary, self.name)
            self.files.append((self.name, self.records, self.size, self.sha.hexdigest()))
            self.sink = None


def write(pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", html: str = "html", roll: int = ROLL) -> None:
    """Write a record per row of ``pages`` in ascending order of its integer id, NULL first, to ``folder``.

    The payload is the html in UTF-8; NULL is empty. Of records with equal payloads of at least ``REVISITED`` bytes, the one
    with the largest id is the response, of equal ids the first in order of digest and url; the others revisit it. A NULL id
    is below every id. Other columns are not read. An empty table gives a manifest without files.
    """
    files = Folder(folder)
    files.make()
    shards = shuffle_partitions(pages.sparkSession)
    body = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id).cast("long").alias("page"), F.col(url).alias("url"), body.alias("body"))
    key = F.when(F.octet_length("body") >= REVISITED, F.sha2("body", 256))
    keys = rows.select("page", key.alias("key")).where("key is not null")
    repeated = keys.groupBy("key").agg(F.max("page").alias("keep"), F.count("*").alias("n")).where("n > 1")
    # Only ids and digests are joined. The verdicts go to the range of their page and meet the payload there.
    verdicts = keys.join(repeated, "key").select("page", F.lit(0).alias("kind"), "key", "keep", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("body"))
    records = rows.select("page", F.lit(1).alias("kind"), key.alias("key"), F.lit(None).cast("long").alias("keep"), "url", "body")
    both = verdicts.distinct().unionByName(records)
    placed = range_shards(both, "page", range_cuts(pages, id, shards), "shard")
    ordered = placed.repartitionById(shards, F.col("shard")).sortWithinPartitions("page", "kind", "key", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, at, keeps, written = None, (), {}, {}
        for batch in batches:
            for page, kind, key, keep, address, body, shard in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if roller is None:
                    roller = Roller(Folder(folder), shard, roll)
                if at != (page,):
                    at, keeps, written = (page,), {}, {}
                if kind == 0:
                    keeps[key] = keep
                    continue
                again = key is not None and key in keeps and (keeps[key] != page or key in written)
                name = key or body
                place = written.get(name, 0)
                written[name] = place + 1
                roller.add(record(page, address, body, place, (keeps[key],) if again else None))
        if roller is not None:
            roller.close()
            columns = list(zip(*roller.files, strict=True)) or [()] * 4
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["name", "records", "bytes", "sha256"]
            )

    done = arrow_map(ordered, run, "name string, records long, bytes long, sha256 string")
    listed = [row.asDict() for row in sorted(done.collect())]  # one row per file
    temporary = f".{MANIFEST}.{uuid.uuid4().hex}"
    with files.write(temporary) as sink:
        sink.write(json.dumps({"files": listed}).encode())
    files.commit(temporary, MANIFEST)
    files.clear()


def members(source) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    rest = b""
    while True:
        expand, parts = zlib.decompressobj(31), []
        while not expand.eof:
            rest = rest or source.read(CHUNK)
            if not rest:
                if parts:
                    raise ValueError("the archive ends within a record")
                return
            parts.append(expand.decompress(rest))
            rest = expand.unused_data if expand.eof else b""
        yield b"".join(parts)


def parse(data: bytes) -> tuple:
    """``page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload`` of a record, digests verified."""
    top, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in top.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    if digest(block) != fields["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    kind, sha = fields["WARC-Type"], fields["WARC-Payload-Digest"]
    if kind == "response" and digest(payload) != sha:
        raise ValueError(f"damaged payload in {fields['WARC-Record-ID']}")
    length = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    number = {k: None if fields.get(k) in (None, "None") else int(fields[k]) for k in ("WARC-Page-ID", "WARC-Refers-To-Page-ID")}
    address = fields.get("WARC-Target-URI")
    if "WARC-Source-URL" in fields:
        address = base64.b64decode(fields["WARC-Source-URL"]).decode()
    return (
        number["WARC-Page-ID"],
        address,
        length,
        base64.b32decode(sha.removeprefix("sha1:")).hex(),
        kind,
        number["WARC-Refers-To-Page-ID"],
        payload,
    )


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the files in the manifest, a task per file; a revisit's payload is NULL."""
    with Folder(folder).read(MANIFEST) as source:
        names = [f["name"] for f in json.loads(source.read())["files"]]
    files = spark.createDataFrame(list(enumerate(names)), "i int, name string")
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    labels = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            return pa.RecordBatch.from_arrays(columns[: 7 if payloads else 6], names=labels[: 7 if payloads else 6])

        for batch in batches:
            for name in batch.column(1).to_pylist():
                with Folder(folder).read(name) as source:
                    rows, size = [], 0
                    for data in members(source):
                        row = parse(data)
                        rows.append((*row[:6], row[6] if payloads and row[4] == "response" else None))
                        size += (len(row[6]) if payloads else 0) + 200
                        if size > 8 << 20:
                            yield batch_of(rows)
                            rows, size = [], 0
                    yield batch_of(rows)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    spread = files.repartitionById(max(1, len(names)), F.col("i"))
    return arrow_map(spread, run, schema + (", payload binary" if payloads else ""))
