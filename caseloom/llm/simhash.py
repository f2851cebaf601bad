"""SimHash near-duplicates by multi-index hashing.

A fingerprint of 64 bits is cut into two segments. Fingerprints within three bits differ by at most one bit in one of the
segments, so every fingerprint looks up the Hamming ball of radius one around each of its segments in a table of segments.
Full distances are then verified. Segment values that too many share are cut again: the remaining bits have two halves, one
of which differs by at most one bit, and so on, until groups are small. No group is ever compared as a whole beyond that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import arrow_map, columns, fresh, one_of_each, same, slices, text_digest
from caseloom.llm.graph import components
from caseloom.session import materialize

SHINGLE, DISTANCE, SEED = 3, 3, 42
#: Members of a segment's group up to which all of them are compared; larger groups are cut by further bits.
GROUP = 256
#: Text bytes that are split into words at a time.
PIECE = 1 << 20


def shingle_hashes(text: bytes, shingle: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of every run of ``shingle`` words, piece by piece; of all words where there are fewer; none without words."""
    text, at, carried, seen = text.lower(), 0, [], False
    while at < len(text):
        end = min(len(text), at + PIECE)
        while end < len(text) and text[end : end + 1] not in b" \t\n\x0b\x0c\r":
            end += 1
        found = carried + text[at:end].split()
        at = end
        if len(found) >= shingle:
            runs = zip(*[found[i:] for i in range(shingle)], strict=False)
            yield np.array([xxhash.xxh64_intdigest(b" ".join(run), seed) for run in runs], dtype="<u8")
            seen = True
            found = found[len(found) - shingle + 1 :]
        carried = found
    if carried and not seen:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(carried), seed)], dtype="<u8")


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bit i is 1 if it is set in over half of the hashes; without words all bits are 0. As a signed 64-bit integer."""
    ones, total = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, shingle, seed):
        for at in range(0, len(hashes), PIECE >> 4):
            part = hashes[at : at + (PIECE >> 4)]
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
            total += len(part)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def fingerprints(
    docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, digest: bool = False
) -> DataFrame:
    """``doc_id, fp`` per row, computed from whole texts; NULL counts as empty. With ``digest`` also ``sha`` of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, PIECE):
                bodies = part.column(1).cast(pa.binary())
                found = pa.array([fingerprint(b.as_py() or b"", shingle) for b in bodies], pa.int64())
                kept = part.columns[2:]
                yield pa.RecordBatch.from_arrays([part.column(0), found, *kept], names=["doc_id", "fp", "sha"][: 2 + len(kept)])

    kind = docs.schema[id].dataType.simpleString()
    texts = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"), *([text_digest(text).alias("sha")] if digest else []))
    return arrow_map(texts, run, f"doc_id {kind}, fp long" + (", sha binary" if digest else ""))


def cut(rows: DataFrame, width: int) -> DataFrame:
    """Replace ``(key, rest)`` by longer keys: halves of the ``width`` remaining bits, each with its ball of radius one.

    A pair one bit apart meets once, where the member with the bit set looks up the value without it; ``exact`` marks
    table entries, the others are look-ups.
    """
    half = width // 2
    mask = (1 << half) - 1
    low, high = f"rest & {mask}L", f"shiftrightunsigned(rest, {half}) & {mask}L"
    ball = (
        "concat(array(named_struct('v', {v}, 'exact', true)), transform(filter(sequence(0, {top}), i -> getbit({v}, i) = 1),"
        " i -> named_struct('v', ({v}) - shiftleft(1L, i), 'exact', false)))"
    )
    halves = [
        f"transform({ball.format(v=f'({mine})', top=half - 1)}, b -> named_struct("
        f"'key', shiftleft(key, {half + 1}) | {side}L << {half} | b.v, 'rest', {other}, 'exact', b.exact))"
        for side, mine, other in ((0, low, high), (1, high, low))
    ]
    return rows.select("fp", F.expr(f"inline(concat({', '.join(halves)}))"))


def link(members: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges from every fingerprint of a group to the smallest of its component, over pairs within ``distance``."""
    if len(members) == 2:
        a, b = int(members[0]), int(members[1])
        near = ((a ^ b) & (2**64 - 1)).bit_count() <= distance
        return [(min(a, b), max(a, b))] if near else []
    bits = members.view(np.uint64)
    left, edges = np.ones(len(members), bool), []
    while left.any():
        todo = [int(np.flatnonzero(left)[0])]
        left[todo[0]] = False
        found = []
        while todo:
            at = todo.pop()
            found.append(at)
            near = np.flatnonzero(left & (np.bitwise_count(bits ^ bits[at]) <= distance))
            left[near] = False
            todo += near.tolist()
        if len(found) > 1:
            values = members[found]
            root = int(values.min())
            edges += [(root, int(v)) for v in values if v != root]
    return edges


def links(prints: DataFrame, distance: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """``a, b``: edges that connect distinct fingerprints ``fp`` exactly as their pairs within ``distance`` (at most 3) do.

    Every group of a key gives edges to the smallest member of each of its components instead of all its pairs.
    """
    if not 0 <= distance <= 3:
        raise ValueError("two segments with balls of radius one find distances up to 3")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, starts = batch.column(0).flatten().to_numpy(), np.cumsum([0, *batch.column(0).value_lengths().to_pylist()])
            edges = [e for i in range(len(starts) - 1) for e in link(values[starts[i] : starts[i + 1]], distance)]
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])

    rows, width, found = prints.select("fp", F.lit(0).cast("long").alias("key"), F.col("fp").alias("rest")), 64, None
    while True:
        rows = cut(rows, width)
        width //= 2
        sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.count_if("exact").alias("t"))
        live = materialize(rows.join(sizes.where("t >= 1 and n >= 2").drop("t"), "key").select("key", "fp", "rest", "n"))
        last = width <= 4  # keys then have 60 of the 64 bits: groups are small whatever the data
        small = live if last else live.where(F.col("n") <= group)
        small = small.groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps")
        edges = arrow_map(small, run, "a long, b long")
        found = edges if found is None else found.unionByName(edges)
        rows = live.where(F.col("n") > group).select("key", "fp", "rest")
        if last or rows.isEmpty():
            return found


def near_copies(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    distance: int = DISTANCE,
    group: int = GROUP,
) -> DataFrame:
    """Per row of ``docs``: ``doc_id, fp, component_id``, the smallest id that links reach, the row's own included.

    Equal fingerprints are one node, so copies cost nothing. Texts without words, NULL included, have fingerprint zero and
    are linked like any other. NULL ids name no component while another id is there. An empty table gives no rows.
    """
    rows = materialize(fingerprints(docs, id, text, shingle))
    names = groups(rows, distance, group).select(F.col("fp").alias("__fp"), "component_id")
    return rows.join(names, rows["fp"] == names["__fp"]).select("doc_id", "fp", "component_id")


def groups(rows: DataFrame, distance: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """``fp, root, component_id`` of every distinct fingerprint: the group's smallest fingerprint, and its smallest id."""
    prints = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(prints, distance, group)).toDF("__fp", "__root")
    rooted = prints.join(roots, prints["fp"] == roots["__fp"], "left")
    rooted = rooted.select("fp", "least", F.coalesce("__root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return materialize(rooted.join(named, "root").select("fp", "root", "component_id"))


def one_per_group(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, unchanged: one of each group, whatever ids repeat.

    The smallest id of a group stays, NULL last; of rows with that id the one whose text has the least digest; of rows that
    share id and text the one that ``one_of_each`` names.
    """
    rows = materialize(fingerprints(docs, id, text, digest=True))
    names = groups(rows).select(F.col("fp").alias("__fp"), "root")
    rooted = rows.join(names, rows["fp"] == names["__fp"]).select("root", "doc_id", "sha")
    # Rows that repeat a document are counted per task first; the least document of each group is then one row.
    listed = rooted.groupBy("root", "doc_id", "sha").agg(F.count("*").alias("rows"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sha", "rows")).alias("least")
    stays = materialize(listed.groupBy("root").agg(least).select("least.doc_id", "least.sha", "least.rows"))
    chosen = stays.toDF("__id", "__sha", "__rows").hint("merge")  # the same plan at every size
    sha = fresh(docs.columns, "sha")
    hashed = docs.withColumn(sha, text_digest(text))
    kept = hashed.join(chosen, same(hashed, chosen, {id: "__id", sha: "__sha"}), "left_semi")
    if not stays.where("rows > 1").isEmpty():
        kept = one_of_each(kept, [id, sha])
    return kept.select(*columns(kept)[: len(docs.columns)])
