"""Token counts of fields and sections by offset mapping.

A document is encoded once and whole. Each token has a span of characters; sections are spans of the same text; an interval
join assigns tokens to sections. A token that crosses a boundary goes by one rule: to the section of its ``first``,
``middle`` or ``last`` character, or, by ``share``, to every section in proportion to the characters it has there.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from caseloom.llm.bit_planes import default_tokenizer
from caseloom.llm.common import arrow_map, fresh
from caseloom.llm.text_units import UnitEncoder, loaded

RULES = ("first", "middle", "last", "share")
#: Bytes of words and spans that a worker remembers.
BOUND = 384 << 20


def spans_of(unit: str, found) -> bytes:
    """The spans of a unit's tokens, relative to the unit: start and end as 32-bit integers."""
    return array("i", chain.from_iterable(found.offsets)).tobytes()


def spans_of_names(unit: str, names: list[str]) -> bytes:
    """The same for a word of letters up to U+017F from the names of its tokens, which have a character for every byte."""
    ends = list(accumulate(map(len, names)))
    starts = [0, *ends[:-1]]
    if not unit.isascii():
        char = [i for i, c in enumerate(unit) for _ in range(1 if c < "\x80" else 2)]
        starts, ends = [char[b] for b in starts], [char[b - 1] + 1 for b in ends]
    return array("i", chain.from_iterable(zip(starts, ends, strict=True))).tobytes()


def joined_spans(unit: str, first: bytes, second: bytes) -> bytes:
    return first + array("i", [x + len(unit) for x in array("i", second)]).tobytes()


def token_spans(units: list[str], known: list[bytes]) -> np.ndarray:
    """The ``(start, end)`` of every token of a text, in characters of the text."""
    if not units:
        return np.empty((0, 2), np.int64)
    counts = np.fromiter(map(len, known), np.int64, len(known)) // 8
    lengths = np.fromiter(map(len, units), np.int64, len(units))
    spans = np.frombuffer(b"".join(known), "<i4").reshape(-1, 2).astype(np.int64)
    return spans + np.repeat(np.cumsum(lengths) - lengths, counts)[:, None]


def attribute(spans: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """For sections ``[start, end)``: their tokens by the rule, and how many tokens cross one of their boundaries.

    Both are differences of cumulated counts at the two ends of a section, found by binary search.
    """
    first, last = spans[:, 0], np.maximum(spans[:, 1], spans[:, 0] + 1)
    begun, ended = np.sort(first), np.sort(last)

    def crossing(x: np.ndarray) -> np.ndarray:
        return np.searchsorted(begun, x, "left") - np.searchsorted(ended, x, "right")

    if rule == "share":
        density = np.zeros(max(length, int(last.max(initial=0))) + 1)
        np.add.at(density, first, 1 / (last - first))
        np.add.at(density, last, -1 / (last - first))
        total = np.concatenate([[0.0], np.cumsum(np.cumsum(density))])
        counts = total[np.minimum(ends, len(density))] - total[np.minimum(starts, len(density))]
    else:
        at = {"first": first, "last": last - 1, "middle": (first + last - 1) // 2}[rule]
        at = np.sort(at)
        counts = np.searchsorted(at, ends, "left") - np.searchsorted(at, starts, "left")
    # A token that spans a whole section crosses both its ends and is one token.
    around = spanning(first, last, starts, ends) if (crossing(starts) & crossing(ends)).any() else 0
    return counts, np.where(ends > starts, crossing(starts) + crossing(ends) - around, 0)


def spanning(first: np.ndarray, last: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For every section the tokens that begin before it and end behind it.

    Tokens in the order of the text end in that order too; the ones sought are then those between two places. Where a
    tokenizer reports other spans, the sections are gone through one by one.
    """
    order = np.lexsort((last, first))
    first, last = first[order], last[order]
    if (np.diff(last) >= 0).all():
        return np.maximum(0, np.searchsorted(first, starts, "left") - np.searchsorted(last, ends, "right"))
    return np.array([np.count_nonzero((first < a) & (last > b)) for a, b in zip(starts, ends, strict=True)], np.int64)


def lines(text: str) -> tuple[list[int], list[int]]:
    """The lines of a text as spans, each with its line feed."""
    starts, at = [0], text.find("\n")
    while at >= 0:
        starts.append(at + 1)
        at = text.find("\n", at + 1)
    return starts, [*starts[1:], len(text)]


def section_tokens(
    docs: DataFrame,
    sections: DataFrame | None = None,
    id: str = "doc_id",
    text: str = "text",
    rule: str = "first",
    tokenizer: str | None = None,
) -> DataFrame:
    """``doc_id, section, start, end, n_tokens, n_crossing``, a row per section.

    ``sections`` has ``doc_id, section, start, end`` in code points, ``end`` outside; without it, sections are the lines of
    the text, numbered from 0, with their line feeds. Every section is judged alone, so overlapping ones each count what they
    hold; a partition of the text adds up to the tokens of the whole text. Sections without a text, empty ones and NULL
    bounds have 0 tokens; NULL texts are empty and have one empty line. Documents without a row in ``sections`` give none;
    repeated rows of documents or sections are answered each. ``n_crossing`` counts tokens that lie in part in the section.
    Other columns are not read.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {', '.join(RULES)}")
    path = tokenizer or default_tokenizer()
    listed = sections is not None
    number = "double" if rule == "share" else "long"
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    label = "long"
    if listed:
        label = sections.schema["section"].dataType.simpleString()
        item = F.struct("section", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
        grouped = sections.groupBy(F.col("doc_id").alias("__id")).agg(F.sort_array(F.collect_list(item)).alias("__sections"))
        met = grouped.join(rows, grouped["__id"].eqNullSafe(rows["doc_id"]), "left")
        rows = met.select(F.col("__id").alias("doc_id"), "text", "__sections")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(("spans", path), lambda: UnitEncoder(path, spans_of, joined_spans, of_names=spans_of_names, bound=BOUND))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                given = part.column(2).to_pylist() if listed else None
                places, names, bounds, counts, crossed = [], [], [], [], []
                for k, (units, known) in enumerate(encoder.encode(texts)):
                    if given is None:
                        starts, ends = lines(texts[k])
                        names += range(len(starts))
                    else:
                        starts, ends = ([s[b] for s in given[k]] for b in ("start", "end"))
                        names += [s["section"] for s in given[k]]
                    places += [k] * len(starts)
                    bounds += zip(starts, ends, strict=True)
                    length = len(texts[k])
                    low = np.array([0 if a is None or b is None else min(max(a, 0), length) for a, b in zip(starts, ends, strict=True)], "i8")
                    high = np.array([0 if a is None or b is None else min(max(b, 0), length) for a, b in zip(starts, ends, strict=True)], "i8")
                    found = attribute(token_spans(units, known), low, np.maximum(low, high), length, rule)
                    counts.append(found[0])
                    crossed.append(found[1])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(places, pa.int64())),
                        pa.array(names, section_type),
                        pa.array([b[0] for b in bounds], pa.int64()),
                        pa.array([b[1] for b in bounds], pa.int64()),
                        pa.array(np.concatenate(counts) if counts else [], pa.float64() if rule == "share" else pa.int64()),
                        pa.array(np.concatenate(crossed) if crossed else [], pa.int64()),
                    ],
                    names=["doc_id", "section", "start", "end", "n_tokens", "n_crossing"],
                )

    section_type = to_arrow_type(sections.schema["section"].dataType) if listed else pa.int64()
    schema = f"doc_id {kind}, section {label}, start long, end long, n_tokens {number}, n_crossing long"
    return arrow_map(rows, run, schema)


def field_tokens(
    docs: DataFrame, fields: list[str], id: str = "doc_id", separator: str = "\n", rule: str = "first", tokenizer: str | None = None
) -> DataFrame:
    """``section_tokens`` where a document is its ``fields``, joined by ``separator`` and encoded once as one text.

    The section of a field is its name; the separator belongs to the field before it. NULL fields are empty.
    """
    key, body, spans = (fresh(docs.columns, n) for n in ("key", "body", "spans"))
    values = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    lengths = [F.length(v) + (len(separator) if i + 1 < len(fields) else 0) for i, v in enumerate(values)]
    starts = [sum(lengths[:i], F.lit(0)) for i in range(len(fields))]
    # Rows get a key of their own, so that repeated ids keep their own fields.
    keyed = docs.select(
        F.struct(F.col(id), F.monotonically_increasing_id()).alias(key),
        F.concat_ws(separator, *values).alias(body),
        F.array(*[
            F.struct(F.lit(f).alias("section"), a.cast("long").alias("start"), (a + n).cast("long").alias("end"))
            for f, a, n in zip(fields, starts, lengths, strict=True)
        ]).alias(spans),
    )
    sections = keyed.select(F.col(key).alias("doc_id"), F.explode(spans).alias("s")).select("doc_id", "s.*")
    found = section_tokens(keyed, sections, key, body, rule, tokenizer)
    return found.withColumn("doc_id", F.col("doc_id").getField(id))
