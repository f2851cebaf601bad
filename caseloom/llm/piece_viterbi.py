"""SentencePiece encoding by an Aho-Corasick automaton over the pieces and one pass over the text.

At every position the automaton names the pieces that end there, longest first, along its output links. For unigram models
the pass is a Viterbi search: each of these pieces relaxes the best score of the position. For BPE models (the public model
file is one) no sum of scores gives the merges' result; there an arc is admitted only where merging would leave its boundary
alone, which holds exactly if the last piece before it and the piece itself, joined and merged anew, come out as the two.
Exactly one admitted arc enters a reachable position, so the same pass yields the ids of the merges without merging the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import arrow_map
from caseloom.llm.text_units import ENTRY, REMEMBERED, Memory, loaded

MODEL = "piece_bpe_32k.model"
MARK = "▁"
UNIGRAM, BPE = 1, 2
#: What an unknown character scores below the worst piece in a unigram model.
PENALTY = 10.0
#: Bytes of units and ids that a worker remembers.
BOUND = 256 << 20


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a serialised protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def model_type(data: bytes) -> int:
    """The kind of model that the trainer settings name; unigram where they name none."""
    trainer = next((v for k, v in fields(data) if k == 2), b"")
    return next((v for k, v in fields(trainer) if k == 3), UNIGRAM)


class Pieces:
    """The pieces of a model, their automaton, and what encoding and decoding need."""

    def __init__(self, data: bytes) -> None:
        self.library = model = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.kind = model_type(data)
        self.ids, self.scores, self.bytes, self.raw = {}, {}, {}, []
        for id in range(model.get_piece_size()):
            piece = model.id_to_piece(id)
            self.raw.append(b"" if model.is_control(id) else piece.replace(MARK, " ").encode())
            if model.is_byte(id):
                self.raw[id] = bytes([int(piece[3:5], 16)])
                self.bytes[int(piece[3:5], 16)] = id
            elif not (model.is_control(id) or model.is_unknown(id) or model.is_unused(id)):
                self.ids[piece] = id
                self.scores[id] = model.get_score(id)
        self.unknown = model.unk_id()
        self.raw[self.unknown] = " ⁇ ".encode()
        self.worst = min(self.scores.values(), default=0.0) - PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, id in self.ids.items():
            self.automaton.add_word(piece, (id, len(piece)))
        self.automaton.make_automaton()
        # Where no piece has a mark after another character, none crosses the start of a run of marks.
        whole = any(MARK in piece.lstrip(MARK) for piece in self.ids)
        self.unit = re.compile(r".+", re.S) if whole else re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.dummy = model.normalize("a").startswith(MARK)
        letters = {c for piece in self.ids for c in piece}
        closed = all(c in self.ids for c in letters)
        if self.kind not in (UNIGRAM, BPE) or self.kind == BPE and not closed:
            raise ValueError("unigram models, and BPE models whose characters are all pieces, can be searched")
        self.foreign = re.compile(f"[^{re.escape(''.join(sorted(letters)))}]")
        self.names = {id: piece for piece, id in self.ids.items()}
        self.memory = Memory(self.remembered, BOUND)
        self.admitted: dict[int, bool] = {}

    def merged(self, symbols: str) -> list[str]:
        """Merge characters as BPE does: always the adjacent pair with the best score, the leftmost among equals."""
        parts = list(symbols)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                id = self.ids.get(parts[i] + parts[i + 1])
                if id is not None and (best is None or self.scores[id] > best):
                    best, at = self.scores[id], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def admits(self, before: str, piece: str) -> bool:
        """Whether merging leaves the boundary between two pieces alone; with nothing before, whether the piece forms."""
        return self.merged(before + piece) == ([before, piece] if before else [piece])

    def admission(self, before: int, id: int) -> bool:
        """``admits`` by ids, remembered; ``before`` is -1 at the start."""
        if len(self.admitted) * ENTRY > REMEMBERED:
            self.admitted.clear()
        found = self.admits(self.names.get(before, ""), self.names[id])
        self.admitted[(before + 1 << 32) + id] = found
        return found

    def merges(self, unit: str) -> list[tuple[int, int, int]]:
        """The path of a BPE model through characters that are all pieces, as ``(id, start, end)``."""
        n, admitted = len(unit), self.admitted
        last, begin, reached = [-1] * (n + 1), [0] * (n + 1), 0
        for end, (id, length) in self.automaton.iter(unit):
            end += 1
            if end == reached:
                continue  # the position has its arc
            start = end - length
            key = (last[start] + 1 << 32) + id
            if admitted[key] if key in admitted else self.admission(last[start], id):
                last[end], begin[end], reached = id, start, end
        path, end = [], n
        while end > 0:
            path.append((last[end], begin[end], end))
            end = begin[end]
        return path[::-1]

    def scored(self, unit: str) -> list[tuple[int, int, int]]:
        """The path of best score in a unigram model; unknown characters are arcs of their own."""
        ending: list[list[tuple[int, int]]] = [[] for _ in range(len(unit) + 1)]
        for end, found in self.automaton.iter(unit):
            ending[end + 1].append(found)
        best, begin = [0.0] + [float("-inf")] * len(unit), [(-1, 0)] * (len(unit) + 1)
        for end in range(1, len(unit) + 1):
            if unit[end - 1] not in self.ids:
                ending[end].append((self.unknown, 1))
            for id, length in ending[end]:
                score = best[end - length] + self.scores.get(id, self.worst)
                if score > best[end]:
                    best[end], begin[end] = score, (id, end - length)
        path, end = [], len(unit)
        while end > 0:
            id, start = begin[end]
            path.append((id, start, end))
            end = start
        return path[::-1]

    def segment(self, unit: str) -> list[tuple[int, int, int]]:
        """The pieces of a unit as ``(id, start, end)``. No merge reaches over a character that no piece has."""
        if self.kind == UNIGRAM:
            return self.scored(unit)
        path, at = [], 0
        for gap in self.foreign.finditer(unit):
            path += [(id, at + a, at + b) for id, a, b in self.merges(unit[at : gap.start()])] if gap.start() > at else []
            path.append((self.unknown, gap.start(), gap.end()))
            at = gap.end()
        rest = self.merges(unit[at:]) if at < len(unit) else []
        return path + [(id, at + a, at + b) for id, a, b in rest] if at else rest

    def remembered(self, unit: str) -> bytes:
        ids = []
        for id, start, end in self.segment(unit):
            if id != self.unknown:
                ids.append(id)
            elif self.bytes:
                ids += [self.bytes[b] for b in unit[start:end].encode()]
            elif not ids or ids[-1] != id:
                ids.append(id)  # a run of unknown characters is one unknown id
        return np.array(ids, "<i4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        return b"".join([self.memory[u] for u in self.unit.findall(self.library.normalize(text))])

    def decode(self, ids: list[int]) -> str:
        text = b"".join([self.raw[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.dummy and text.startswith(" ") else text


@lru_cache(1)
def read(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode(docs: DataFrame, id: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """``doc_id, ids, n_tokens, round_trip`` per row of ``docs``, from whole texts.

    ``round_trip`` tells whether the decoded ids give the text again; NULL counts as the empty text, which has no ids.
    NULL ids and repeated rows stay as they are; an empty table gives no rows. ``model`` is a SentencePiece model file that
    the driver can read; its bytes go to the tasks. Texts never leave their task, so nothing is shuffled.
    """
    data = read(model or default_model())
    key = ("pieces", hash(data))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(key, lambda: Pieces(data))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [t or "" for t in part.column(1).to_pylist()]
                found = [np.frombuffer(pieces.encode(t), "<i4") for t in texts]
                back = [pieces.decode(ids.tolist()) == t for ids, t in zip(found, texts, strict=True)]
                counts = np.array([len(ids) for ids in found], "i8")
                flat = pa.array(np.concatenate(found) if found else np.empty(0, "i4"))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), lists, pa.array(counts), pa.array(back, pa.bool_())],
                    names=["doc_id", "ids", "n_tokens", "round_trip"],
                )

    kind = docs.schema[id].dataType.simpleString()
    texts = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    return arrow_map(texts, run, f"doc_id {kind}, ids array<int>, n_tokens long, round_trip boolean")


def decode(tokens: DataFrame, id: str = "doc_id", ids: str = "ids", model: str | None = None) -> DataFrame:
    """``doc_id, text`` from arrays of ids; NULL arrays and empty ones give the empty text."""
    data = read(model or default_model())
    key = ("pieces", hash(data))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(key, lambda: Pieces(data))
        for batch in batches:
            texts = [pieces.decode(i or []) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = tokens.schema[id].dataType.simpleString()
    return arrow_map(tokens.select(F.col(id).alias("doc_id"), F.col(ids).alias("ids")), run, f"doc_id {kind}, text string")
