"""BPE encoding by forced boundaries, and decoding.

A merge only ever makes a token of the vocabulary, so two neighbouring bytes that stand side by side in no token are never
merged: the boundary between them is certain before any merge is tried. Words are cut there, every fragment is merged on its
own by the ranks of its pairs, and the ids are put together again. The last byte of a word carries the word end, so pairs at
the end of a word are looked up apart from pairs inside. Without cuts a run without white space would be one long fragment;
such a fragment is merged with a heap, in n log n steps.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import pairwise
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import arrow_map
from caseloom.llm.text_units import Memory, loaded

TOKENIZER = "word_bpe_49k.json"
#: The word pattern of the public tokenizer; nothing it keeps holds or looks at white space.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Printable characters up to U+017F: none composes with another, lower case is one rule, and classes never changed.
LATIN = re.compile("[!-~\u00a1-\u012f\u0131-\u017e]+")
_KINDS = {k: "".join(c for c in map(chr, range(0xA1, 0x180)) if category(c)[0] == k) for k in "LN"}
#: The word pattern over these characters, in lower case.
LATIN_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_KINDS['L']}]+|[0-9{_KINDS['N']}]|[^a-z0-9{_KINDS['L']}{_KINDS['N']}]+")
SPACES = "\t\n\x0b\x0c\r "
#: Symbols up to which the best pair of a fragment is searched by a scan.
SHORT = 48
#: Texts that a task holds at a time.
ROWS = 200


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


@lru_cache(1)
def read(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


class ForcedBpe:
    """A byte-level BPE tokenizer of the tokenizers library's format: its cuts, ranks, encoding and decoding."""

    def __init__(self, definition: str) -> None:
        from tokenizers import Tokenizer

        parts = json.loads(definition)
        model = parts["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.vocabulary = model["vocab"]
        added = sorted((t["content"] for t in parts["added_tokens"]), key=len, reverse=True)
        odd = [t for t in parts["added_tokens"] if t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]]
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        single = {c for t in self.vocabulary for c in (t if len(t) == 1 else "")}
        if model["type"] != "BPE" or not plain or odd or any(c + self.end not in self.vocabulary for c in single):
            raise ValueError("byte-level BPE with every byte in its vocabulary and added tokens matched as they stand")
        self.library = Tokenizer.from_str(definition)
        self.library.no_truncation()
        self.library.no_padding()
        self.added = {t: self.library.token_to_id(t) for t in added}
        self.specials = re.compile(f"({'|'.join(map(re.escape, added))})") if added else None
        self.names = [""] * (max([*self.vocabulary.values(), *self.added.values()]) + 1)
        for name, id in [*self.vocabulary.items(), *self.added.items()]:
            self.names[id] = name
        self.inside, self.final = self.pairs(set(self.vocabulary) - set(self.added))
        self.width = len(self.names).bit_length()
        self.ranks = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            key = self.vocabulary[left] << self.width | self.vocabulary[right]
            self.ranks.setdefault(key, rank << self.width | self.vocabulary[left + right])
        self.none = len(self.ranks) + 1 << self.width
        self.by_unit = self.independent(parts)
        self.kind = "H" if len(self.names) <= 1 << 16 else "I"
        self.lowers = self.by_unit and "Lowercase" in json.dumps(parts["normalizer"])
        spell = self.library.pre_tokenizer.pre_tokenize_str
        self.spelled = {c: "".join(w for w, _ in spell(chr(c))) for c in range(0xA1, 0x180)} if self.lowers else {}
        self.memory, self.words = Memory(self.unit), Memory(self.word)
        self.listed = np.array(self.names, dtype=object)

    @staticmethod
    def independent(parts: dict) -> bool:
        """Whether runs between ASCII white space can be encoded apart: known steps, none of which looks across it."""
        steps = parts["normalizer"] or {}
        steps = steps.get("normalizers", [steps] if steps else [])
        known = {"NFC", "Lowercase"}
        calm = all(s["type"] in known or s == {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "} for s in steps)
        before = (parts["pre_tokenizer"] or {}).get("pretokenizers", [])
        split = {"type": "Split", "pattern": {"Regex": WORDS}, "behavior": "Removed", "invert": True}
        bytes_only = len(before) == 2 and before[1]["type"] == "ByteLevel"
        bytes_only = bytes_only and not before[1]["add_prefix_space"] and not before[1]["use_regex"]
        spaced = any(c in SPACES for t in parts["added_tokens"] for c in t["content"])
        return calm and bytes_only and before[0] == split and not spaced

    def pairs(self, tokens: set[str]) -> tuple[set[str], set[str]]:
        """Neighbouring bytes inside tokens, and those of which the second ends a word."""
        inside, final = set(), set()
        for token in tokens:
            ended = bool(self.end) and token.endswith(self.end) and len(token) > len(self.end)
            body = token[: -len(self.end)] if ended else token
            found = [a + b for a, b in pairwise(body)]
            if ended and found:
                final.add(found.pop())
            inside.update(found)
        return inside, final if self.end else inside

    def fragments(self, word: str) -> list[list[int]]:
        """The symbols of a word (its bytes as the vocabulary writes them), cut at the certain boundaries."""
        vocabulary, inside = self.vocabulary, self.inside
        ids = [vocabulary[symbol] for symbol in word]
        ids[-1] = vocabulary[word[-1] + self.end]
        cuts = [i for i in range(1, len(word) - 1) if word[i - 1 : i + 1] not in inside]
        if len(word) > 1 and word[-2:] not in self.final:
            cuts.append(len(word) - 1)
        return [ids[a:b] for a, b in pairwise([0, *cuts, len(word)])]

    def merged(self, ids: list[int]) -> list[int]:
        """Merge always the pair of the lowest rank, the leftmost among equals, until no pair has a rank."""
        if len(ids) > SHORT:
            return self.merged_by_heap(ids)
        width, rank, none = self.width, self.ranks.get, self.none
        found = [rank(a << width | b, none) for a, b in pairwise(ids)]
        while found:
            best = min(found)
            if best == none:
                break
            at = found.index(best)
            id = best & ((1 << width) - 1)
            ids[at : at + 2] = [id]
            del found[at]
            if at:
                found[at - 1] = rank(ids[at - 1] << width | id, none)
            if at < len(found):
                found[at] = rank(id << width | ids[at + 1], none)
        return ids

    def merged_by_heap(self, ids: list[int]) -> list[int]:
        width, ranks, count = self.width, self.ranks, len(ids)
        mask = (1 << width) - 1
        after, before = list(range(1, count + 1)), list(range(-1, count - 1))
        heap = [(r, i) for i, (a, b) in enumerate(pairwise(ids)) if (r := ranks.get(a << width | b)) is not None]
        heapify(heap)
        while heap:
            found, i = heappop(heap)
            j = after[i] if ids[i] >= 0 else count
            if j >= count or ranks.get(ids[i] << width | ids[j]) != found:
                continue  # one side has been merged since
            ids[i], ids[j], after[i] = found & mask, -1, after[j]
            if after[j] < count:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < count and (rank := ranks.get(ids[a] << width | ids[b])) is not None:
                    heappush(heap, (rank, a))
        return [id for id in ids if id >= 0]

    def plain(self, text: str) -> bytes:
        """The ids of a text without added tokens; normaliser and word pattern are the library's own beyond Latin letters."""
        if self.lowers and LATIN.fullmatch(text):
            words = [w.translate(self.spelled) for w in LATIN_WORDS.findall(text.lower())]
        else:
            body = self.library.normalizer.normalize_str(text) if self.library.normalizer else text
            words = [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(body)] if body else []
        memory = self.words
        return b"".join([memory[word] for word in words])

    def word(self, word: str) -> bytes:
        return self.packed([id for part in self.fragments(word) for id in self.merged(part)])

    def packed(self, ids: list[int]) -> bytes:
        return array(self.kind, ids).tobytes()

    def unit(self, text: str) -> bytes:
        if self.specials is None or not self.specials.search(text):
            return self.plain(text)
        parts = enumerate(self.specials.split(text))
        return b"".join([self.packed([self.added[p]]) if i % 2 else self.plain(p) for i, p in parts])

    def encode(self, text: str) -> np.ndarray:
        if not self.by_unit:
            return np.frombuffer(self.unit(text), self.kind)
        memory = self.memory
        return np.frombuffer(b"".join([memory[u] for u in UNITS.findall(text)]), self.kind)

    def decode(self, ids: np.ndarray) -> str:
        """The tokens joined by a space, as the library does without a decoder; its own decoder where there is one."""
        if self.library.decoder is not None:
            return self.library.decode(ids.tolist(), skip_special_tokens=False)
        return " ".join(self.listed[ids])


UNITS = re.compile(f"[^{SPACES}]+")


def encode(
    docs: DataFrame, id: str = "doc_id", text: str = "text", tokenizer: str | None = None, decoded: bool = False
) -> DataFrame:
    """``doc_id, ids`` per row of ``docs``, from whole texts; with ``decoded`` also ``text``, decoded from the ids.

    The ids equal those of the tokenizers library without special tokens added, truncation or padding; added tokens that a
    text spells out are found as the library finds them. NULL counts as the empty text, which has no ids. NULL ids and
    repeated rows stay as they are; an empty table gives no rows; other columns are not read. ``tokenizer`` is a file that
    the driver can read; its content goes to the tasks. Texts never leave their task, so nothing is shuffled.
    """
    definition = read(tokenizer or default_tokenizer())
    key = ("forced", hash(definition))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(key, lambda: ForcedBpe(definition))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                found = [bpe.encode(t or "") for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, found)])
                flat = pa.array(np.concatenate(found).astype("<i4"))
                out = [part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)]
                if decoded:
                    out.append(pa.array([bpe.decode(ids) for ids in found], pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "ids", "text"][: len(out)])

    kind = docs.schema[id].dataType.simpleString()
    texts = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    return arrow_map(texts, run, f"doc_id {kind}, ids array<int>" + (", text string" if decoded else ""))


def decode(tokens: DataFrame, id: str = "doc_id", ids: str = "ids", tokenizer: str | None = None) -> DataFrame:
    """``doc_id, text`` from arrays of ids, special tokens included; NULL arrays and empty ones give the empty text."""
    definition = read(tokenizer or default_tokenizer())
    key = ("forced", hash(definition))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(key, lambda: ForcedBpe(definition))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = [bpe.decode(np.array(i or [], "<i4")) for i in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = tokens.schema[id].dataType.simpleString()
    listed = tokens.select(F.col(id).alias("doc_id"), F.col(ids).alias("ids"))
    return arrow_map(listed, run, f"doc_id {kind}, text string")
