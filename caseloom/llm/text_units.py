"""Encoding texts unit by unit: words are encoded once per worker and looked up from then on."""

from __future__ import annotations

import json
import os
import re
from codecs import charmap_decode
from collections.abc import Callable
from string import punctuation
from sys import getsizeof
from unicodedata import category

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What Unicode calls white space, as tokenizers' patterns do; Python's own class has four more.
SPACE = " \t\n\x0b\x0c\r\x85\xa0  -     　"
#: White space and the run after it. Token patterns never join a character to white space that follows it.
UNIT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: White space that does not stand alone, or is neither a space nor a line end.
RUNS = f"[{SPACE}][{SPACE}]|[{SPACE.replace(' ', '', 1).replace(chr(10), '')}]"
#: Bytes of units and values that a worker remembers, the dictionary's own included; the least used are forgotten beyond them.
REMEMBERED = 128 << 20
#: Longer units are worked out each time: without white space a unit may be a whole text.
LONGEST = 64
#: Bytes of a dictionary entry beside its key and value.
ENTRY = 100

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def entry_bytes(unit: str, value: object) -> int:
    return ENTRY + getsizeof(unit) + getsizeof(value)


class Memory(dict):
    """A dictionary that makes missing values and keeps those of short units, at most ``bound`` bytes of them.

    Half of the bytes belong to the units asked for since the last change of halves, half to those before; what is asked for
    again moves over, the rest is forgotten.
    """

    def __init__(self, make: Callable, bound: int = 0) -> None:
        super().__init__()
        self.make, self.bound, self.older, self.held = make, bound, {}, 0

    def __missing__(self, unit: str):
        value = self.older.get(unit)
        if value is None:
            value = self.make(unit)
        if len(unit) <= LONGEST:
            if 2 * self.held > (self.bound or REMEMBERED):
                self.older = dict(self)
                self.clear()
                self.held = 0
            self[unit] = value
            self.held += entry_bytes(unit, value)
        return value


_LOADED: dict = {}


def loaded(key: tuple, make: Callable):
    """One object per worker and key, made when first asked for."""
    if key not in _LOADED:
        _LOADED[key] = make()
    return _LOADED[key]


#: A letter and one of these is always a boundary between tokens.
ENDS = frozenset(".,;:!?")


#: A word of letters up to U+017F, with or without a space before it, is one pre-token.
LETTERS = "".join(c for c in map(chr, range(0xA1, 0x180)) if category(c)[0] == "L")
WORD = re.compile(f" ?[A-Za-z{LETTERS}]+")


def byte_alphabet() -> str:
    """How byte-level vocabularies write each byte: printable Latin-1 as it is, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = iter(range(0x100, 0x200))
    return "".join(chr(b if b in plain else next(shifted)) for b in range(256))


class UnitEncoder:
    """Encodes with a tokenizer of the tokenizers library, each unit once; ``of`` turns a unit's encoding into what is kept.

    Units may be encoded alone if nothing looks over white space: byte-level pre-tokens, no normaliser, no template of
    special tokens, and added tokens that neither hold white space nor take it in. Other tokenizers get whole texts.
    With ``of_ids``, which makes the same from ids alone, plain words go to the library's model without pre-tokenization; with
    ``of_names``, which makes it from the names of the tokens, they do as well.
    ``of_ids`` gives bytes of ``id_type`` where ``packed`` is used. Units up to ``LONGEST`` are remembered, ``REMEMBERED`` bytes of them in two halves, as ``Memory`` does.
    """

    def __init__(
        self, path: str, of: Callable, join: Callable, of_ids: Callable | None = None, of_names: Callable | None = None, bound: int = 0
    ) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.of, self.join, self.of_ids, self.of_names, self.bound = of, join, of_ids, of_names, bound
        self.known, self.older, self.held = {}, {}, 0
        self.id_type = np.dtype("u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "u4")
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_unit = self.separable()
        if self.by_unit:
            spell = self.tokenizer.pre_tokenizer.pre_tokenize_str
            self.spelled = {ord(c): spell(c)[0][0] for c in " " + LETTERS}
            self.alphabet = byte_alphabet()

    def separable(self) -> bool:
        parts = json.loads(self.tokenizer.to_str())
        before = parts["pre_tokenizer"] or {}
        plain = all(
            not (t["lstrip"] or t["rstrip"] or t["single_word"]) and not any(c in SPACE for c in t["content"])
            for t in parts["added_tokens"]
        )
        return (
            plain
            and not parts["normalizer"]
            and not parts["post_processor"]
            and before.get("type") == "ByteLevel"
            and before["use_regex"]
            and not before["add_prefix_space"]
        )

    def encode(self, texts: list[str]) -> list[tuple[list[str], list]]:
        """Units and what is known of each, per text."""
        if not self.by_unit:
            found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
            return [([t], [self.of(t, e)]) for t, e in zip(texts, found, strict=True)]
        split = [UNIT.findall(t) for t in texts]
        value = self.values(set().union(*split)).__getitem__
        return [(units, list(map(value, units))) for units in split]

    def values(self, units: set[str]) -> dict:
        """What is kept of every unit."""
        missing = units.difference(self.known)
        known = units.difference(missing)
        found = dict(zip(known, map(self.known.__getitem__, known), strict=True))
        fresh = self.learn(missing)
        found.update(fresh)
        kept = {u: v for u, v in fresh.items() if len(u) <= LONGEST}
        self.known.update(kept)
        self.held += sum(map(getsizeof, kept)) + sum(map(getsizeof, kept.values())) + ENTRY * len(kept)
        if 2 * self.held > (self.bound or REMEMBERED):
            self.known, self.older, self.held = {}, self.known, 0
        return found

    def packed(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts`` in a row, and how many each text has; ``of_ids`` gives arrays of one type as bytes.

        Where white space stands alone, what follows it is a unit with it, and marks that end a word are units of their own. Arrow cuts the texts there and numbers the distinct units, so Python sees each of them once; the ids are
        gathered by number. Other texts go through ``encode``.
        """
        odd = pc.match_substring_regex(texts, RUNS) if self.by_unit else pa.array([True] * len(texts), pa.bool_())
        pieces = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        flat, starts = pieces.flatten(), pieces.offsets.to_numpy()[:-1] - pieces.offsets[0].as_py()
        lines = pc.split_pattern(flat, "\n")
        flat, at_line = lines.flatten(), np.diff(lines.offsets.to_numpy())
        heads = np.cumsum(at_line) - at_line  # the first part of each piece; what follows begins a line
        starts = heads[starts]
        later, kinds = flat.dictionary_encode(), np.ones(len(flat), bool)
        kinds[heads] = False
        begun = np.flatnonzero(kinds)
        whole, place = later.dictionary, later.indices.to_numpy()
        cores, tails = self.cut(whole)
        units = pc.binary_join_element_wise("", cores.dictionary, " ").to_pylist()
        ends = tails.dictionary.to_pylist()
        apart = flat.take(pa.array(starts)).to_pylist()
        following = [f"\n{u}" for u in flat.take(pa.array(begun)).to_pylist()]
        values = self.remembered(units + ends + apart + following)
        # Two numbers per piece: of the unit with its space, and of the marks that end it.
        number = np.empty((len(flat), 2), "i8")
        number[:, 0] = cores.indices.to_numpy()[place]
        number[:, 1] = tails.indices.to_numpy()[place] + len(units)
        for where, first in ((starts, len(units) + len(ends)), (begun, len(units) + len(ends) + len(apart))):
            number[where, 0] = np.arange(len(where)) + first
            number[where, 1] = len(values) - 1  # nothing
        kind = self.id_type
        sizes = np.fromiter(map(len, values), "i8", len(values)) // kind.itemsize
        bounds = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        lists = pa.ListArray.from_arrays(bounds, pa.array(np.frombuffer(b"".join(values), kind)))
        ids = lists.take(pa.array(number.ravel())).flatten().to_numpy()
        counts = np.add.reduceat(sizes[number].sum(axis=1), starts) if len(starts) else np.empty(0, "i8")
        places = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if len(places):
            others = [np.frombuffer(b"".join(known), kind) for _, known in self.encode(texts.take(pa.array(places)).to_pylist())]
            at = np.repeat(np.cumsum(counts)[places], list(map(len, others)))  # their own counts are 0 so far
            ids = np.insert(ids, at, np.concatenate(others))
            counts[places] = list(map(len, others))
        return ids, counts

    def cut(self, whole: pa.Array) -> tuple[pa.DictionaryArray, pa.DictionaryArray]:
        """Texts cut before the marks that end them, where these follow a letter: no token reaches over that boundary.

        Texts that hold an added token are left whole, as its own marks belong to it.
        """
        trimmed = pc.ascii_rtrim(whole, punctuation)
        cuts = pc.match_substring_regex(trimmed, f"[A-Za-z{LETTERS}]$")
        for content in self.added:
            cuts = pc.and_(cuts, pc.invert(pc.match_substring(whole, content)))
        cores = pc.if_else(cuts, trimmed, whole)
        marks = pc.subtract(pc.binary_length(whole), pc.binary_length(cores)).to_numpy()
        tails = np.full(len(whole), "", object)
        for size in np.unique(marks[marks > 0]).tolist():
            at = np.flatnonzero(marks == size)
            tails[at] = pc.utf8_slice_codeunits(whole.take(pa.array(at)), -size).to_numpy(zero_copy_only=False)
        return cores.dictionary_encode(), pa.array(tails, pa.string()).dictionary_encode()

    def remembered(self, units: list[str]) -> list[bytes]:
        """The ids of every unit as bytes, and of nothing at the end."""
        values = list(map(self.known.get, units))
        todo = [i for i, v in enumerate(values) if v is None]
        tokenize, of_ids, older, word, table = self.tokenizer.model.tokenize, self.of_ids, self.older.get, WORD.fullmatch, self.alphabet
        known, held, others = self.known, 0, []
        for i in todo:
            unit = units[i]
            value = older(unit)
            if value is None:
                if not word(unit):
                    others.append(i)
                    continue
                value = of_ids([t.id for t in tokenize(charmap_decode(unit.encode(), "strict", table)[0])])
            values[i] = value
            if len(unit) <= LONGEST:
                known[unit] = value
                held += len(unit) + len(value)
        if others:
            found = self.tokenizer.encode_batch([units[i] for i in others], add_special_tokens=False)
            for i, encoding in zip(others, found, strict=True):
                values[i] = value = of_ids(encoding.ids)
                if len(units[i]) <= LONGEST:
                    known[units[i]] = value
                    held += len(units[i]) + len(value)
        self.held += held + len(todo) * (ENTRY + 90)  # what a text and bytes take beside their characters
        if 2 * self.held > REMEMBERED:
            self.known, self.older, self.held = {}, self.known, 0
        return [*values, b""]

    def learn(self, missing: set[str]) -> dict:
        """What is kept of missing units and of their parts; an ending that stands apart for certain is encoded apart."""
        known, older = self.known, self.older
        made = {u: older[u] for u in missing if u in older} if older else {}
        missing = missing.difference(made)
        ended = [u for u in missing if len(u) > 1 and u[-1] in ENDS and u[-2].isalpha()]
        missing.difference_update(ended)
        missing.update(p for e in ended for p in (e[:-1], e[-1]) if p not in known and p not in made)
        if self.of_ids:
            tokenize, of_ids, spelled = self.tokenizer.model.tokenize, self.of_ids, self.spelled
            plain = list(filter(WORD.fullmatch, missing))
            for unit in plain:
                made[unit] = of_ids([t.id for t in tokenize(unit.translate(spelled))])
            missing.difference_update(plain)
        if self.of_names:
            tokenize, of_names = self.tokenizer.model.tokenize, self.of_names
            plain, table = list(filter(WORD.fullmatch, missing)), self.alphabet
            for unit in plain:
                made[unit] = of_names(unit, [t.value for t in tokenize(charmap_decode(unit.encode(), "strict", table)[0])])
            missing.difference_update(plain)
        listed = list(missing)
        for unit, found in zip(listed, self.tokenizer.encode_batch(listed, add_special_tokens=False), strict=True):
            made[unit] = self.of(unit, found)
        for unit in ended:
            first, last = unit[:-1], unit[-1]
            made[unit] = self.join(first, *(made[p] if p in made else known[p] for p in (first, last)))
        return made
