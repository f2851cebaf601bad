"""Units numbered by Arrow against the library, and memory bounded by bytes."""

import random
import resource
from array import array

import numpy as np
import pyarrow as pa
import pytest

from caseloom.llm import bit_planes, common, text_units, token_counts


def packed(ids):
    return array("H", ids).tobytes()


@pytest.fixture
def encoder():
    join = lambda unit, first, second: first + second
    return text_units.UnitEncoder(bit_planes.default_tokenizer(), lambda unit, found: packed(found.ids), join, packed)


def texts(seed, count):
    pick = random.Random(seed)
    parts = [" ", "\n", "  ", "\t", " a", "b", ". ", ",", "é", "Ж", " don't", "<|endoftext|>", "12", " ", "\n\n", "...", "x" * 80, " Straße!", " end***", "\nNext", "it's", " so'", "$$$", "\n"]
    return ["".join(pick.choice(parts) for _ in range(pick.randint(0, 25))) for _ in range(count)]


def test_packed_ids_equal_the_library(encoder, documents):
    given = [*texts(1, 1500), "", " ", "\n", "a ", " a", "...", *[r.text for r in documents.limit(150).collect()]]
    for _ in range(2):  # the second time everything is remembered
        ids, counts = encoder.packed(pa.array(given))
        found = [f.ids for f in encoder.tokenizer.encode_batch(given, add_special_tokens=False)]
        assert counts.tolist() == [len(f) for f in found]
        assert ids.tolist() == [i for f in found for i in f]
    ids, counts = encoder.packed(pa.array([], pa.string()))
    assert len(ids) == len(counts) == 0


def test_memory_is_bounded_by_bytes(encoder, monkeypatch):
    """2,000 texts of 3,000 characters without white space leave nothing; words leave at most the bound in each half."""
    pick = random.Random(2)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for _ in range(20):
        encoder.packed(pa.array(["".join(chr(0x4E00 + pick.randrange(8000)) for _ in range(3000)) for _ in range(100)]))
    assert all(len(u) <= text_units.LONGEST for u in encoder.known)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200 << 10
    monkeypatch.setattr(text_units, "REMEMBERED", 200_000)
    for i in range(100):
        encoder.packed(pa.array([" ".join(f"w{'abcdefghij'[k % 10]}{i}x{k}" for k in range(200))]))
        assert encoder.held <= 300_000 and len(encoder.known) + len(encoder.older) < 4000


def test_slices_are_cut_by_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 10, None, "y" * 500, "", "z" * 30, "w" * 30])], names=["text"])
    parts = [p.column(0).to_pylist() for p in common.slices(batch, 0, 70)]
    assert parts == [["x" * 10, None], ["y" * 500], ["", "z" * 30, "w" * 30]]
    assert not list(common.slices(batch.slice(0, 0), 0, 70))


def test_tokens_over_whole_sections_are_found_by_place():
    pick = random.Random(7)
    for _ in range(200):
        ends = np.cumsum([pick.randint(0, 9) for _ in range(30)])
        first, last = np.concatenate([[0], ends[:-1]]), np.maximum(ends, np.concatenate([[0], ends[:-1]]) + 1)
        if pick.random() < 0.3:
            last[pick.randrange(30)] += 20  # spans out of order
        starts = np.array([pick.randint(0, 150) for _ in range(20)])
        stops = starts + np.array([pick.randint(1, 6) for _ in range(20)])
        found = token_counts.spanning(first, last, starts, stops)
        assert found.tolist() == [sum(f < a and e > b for f, e in zip(first, last)) for a, b in zip(starts, stops)]


def test_left_files_are_cleared(spark, tmp_path, documents):
    out = tmp_path / "ids"
    out.mkdir()
    (out / ".ids-00001.planes.left").write_bytes(b"half")
    bit_planes.write(documents.limit(20), f"file://{out}")
    assert not list(out.glob(".ids*")) and (out / "manifest.json").exists()
    assert bit_planes.read(spark, f"file://{out}").count() == 20
