import json
import random
import unicodedata

import brute
import pytest
from test_copies import assert_same
from tokenizers import Tokenizer

from caseloom.llm import forced_bpe, queries, text_units


@pytest.fixture(scope="module")
def bpe():
    return forced_bpe.ForcedBpe(forced_bpe.read(forced_bpe.default_tokenizer()))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(forced_bpe.default_tokenizer())


def strange(pick, count):
    known = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    spaces = [c for c in known if c.isspace()]
    words = ["don't", "we'll", "<|endoftext|>", "<|startoftext|>", "</w>", "é", "Σ", "İ", "ΑΣ", "12", "...", "a" * 70]
    for _ in range(count):
        made = (pick.choice([pick.choice(known), pick.choice(spaces), pick.choice(words), pick.choice("abcdeÄ.,!'")]) for _ in range(40))
        yield "".join(made)


def test_equals_the_library(bpe, library):
    for text in strange(random.Random(2), 800):
        found = library.encode(text, add_special_tokens=False).ids
        ids = bpe.encode(text)
        assert ids.tolist() == found, text
        assert bpe.decode(ids) == library.decode(found, skip_special_tokens=False)


def test_long_runs_without_white_space(bpe, library):
    pick = random.Random(4)
    for text in ("a" * 3000, "中文" * 700, "".join(pick.choice("etaoin") for _ in range(4000)), "#" * 999, "ab1" * 900):
        assert bpe.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_cuts_are_certain(bpe):
    """No token holds a cut pair, and cuts change nothing: merging a whole word gives what its fragments give."""
    tokens = [t for t in bpe.vocabulary if t not in bpe.added]
    for token in random.Random(1).sample(tokens, 3000):
        ended = token.endswith("</w>") and token != "</w>"
        body = token[:-4] if ended else token
        for i in range(len(body) - 1):
            last = ended and i == len(body) - 2
            assert body[i : i + 2] in (bpe.final if last else bpe.inside)
    cut = 0
    for word in ("qxzjvk", "hello", "xqzzy", "wqjfk", "rhythmqz"):
        parts = list(bpe.fragments(word))
        cut += len(parts) - 1
        symbols = [bpe.vocabulary[c] for c in word[:-1]] + [bpe.vocabulary[word[-1] + "</w>"]]
        assert [i for p in parts for i in bpe.merged(list(p))] == bpe.merged(list(symbols)) == bpe.merged_by_heap(list(symbols))
    assert cut > 3


def test_other_tokenizers(library):
    """A byte-level tokenizer without word ends, taken whole; a tokenizer out of reach is refused."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    other, known = forced_bpe.ForcedBpe(forced_bpe.read(path)), Tokenizer.from_file(path)
    assert not other.by_unit
    for text in strange(random.Random(3), 150):
        found = known.encode(text, add_special_tokens=False).ids
        assert other.encode(text).tolist() == found
        assert other.decode(other.encode(text)) == known.decode(found, skip_special_tokens=False)
    parts = json.loads(library.to_str())
    parts["model"]["continuing_subword_prefix"] = "##"
    with pytest.raises(ValueError):
        forced_bpe.ForcedBpe(json.dumps(parts))


def expected(rows, library):
    for id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        yield id, len(ids), brute.sha256(" ".join(map(str, ids))), brute.sha256(back)


def test_query_and_odd_rows(spark, folder, documents, odd_documents, no_documents, library):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert_same(queries.op11_forced_bpe(spark, folder).collect(), expected(rows, library))
    found = forced_bpe.encode(odd_documents, decoded=True)
    rows = [(r.doc_id, library.encode(r.text or "", add_special_tokens=False).ids) for r in odd_documents.collect()]
    assert_same([(r.doc_id, str(r.ids)) for r in found.collect()], [(d, str(i)) for d, i in rows])
    back = forced_bpe.decode(found.select("doc_id", "ids"))
    assert_same(back.collect(), [(r.doc_id, r.text) for r in found.collect()])
    assert forced_bpe.encode(no_documents, decoded=True).count() == 0
    assert forced_bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).first().text == ""


def test_memory_is_bounded_by_bytes(bpe, monkeypatch):
    """Texts without white space are not remembered, and short units are forgotten beyond the bound."""
    bpe.memory.clear()
    bpe.words.clear()
    for i in range(200):
        bpe.encode("".join(chr(0x4E00 + (i * 37 + k * k) % 20000) for k in range(3000)))
    assert not bpe.memory and not bpe.words
    monkeypatch.setattr(text_units, "REMEMBERED", 100_000)
    bpe.memory.held = 0
    bpe.memory.older = {}
    for i in range(5000):
        bpe.encode(f"w{i}")
    assert bpe.memory.held < 51_000 and len(bpe.memory) + len(bpe.memory.older) < 1000
