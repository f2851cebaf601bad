import random
import zlib

import numpy as np
import pytest
import sentencepiece
from test_copies import assert_same

from caseloom.llm import bit_planes, piece_viterbi, token_counts
from caseloom.llm.common import Folder


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bit_planes.default_tokenizer())


@pytest.fixture(scope="module")
def pieces():
    return piece_viterbi.Pieces(piece_viterbi.read(piece_viterbi.default_model()))


ODD = ["", " ", "   a", "a\u00a0\u3000 b\t\t c\x85\x1c d  ", "don't  stop!!! '''s é漢字🎉 x,y.z ... \r\n\r\n", "a" * 3000, "<|endoftext|> <|endoftext|>x",
       "▁▁ x▁y", "\x00\x1c\x1d", "1,234.5 ½ ²", "ſſ İ ǅ", "word, word. word; word"]


def ids_of(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


def check_files(spark, docs, tokenizer, out, **how):
    bit_planes.write(docs, out, **how)
    found = sorted(bit_planes.read(spark, out).collect(), key=lambda r: r.start)
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in found] == [r.doc_id for r in rows]
    start, expected = 0, []
    for r in found:
        assert r.start == start
        start += len(r.ids) // 4
    expected = [(r.doc_id, zlib.crc32(ids_of(tokenizer, r.text).tobytes())) for r in rows]
    assert_same([(r.doc_id, zlib.crc32(r.ids)) for r in found], expected)


@pytest.mark.parametrize("planes", ["bit", "byte"])
@pytest.mark.parametrize("block", [7, 1000, 65536])
def test_planes_give_the_ids_back(spark, odd_documents, tokenizer, tmp_path, planes, block):
    check_files(spark, odd_documents.repartition(3), tokenizer, f"file://{tmp_path}/out", planes=planes, block=block)


def test_planes_of_documents(spark, documents, tokenizer, tmp_path):
    check_files(spark, documents, tokenizer, f"{tmp_path}/out")


def test_planes_of_nothing(spark, no_documents, tmp_path):
    bit_planes.write(no_documents, f"{tmp_path}/out")
    assert bit_planes.read(spark, f"{tmp_path}/out").count() == 0


def test_any_range_is_read_by_its_blocks(tmp_path):
    ids = np.random.default_rng(1).integers(0, 1 << 32, 1000, dtype=np.uint64).astype("<u4")
    store = Folder(str(tmp_path))
    for planes in (4, 32):
        with store.write("part") as sink:
            writer = bit_planes.Writer(sink, planes, 64)
            writer.add(5, ids[:1])
            writer.add(None, ids[1:])
            writer.close()
        with store.read("part") as source:
            reader = bit_planes.Reader(source)
            for a, n in ((0, 1000), (63, 2), (64, 64), (999, 1), (500, 0)):
                assert (reader.ids(a, n) == ids[a : a + n]).all()
            assert [(d, s, len(i)) for d, s, i in reader.documents()] == [(5, 0, 1), (None, 1, 999)]
        with store.write("part") as sink:
            sink.write(b"cut off" * 20)
        with store.read("part") as source, pytest.raises(ValueError):
            bit_planes.Reader(source)


def test_units_encode_like_whole_texts(tokenizer, documents):
    texts = [r.text for r in documents.select("text").limit(150).collect()] + ODD
    encoder = bit_planes.UnitEncoder(
        bit_planes.default_tokenizer(), lambda u, e: (list(e.ids), token_counts.spans_of(u, e)), lambda u, a, b: (a[0] + b[0], token_counts.joined_spans(u, a[1], b[1]))
    )
    assert encoder.by_unit
    for text, (units, known) in zip(texts, encoder.encode(texts), strict=True):
        whole = tokenizer.encode(text, add_special_tokens=False)
        assert [i for k in known for i in k[0]] == whole.ids
        assert token_counts.token_spans(units, [k[1] for k in known]).tolist() == [list(o) for o in whole.offsets]


def counted(spans, start, end, rule):
    total = 0
    for a, b in spans:
        b = max(b, a + 1)
        if rule == "share":
            total += max(0, min(b, end) - max(a, start)) / (b - a)
        else:
            total += start <= {"first": a, "last": b - 1, "middle": (a + b - 1) // 2}[rule] < end
    return total


def crossed(spans, start, end):
    return sum(max(a, start) < min(max(b, a + 1), end) and not start <= a <= max(b, a + 1) <= end for a, b in spans)


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_section_tokens(spark, tokenizer, documents, rule):
    pick, sections = random.Random(2), []
    rows = documents.select("doc_id", "text").limit(25).collect()
    texts = {r.doc_id: r.text for r in rows} | {-1: ODD[4], -2: "", -3: None, -4: "é漢字🎉" * 5}
    for id, text in texts.items():
        n = len(text or "")
        cuts = sorted(pick.randint(0, n) for _ in range(6))
        sections += [(id, f"s{i}", a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        sections += [(id, "all", 0, n), (id, "over", 0, n + 50), (id, None, None, 3), (id, "all", 0, n)]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    given = spark.createDataFrame([*sections, (99999999, "none", 0, 4)], "doc_id long, section string, start long, end long")
    expected = [(99999999, "none", 0, 4, 0, 0)]
    for id, name, start, end in sections:
        spans = tokenizer.encode(texts[id] or "", add_special_tokens=False).offsets
        n = len(texts[id] or "")
        a, b = (0, 0) if start is None else (start, min(end, n))
        b = max(a, min(b, n))
        count = counted(spans, a, b, rule)
        expected.append((id, name, start, end, count, crossed(spans, a, b)))
    found = [tuple(r) for r in token_counts.section_tokens(docs, given, rule=rule).collect()]
    tidy = lambda rows: [(*r[:4], round(float(r[4]), 6), int(r[5])) for r in rows]
    assert_same(tidy(found), tidy(expected))


def test_lines_add_up(tokenizer, odd_documents, no_documents):
    found = token_counts.section_tokens(odd_documents)
    totals = found.groupBy("doc_id").sum("n_tokens").collect()
    expected = {}
    for r in odd_documents.select("doc_id", "text").collect():
        expected[r.doc_id] = expected.get(r.doc_id, 0) + len(tokenizer.encode(r.text or "").ids)
    assert {r[0]: r[1] for r in totals} == expected
    assert token_counts.section_tokens(no_documents).count() == 0


def test_field_tokens(tokenizer, odd_documents):
    found = token_counts.field_tokens(odd_documents, ["source", "lang", "text"]).collect()
    assert len(found) == 3 * odd_documents.count()
    total = sum(len(tokenizer.encode("\n".join([r.source or "", r.lang or "", r.text or ""])).ids) for r in odd_documents.collect())
    assert sum(r.n_tokens for r in found) == total


def test_pieces_equal_the_library(pieces, documents):
    texts = [r.text for r in documents.select("text").collect()] + ODD
    for text in texts:
        ids = np.frombuffer(pieces.encode(text), "<i4").tolist()
        assert ids == pieces.library.encode(text)
        assert pieces.decode(ids) == pieces.library.decode(ids)


def test_encode_and_decode(spark, odd_documents, no_documents, pieces):
    found = piece_viterbi.encode(odd_documents)
    rows = [(r.doc_id, pieces.library.encode(r.text or "")) for r in odd_documents.collect()]
    got = found.collect()
    assert_same([(r.doc_id, str(r.ids), r.n_tokens) for r in got], [(i, str(x), len(x)) for i, x in rows])
    back = piece_viterbi.decode(found).collect()
    assert_same([tuple(r) for r in back], [(i, pieces.library.decode(x)) for i, x in rows])
    assert {r.round_trip for r in got if r.doc_id != 10} == {True}  # 10 holds the mark itself
    assert piece_viterbi.encode(no_documents).count() == 0


def test_unigram_models_get_the_best_score(pieces, documents):
    """The same pieces as a unigram model, against dynamic programming over all substrings."""
    data = piece_viterbi.read(piece_viterbi.default_model())
    at = data.rindex(b"\x18\x02 \x80\xfa\x01")  # model_type and the size of the vocabulary
    model = piece_viterbi.Pieces(data[:at] + b"\x18\x01" + data[at + 2 :])
    assert (pieces.kind, model.kind) == (piece_viterbi.BPE, piece_viterbi.UNIGRAM)
    for text in ["Hello wörld", "ßtraße 🎉 漢字x", "aaaaaaa", *(r.text[:80] for r in documents.limit(20).collect())]:
        best = [0.0] + [float("-inf")] * len(text)
        for end in range(1, len(text) + 1):
            for start in range(end):
                id = model.ids.get(text[start:end])
                if id is not None:
                    best[end] = max(best[end], best[start] + model.scores[id])
            if text[end - 1] not in model.ids:
                best[end] = max(best[end], best[end - 1] + model.worst)
        path = model.segment(text)
        assert "".join(text[a:b] for _, a, b in path) == text
        assert sum(model.scores.get(id, model.worst) for id, _, _ in path) == best[-1]
    library = sentencepiece.SentencePieceProcessor(model_proto=data[:at] + b"\x18\x01" + data[at + 2 :])
    assert library.decode(np.frombuffer(model.encode("Hello wörld 漢字"), "<i4").tolist()) == "Hello wörld 漢字"
