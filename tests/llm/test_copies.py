import random

import brute
import pytest
from pyspark.sql import functions as F

from caseloom.llm import extendible, graph, simhash


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def key(row):
    return tuple((v is not None, str(type(v)), v if v is not None else 0) for v in row)


def assert_same(left, right):
    assert sorted(map(tuple, left), key=key) == sorted(map(tuple, right), key=key)


@pytest.mark.parametrize("capacity, bits", [(4096, 256), (2, 256), (3, 8), (1, 4)])
def test_exact_copies(odd_documents, capacity, bits):
    found = extendible.exact_copies(odd_documents, capacity=capacity, bits=bits)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert_same(found.collect(), brute.exact(pairs(odd_documents)))


def test_index_splits_and_chains(documents):
    """Buckets keep their capacity but for chains, cover disjoint prefixes, and the directory names each slot once."""
    index = extendible.build_index(documents, capacity=3).cache()
    assert index.groupBy("bucket", "depth").count().agg(F.max("count")).first()[0] <= 3
    for row in index.select("bucket", "depth", "key").collect():
        assert int(row.key[:16], 16) >> (64 - row.depth) == row.bucket
    slots = []
    for row in extendible.directory(index).collect():
        slots += range(row.first_slot, row.first_slot + row.slots)
    assert len(slots) == len(set(slots)) and max(slots) < 2 ** index.agg(F.max("depth")).first()[0]
    chained = extendible.build_index(documents, capacity=3, bits=4)
    assert chained.agg(F.max("chained")).first()[0] > 3
    assert chained.count() == index.count() == documents.select(F.lower("text")).distinct().count()


def test_drop_copies_keeps_one_row_of_each_text(odd_documents, no_documents, documents):
    kept = extendible.drop_copies(odd_documents)
    assert kept.schema == odd_documents.schema
    expected = {(id, brute.lower(t)) for (id, t), e in zip(pairs(odd_documents), brute.exact(pairs(odd_documents)), strict=True) if e[3]}
    found = [(id, brute.lower(t)) for id, t in pairs(kept)]
    assert len(found) == len(expected) and set(found) == expected
    assert extendible.drop_copies(no_documents).count() == 0
    found = {r[0] for r in extendible.drop_copies(documents).select("doc_id").collect()}
    assert found == {e[0] for e in brute.exact(pairs(documents)) if e[3]}


def test_exact_copies_of_nothing(no_documents):
    assert extendible.exact_copies(no_documents).count() == 0


def hexed(found):
    return [(r.doc_id, f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in found.collect()]


def test_near_copies(odd_documents, documents, no_documents):
    for docs in (odd_documents, documents):
        assert_same(hexed(simhash.near_copies(docs)), brute.near_copies(pairs(docs)))
    assert simhash.near_copies(no_documents).count() == 0


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = "  ".join(f"w{i % 50}" for i in range(500)) + " "
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "PIECE", 64)
    assert simhash.fingerprint(text.encode()) == whole
    assert whole & (2**64 - 1) == brute.fingerprint(text)


@pytest.mark.parametrize("group", [2, 8, 256])
def test_dense_fingerprints_lose_no_link(spark, group):
    """Many values within a small ball, which share their segments: the keys are cut down to the last level."""
    spread, values = random.Random(5), set()
    for centre in (0, -1, 0x0123456789ABCDEF):
        for _ in range(150):
            flips = sum(1 << b for b in spread.sample(range(64), spread.randint(0, 5)))
            value = (centre ^ flips) & (2**64 - 1)
            values.add(value - 2**64 if value >> 63 else value)
    rows = spark.createDataFrame([(v,) for v in values], "fp long")
    found = {r.node: r.root for r in graph.components(simhash.links(rows, group=group)).collect()}
    expected = brute.component_of(values, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 3)
    assert {v: found.get(v, v) for v in values} == expected


def test_one_per_group(odd_documents, no_documents):
    kept = simhash.one_per_group(odd_documents)
    assert kept.schema == odd_documents.schema
    rows = pairs(odd_documents)
    roots = brute.component_of({brute.fingerprint(t) for _, t in rows}, lambda a, b: (a ^ b).bit_count() <= 3)
    expected = {(roots[int(e[1], 16)], e[2]) for e in brute.near_copies(rows)}  # one row a group; two groups may have one id
    found = [r[0] for r in kept.select("doc_id").collect()]
    assert sorted(found, key=brute.id_key) == sorted([e[1] for e in expected], key=brute.id_key)
    assert simhash.one_per_group(no_documents).count() == 0


def test_components_of_random_graphs(spark):
    for seed in range(3):
        pick = random.Random(seed)
        edges = [(pick.randrange(400), pick.randrange(400)) for _ in range(250)] + [(900 + i, 901 + i) for i in range(60)]
        found = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        linked = {frozenset(e) for e in edges}
        expected = brute.component_of({v for e in edges for v in e}, lambda a, b: frozenset((a, b)) in linked)  # noqa: B023
        assert {v: found.get(v, v) for v in expected} == expected
