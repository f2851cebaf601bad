"""Whole rows that stay where ids repeat, over two partitionings."""

from collections import Counter, defaultdict

import brute
import pytest
from test_copies import key

from caseloom.llm import extendible, mixing, simhash

A = " ".join(f"alpha{i}" for i in range(80))
B = " ".join(f"beta{i * i}" for i in range(90))
C = " ".join(f"gamma{i} delta" for i in range(70))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sha string"


def rows_of(*triples):
    return [(id, text, lang, source, None if text is None else len(text), "x") for id, text, lang, source in triples]


CASES = {
    "far texts share an id": rows_of((2, A, "en", "s"), (5, A, "en", "s"), (5, B, "en", "s"), (9, B, "de", "s")),
    "one id, two texts of a group": rows_of((3, A, "en", "s"), (3, A + " end", "en", "s"), (4, A, "en", "s")),
    "rows repeat but for a column": rows_of((7, A, "en", "s"), (7, A, "de", "s"), (7, A, "fr", "s"), (8, C, "en", "t")),
    "rows repeat": rows_of((1, B, "en", None), (1, B, "en", None), (1, C, "en", None), (1, C, "en", "s")),
    "no ids": rows_of((None, A, "en", "s"), (None, A, "de", "s"), (None, B, "en", "s"), (6, B, "en", "s"), (None, None, None, None)),
    "equal sizes": rows_of(*[(5, " ".join(f"{w}{i}" for i in range(60)), "en", "s") for w in "abcdef"]),
}


@pytest.fixture(params=CASES, ids=list(CASES))
def case(spark, request):
    rows = CASES[request.param]
    docs = spark.createDataFrame(rows, SCHEMA)
    return rows, [docs.repartition(1), docs.repartition(4, "lang"), spark.createDataFrame(rows[::-1], SCHEMA)]


def same_rows(run, frames):
    """The result of ``run``, which no partitioning changes and whose rows all come from the input."""
    found = [sorted(map(tuple, run(docs).collect()), key=key) for docs in frames]
    assert found[0] == found[1] == found[2]
    return found[0]


def test_one_per_group(case):
    rows, frames = case
    kept = same_rows(simhash.one_per_group, frames)
    roots = brute.component_of([brute.fingerprint(r[1]) for r in rows], lambda a, b: (a ^ b).bit_count() <= 3)
    groups = defaultdict(list)
    for row in rows:
        groups[roots[brute.fingerprint(row[1])]].append(row)
    assert not Counter(kept) - Counter(rows)
    assert Counter(roots[brute.fingerprint(r[1])] for r in kept) == Counter(dict.fromkeys(groups, 1))
    for row in kept:
        ids = [r[0] for r in groups[roots[brute.fingerprint(row[1])]] if r[0] is not None]
        assert row[0] == min(ids, default=None)


def test_drop_copies(case):
    rows, frames = case
    kept = same_rows(extendible.drop_copies, frames)
    largest = {}
    for id, text, *_ in rows:
        largest[brute.lower(text)] = max(largest.get(brute.lower(text)), id, key=brute.id_key)
    assert not Counter(kept) - Counter(rows)
    assert sorted((brute.lower(r[1]), str(r[0])) for r in kept) == sorted((t, str(i)) for t, i in largest.items())


def test_emit(case):
    rows, frames = case
    emitted = same_rows(mixing.emit, frames)
    assert set(emitted) <= set(rows)
    taken = Counter()
    for r in mixing.mix(frames[0], digest=True).collect():
        taken[r.doc_id, r.source, bytes(r.sha)] += r.copies
    found = Counter((r[0], r[3], bytes.fromhex(brute.sha256(r[1] or ""))) for r in emitted)
    assert found == +taken
    each = defaultdict(set)
    for row in emitted:
        each[row[0], row[3], row[1]].add(row)
    assert all(len(found) == 1 for found in each.values())
