import brute
import pytest
from test_copies import assert_same

from caseloom.llm import mixing, weak_rules

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_exclaims", "n_distinct", "n_lines"]


@pytest.mark.parametrize("name", ["odd_documents", "documents"])
def test_quality(name, request):
    docs = request.getfixturevalue(name)
    rows = docs.select("doc_id", "text").collect()
    judged = brute.quality([r.text for r in rows])
    expected = [(r.doc_id, *[m[c] for c in BASE], brute.base_failed(m), kept) for r, (m, kept) in zip(rows, judged, strict=True)]
    found = weak_rules.quality(docs).select("doc_id", *BASE, "base_failed", "kept")
    assert_same(found.collect(), expected)


def test_accept_keeps_what_quality_keeps(odd_documents, no_documents, documents):
    for docs in (odd_documents, documents):
        kept = weak_rules.accept(docs)
        assert kept.schema.names == docs.schema.names
        rows = docs.collect()
        judged = brute.quality([r.text for r in rows])
        assert_same(kept.collect(), [r for r, (_, k) in zip(rows, judged, strict=True) if k])
    assert weak_rules.accept(no_documents).count() == weak_rules.quality(no_documents).count() == 0


def test_estimation_finds_the_better_rules(spark):
    """Rules that agree with a planted class more often get a higher accuracy."""
    import random

    pick, names = random.Random(3), list(weak_rules.RULES)
    planted = [0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.9, 0.6]
    rows = []
    for _ in range(4000):
        good = pick.random() < 0.7
        rows.append([0 if pick.random() < 0.1 else (1 if (pick.random() < a) == good else -1) for a in planted])
    voted = spark.createDataFrame(rows, names).groupBy(*names).count().withColumnRenamed("count", "rows")
    model = weak_rules.fit(voted)
    assert abs(model["prior"] - 0.7) < 0.05
    for name, accuracy in zip(names, planted, strict=True):
        assert abs(model["accuracies"][name] - accuracy) < 0.06


def test_quality_agrees_with_labels(spark, folder, documents):
    """Held-out accuracy: labels are not used by the rules."""
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = weak_rules.quality(documents).join(labels, "doc_id").where("not base_failed").select("kept", "quality").collect()
    right = sum(r.kept == (r.quality == 1) for r in found)
    assert right >= 0.9 * len(found) and all(r.kept for r in found if r.quality == 1)


def trimmed(rows):
    return [(*r[:4], round(r[4], 6), *r[5:]) for r in map(tuple, rows)]


@pytest.mark.parametrize("name", ["odd_documents", "documents"])
def test_mix(name, request):
    docs = request.getfixturevalue(name)
    rows = docs.select("doc_id", "text", "source").collect()
    found = mixing.mix(docs).collect()
    expected = brute.mix([tuple(r) for r in rows])
    totals = {}
    if name == "documents":
        assert_same(trimmed(found), trimmed(expected))
    for r in found:
        goal = totals.setdefault(r.source, [r.target, 0, 0])
        goal[1] += r.taken
        goal[2] = max(goal[2], r.size)
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
    assert len(found) == len(rows) and abs(sum(g[0] for g in totals.values()) - sum(r.size for r in found)) < 1e-3
    for target, taken, longest in totals.values():
        assert abs(taken - target) <= longest + 1e-6


def test_mix_does_not_depend_on_partitions(documents):
    assert_same(mixing.mix(documents).collect(), mixing.mix(documents.repartition(7)).collect())


def test_emit_repeats_rows(odd_documents, no_documents, documents):
    emitted = mixing.emit(documents)
    assert emitted.schema.names == documents.schema.names
    counts = {r.doc_id: r["count"] for r in emitted.groupBy("doc_id").count().collect()}
    assert counts == {r.doc_id: r.copies for r in mixing.mix(documents).collect() if r.copies}
    odd = mixing.emit(odd_documents)
    assert odd.schema.names == odd_documents.schema.names
    assert odd.count() == sum(r.copies for r in mixing.mix(odd_documents).collect())
    assert mixing.emit(no_documents).count() == mixing.mix(no_documents).count() == 0


def test_targets_reshare_what_is_above(spark):
    sizes = {"a": 10, "b": 1, "c": 100, "d": 0, None: 5, "é": 3, "z": 1}
    found = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    assert {r.source: round(r.target, 9) for r in found} == {s: round(t, 9) for s, t in brute.targets(sizes).items()}
