import itertools
from collections import Counter, defaultdict

import brute
import pytest
from oracle import connect, differences
from pyspark.sql import functions as F
from test_copies import assert_same

from caseloom.llm import filter_audit, queries


def fails(text):
    found, text = brute.words(text), text or ""
    failed = "A" if len(found) < 200 else ""
    failed += "B" if 100 * len(set(found)) < 50 * len(found) else ""
    failed += "C" if 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text) else ""
    return failed + ("D" if set(text) & set("#$%&*|") else "")


def audit(rows, labels):
    """rows (id, text, part), labels (id, quality, toxic): every order applied to every row, one by one."""
    ids = defaultdict(set)
    for id, text, _ in rows:
        ids[text or ""].add(id)
    out = []
    listed = []
    for id, text, part in rows:
        known = ids[text or ""] - {None}
        again = any(o < id for o in known) if id is not None else bool(known)
        own = [lab for lab in labels if lab[0] == id and id is not None]
        good, toxic = any(lab[1] == 1 for lab in own), any(lab[2] == 1 for lab in own)
        listed.append((part or "", fails(text) + ("E" if again else ""), good, toxic))
    removed_by = Counter()
    for order in itertools.permutations("ABCDE"):
        for part in {r[0] for r in listed}:
            alive = [r for r in listed if r[0] == part]
            gone = []
            for step, name in enumerate(order, 1):
                lost = [r for r in alive if name in r[1]]
                late = [r for r in gone if name in r[1]]
                alive = [r for r in alive if name not in r[1]]
                gone += lost
                alone = [r for r in listed if r[0] == part and r[1] == name]
                removed_by[part, name] += len(lost)
                row = [part, "".join(order), step, len(alive), len(lost), len(late), len(alone)]
                out.append([*row, sum(r[2] for r in lost), sum(r[3] for r in lost), name])
    return [(*r[:9], removed_by[r[0], r[9]]) for r in out]


LABELS = "doc_id long, quality long, toxic long, mask int, part string"


def labelled(spark, rows):
    return spark.createDataFrame([(*r, None, None) for r in rows], LABELS)


def test_odd_rows(spark, odd_documents, no_documents):
    labels = [(1, 1, 0), (2, 0, 1), (3, 1, 1), (9, 1, None), (9, None, 1), (None, 1, 1), (8, 1, 0), (99, 1, 1), (13, None, None)]
    more = [(20, "A B #" * 80, "en"), (21, "A B #" * 80, None), (19, "A B #" * 80, "de"), (19, "A B #" * 80, "de"), (22, "w " * 300, "en")]
    docs = odd_documents.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string"))
    rows = [tuple(r) for r in docs.collect()]
    found = filter_audit.audit(docs, labelled(spark, labels))
    assert_same(found.collect(), audit(rows, labels))
    assert_same(filter_audit.audit(odd_documents, labelled(spark, labels)).collect(), audit([(r.doc_id, r.text, r.lang) for r in odd_documents.collect()], labels))
    assert filter_audit.audit(no_documents, labelled(spark, labels)).count() == 0
    assert filter_audit.audit(docs, labelled(spark, [])).agg(F.sum("good_lost")).first()[0] == 0


def test_query_equals_sql_and_brute_force(spark, folder, documents):
    found = queries.op12_filter_audit(spark, folder)
    assert not differences(found, connect(folder), queries.ORACLES["op12_filter_audit"])
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality", "toxic")
    rows = [tuple(r) for r in documents.select("doc_id", "text", "lang").collect()]
    assert_same(found.collect(), audit(rows, [tuple(r) for r in labels.collect()]))


@pytest.mark.parametrize("blocks", [1, 7])
def test_sketch_clears_only_unique_texts(spark, blocks):
    """Every repeated text is a possible repeat, also in a sketch that is far too full, and few others where it is not."""
    rows = spark.range(20000).select((F.col("id") % 15000).alias("text"))
    rows = rows.select(F.xxhash64(F.col("text").cast("string")).alias("hash"), "text")
    repeated = filter_audit.sketch(rows.select("hash"), blocks)
    found = {r.text for r in filter_audit.possible_repeats(rows, repeated, blocks).select("text").distinct().collect()}
    assert set(range(5000)) <= found
    if blocks == 7:
        assert len(found) < 6500


def test_result_does_not_depend_on_the_sketch(spark, documents, monkeypatch):
    labels = labelled(spark, [])
    usual = filter_audit.audit(documents, labels).collect()
    monkeypatch.setattr(filter_audit, "MOST_BLOCKS", 1)
    monkeypatch.setattr(filter_audit, "blocks_for", lambda rows: 1)
    assert_same(filter_audit.audit(documents.repartition(3), labels).collect(), usual)
