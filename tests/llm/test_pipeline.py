import brute
import sentencepiece
from oracle import connect, differences
from test_copies import assert_same

import corpus_pipeline
from caseloom.llm import piece_viterbi, queries


def test_pipeline_equals_brute_force(spark, folder, documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text", "source").collect()]
    rows = [r for r, (_, kept) in zip(rows, brute.quality([r[1] for r in rows]), strict=True) if kept]
    rows = [r for r, e in zip(rows, brute.exact([(r[0], r[1]) for r in rows]), strict=True) if e[3]]
    rows = [r for r, e in zip(rows, brute.near_copies([(r[0], r[1]) for r in rows]), strict=True) if e[0] == e[2]]
    copies = {e[0]: e[5] for e in brute.mix(rows)}
    model = sentencepiece.SentencePieceProcessor(model_file=piece_viterbi.default_model())
    expected = [(r[0], str(model.encode(r[1]))) for r in rows for _ in range(copies[r[0]])]
    found = corpus_pipeline.run(spark, folder).collect()
    assert_same([(r.doc_id, str(r.ids)) for r in found], expected)
    assert all(r.round_trip for r in found)


def test_stages_survive_odd_rows(spark, odd_documents, no_documents):
    for docs in (odd_documents, no_documents):
        names = docs.schema.names
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = spark.createDataFrame(stage(spark, docs, "").collect(), docs.schema)
            assert docs.schema.names == names
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == docs.count()


def test_queries_equal_their_sql(spark, folder):
    connection = connect(folder)
    for name, sql in queries.ORACLES.items():
        assert not differences(queries.QUERIES[name](spark, folder), connection, sql), name


def test_clean_documents_stay(spark, folder, documents):
    """Good labels only lose documents that are copies or mixed out, never by the quality stage."""
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("quality = 1")
    good = documents.join(labels, "doc_id", "left_semi")
    kept = corpus_pipeline.quality_rules(spark, documents, folder).join(good, "doc_id", "left_semi")
    short = [r.doc_id for r in good.collect() if len(brute.words(r.text)) < 50 or brute.base_failed(brute.measures(r.text))]
    assert kept.count() == good.count() - len(short)
