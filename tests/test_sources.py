"""Scans, schema handling, dictionaries, sinks, tokens and the checkpoint folder."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from caseloom import session
from caseloom.operators import evaluate, tokens
from caseloom.sources import datasets, dictionary
from caseloom.sources import encounters as enc


def test_encounter_csv(spark, tmp_path):
    text = "CPT1,N,I10_DX1,I10_DX2,AGE,Readmitted30,other\r\n00123,7, i10 ,nan,63.5,1,x\r\n86152,8,,E119,abc,0,y\r\n"
    (tmp_path / "raw.csv").write_bytes(b"\xef\xbb\xbf" + text.encode())
    df = enc.read_encounter_csv(spark, str(tmp_path / "raw.csv"))
    first, second = df.orderBy("N").collect()
    assert (first.CPT1, first.I10_DX1, first.I10_DX2, first.AGE, first.Readmitted30) == ("00123", "i10", None, 63.5, 1)
    assert (second.I10_DX1, second.I10_DX2, second.AGE, second.CPT100, second.other) == (None, "E119", None, None, "y")
    assert dict(df.dtypes)["Readmitted30"] == "int" and dict(df.dtypes)["I10_DX34"] == "string"
    with pytest.raises(ValueError, match="missing columns"):
        enc.require_columns(df, ["N", "Readmitted"])
    df.write.parquet(str(tmp_path / "clean"))
    assert enc.read_encounters(spark, str(tmp_path / "clean")).count() == 2


def test_csv_files_with_different_headers_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("N,I10_DX1,CPT1\n1,I10,99\n")
    (tmp_path / "b.csv").write_text("N,CPT1,I10_DX1\n2,99,I10\n")
    with pytest.raises(Exception, match="header"):
        enc.read_encounter_csv(spark, str(tmp_path)).collect()


def test_wide_array_and_long_forms(spark):
    schema = "N string, I10_DX1 string, I10_DX3 string, CPT1 string, CPT2 string"
    df = enc.conform(spark.createDataFrame([("1", "I10", "", "99", "nan")], schema))
    arrays = enc.with_code_arrays(df).first()
    assert len(arrays.dx_codes) == 34 and len(arrays.cpt_codes) == 100 and arrays.dx_codes[:2] == ["I10", None]
    long = enc.long_codes(df)
    assert sorted(tuple(r) for r in long.collect()) == [("1", "cpt", 1, "99"), ("1", "dx", 1, "I10")]
    wide = enc.widen(long.where("kind = 'dx'"), "N", {"I10_DX1": ("code", 1), "I10_DX2": ("code", 2)})
    assert tuple(wide.first()) == ("1", "I10", None)
    assert len(enc.tier_columns("rich")) == 135 and len(enc.tier_columns("limited")) == 11
    assert set(enc.tier_columns("rich")) <= set(enc.encounter_schema(True).fieldNames())


def test_first_positions_limits_before_the_shuffle(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("n"), "id")
    limited = enc.first_positions(rows, "n", ["id"], 5)
    assert limited.count() == 15
    plan = limited._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_fills(spark):
    df = spark.createDataFrame([(None, None)], "a string, b int")
    assert tuple(enc.fill_numeric(enc.fill_categorical(df, ["a"]), ["b"]).first()) == ("missing", 0)


def test_dictionary(spark, tmp_path):
    lines = ["Code,Description,", "G0103,Psa test,", "00100,First,", '"A9539  ","Tc, agent",', "0357T,Tissue,"]
    lines += [f"9{i:04d},Filler {i}," for i in range(300)] + [" G0103 ,PSA screening,"]
    (tmp_path / "codes.csv").write_bytes(b"\xef\xbb\xbf" + "\r\n".join(lines).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        names = dictionary.read_dictionary(spark, str(tmp_path / "codes.csv"))
        found = {r.code: r.description for r in names.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(found) == 304 and found["G0103"] == "PSA screening" and found["A9539"] == "Tc, agent"
    facts = spark.createDataFrame([(1, " 00100 "), (2, "357T"), (3, "0357T"), (4, None)], "n int, cpt string")
    for size in (1 << 20, 1):
        described = dictionary.describe_codes(facts, names, "cpt", ["n"], broadcast_bytes=size)
        assert {r.n: r.description for r in described.collect()} == {1: "First", 2: None, 3: "Tissue", 4: None}


def test_narrative_round_trip(spark, tmp_path):
    rows = [('He said "well",\nthen left.', 1), ("plain", 0)]
    datasets.write_csv(spark.createDataFrame(rows, "prompt string, label long"), str(tmp_path / "out"))
    back = datasets.read_narratives(spark, str(tmp_path / "out"))
    assert back.schema == datasets.NARRATIVE_SCHEMA
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows)
    with pytest.raises(ValueError, match="label"):
        datasets.narratives(back.drop("label"))


def test_tokens(spark, tmp_path):
    corpus = spark.createDataFrame([("The cat, the dog",), ("the End.",), (None,)], "text string")
    vocabulary = tokens.fit_vocabulary(corpus, "text")
    assert vocabulary.words == {"the": 4, ",": 5, ".": 6, "cat": 7, "dog": 8, "end": 9}
    df = spark.createDataFrame([(1, "THE zebra cat"), (0, ""), (1, "cat " * 600)], "label long, prompt string")
    encoded = tokens.encode(df, "prompt", vocabulary)
    found = {r.prompt[:3]: r for r in encoded.collect()}
    assert found["THE"].input_ids[:6] == [2, 4, 1, 7, 3, 0] and sum(found["THE"].attention_mask) == 5
    assert found[""].input_ids[:3] == [2, 3, 0]
    assert found["cat"].input_ids == [2, *[7] * 510, 3] and sum(found["cat"].attention_mask) == 512
    assert {len(r.input_ids) for r in found.values()} == {len(r.attention_mask) for r in found.values()} == {512}
    datasets.write_tokens(encoded, str(tmp_path / "tokens"), 512)
    back = datasets.read_tokens(spark, str(tmp_path / "tokens"))
    assert back.schema == datasets.TOKEN_SCHEMA and back.count() == 3
    with pytest.raises(Exception, match="must have 10 elements"):
        datasets.write_tokens(encoded, str(tmp_path / "bad"), 10)
    plan = encoded._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_token_count_of_blank_texts(spark):
    df = spark.createDataFrame([(None,), ("  ",), ("a-b c",)], "t string")
    assert [r[0] for r in df.select(tokens.token_count(F.col("t"))).collect()] == [0, 0, 4]


def test_pad_batches(spark):
    df = spark.createDataFrame([(1, 0, [2, 3]), (2, 0, [2, 9, 9, 3]), (3, 1, [2, 3])], "i int, b int, ids array<int>")
    found = {r.i: r.padded for r in tokens.pad_batches(df, "ids", "b", ["i"]).collect()}
    assert found == {1: [2, 3, 0, 0], 2: [2, 9, 9, 3], 3: [2, 3]}


def test_map_batches(spark):
    def count_words(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"id": batch.id, "words": batch.text.str.split().str.len()})

    df = spark.createDataFrame([(1, "a b c", "x"), (2, "d", "y")], "id long, text string, other string")
    found = tokens.map_batches(df, count_words, "id long, words long", ["id", "text"])
    assert {r.id: r.words for r in found.collect()} == {1: 3, 2: 1}


def test_run_summary(spark, tmp_path):
    rows = [(i % 2, 1 - i % 2 if i < 3 else i % 2, i / 10) for i in range(10)]
    scored = spark.createDataFrame(rows, "label int, predicted int, p double")
    report = evaluate.evaluation_summary(scored, "label", "predicted", "p", scored, scored, {"numTrees": 20})
    found = {(r.section, r.key): r.value for r in report.collect()}
    assert found["train", "rows"] == 10 and found["test", "class_1"] == 5 and found["parameters", "numTrees"] == 20
    assert found["metrics", "accuracy"] == 0.7
    for run in ("a", "b"):
        datasets.append_summary(report.withColumn("run_id", F.lit(run)), str(tmp_path / "runs"))
    stored = spark.read.parquet(str(tmp_path / "runs"))
    assert stored.select("run_id").distinct().count() == 2 and dict(stored.dtypes)["written_at"] == "timestamp"
    assert datasets.preview(stored).count() == 5


def test_checkpoint_folder(spark, tmp_path):
    root = session.checkpoint_root(spark)
    assert session.checkpoint_root(spark) == root
    df = session.materialize(spark.range(5).withColumn("x", F.col("id") * 2))
    assert df.count() == 5 and df.columns == ["id", "x"]
    assert any(root.split("/")[-1] in f for f in df.inputFiles())


def test_configured_checkpoint_folder_is_used():
    class Fake:
        """A session on a cluster that names its checkpoint folder, or does not."""

        def __init__(self, folder):
            self.folder, self.used = folder, None
            self.conf = self.sparkContext = self
            self.master = "yarn"

        def get(self, key, default=None):
            return self.folder if key == "spark.checkpoint.dir" else default

        def getCheckpointDir(self):
            return self.used

        def setCheckpointDir(self, folder):
            self.used = folder

        def getConf(self):
            return self

    named = Fake("hdfs://shared/checkpoints")
    assert session.checkpoint_root(named) == named.used == "hdfs://shared/checkpoints"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_root(Fake(None))
