"""Queries on encounters larger than any in the given tables."""

import datetime

from caseloom.plans import datasets
from caseloom.sources import encounters as enc


def star_tables(spark, folder, sizes):
    """Orders and lines with the columns that the encounter views read; encounter ``n`` has ``sizes[n]`` lines."""
    day = datetime.date(2020, 1, 1)
    orders = [(n, n, day, "O") for n in sizes]
    lines = [(n, i, i, 0, day, 1.0, 0.0, 0.01, "F") for n, size in sizes.items() for i in range(1, size + 1)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate date, o_orderstatus string").write.parquet(
        f"{folder}/orders.parquet"
    )
    spark.createDataFrame(
        lines,
        "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_shipdate date, l_quantity double, "
        "l_discount double, l_tax double, l_linestatus string",
    ).write.parquet(f"{folder}/lineitem.parquet")


def test_encounter_csv_keeps_all_34_diagnoses(spark, tmp_path):
    star_tables(spark, tmp_path, {1: 40, 2: 21, 3: 3})
    found = datasets.encounter_csv(spark, str(tmp_path)).collect()
    code = lambda i: f"{chr(65 + i % 26)}{i * 37 % 100:02d}1"
    dx = {(r.n, r.pos): r.code for r in found if r.kind == "dx"}
    assert dx == {(n, i): code(i) for n, size in {"1": 34, "2": 21, "3": 3}.items() for i in range(1, size + 1)}
    assert sum(r.kind == "cpt" for r in found) == 64 and sum(r.kind == "age" for r in found) == 3


def test_absent_code_columns_are_null(spark, tmp_path):
    path = str(tmp_path / "raw")
    spark.createDataFrame([("1", "I10", "99213")], "N string, I10_DX1 string, CPT1 string").write.option("header", True).csv(path)
    read = enc.read_encounter_csv(spark, path)
    assert {*enc.DX_COLUMNS, *enc.CPT_COLUMNS} <= set(read.columns)
    assert [(r.kind, r.pos, r.code) for r in enc.long_codes(read).collect()] == [("dx", 1, "I10"), ("cpt", 1, "99213")]
