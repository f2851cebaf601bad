"""Lookup tables with small and large parts: only rows of the large ones are shuffled, and keys are counted only where one can be hot."""

from pyspark.sql import functions as F

from caseloom.operators import encode, joins

FIELDS = "col string, code string, n int"


def cells():
    """Column "few" has two codes, "many" 300; a column and a code that no level table holds, and NULLs."""
    rows = [("few", "AB"[i % 2], i) for i in range(100)] + [("many", f"c{i % 300:03d}", i) for i in range(600)]
    return rows + [("few", "Z", 900), ("few", None, 901), ("many", "Z", 902), ("many", None, 903), ("other", "A", 904), (None, "A", 905)]


def watch(monkeypatch):
    """What is handed to the shuffle join: the columns of the facts and of the lookup table."""
    seen, join = [], joins.spread_join

    def spread(facts, dim, *rest, **named):
        seen.append([{r.col for r in side.select("col").distinct().collect()} for side in (facts, dim)])
        return join(facts, dim, *rest, **named)

    monkeypatch.setattr(joins, "spread_join", spread)
    return seen


def test_only_columns_with_many_levels_are_shuffled(spark, monkeypatch):
    df = spark.createDataFrame(cells(), FIELDS)
    fitted = df.where("col IN ('few', 'many') AND code <> 'Z'")
    levels = encode.level_table(fitted, "col", "code")
    numbers = {("few", "A"): 0, ("few", "B"): 1, **{("many", f"c{i:03d}"): i for i in range(300)}}
    wanted = sorted(map(str, ((col, code, n, numbers.get((col, code), -1)) for col, code, n in cells())))
    seen = watch(monkeypatch)
    for limit, shuffled in ((1 << 20, []), (1000, [[{"many", "other", None}, {"many"}]]), (1, [[{"few", "many", "other", None}, {"few", "many"}]])):
        coded = encode.ordinal_encode(df, levels, "col", "code", ["n"], limit)
        assert coded.columns == ["col", "code", "n", "ordinal"]
        assert sorted(str(tuple(r)) for r in coded.collect()) == wanted
        assert seen == shuffled
        seen.clear()
        back = encode.decode_levels(coded.drop("code"), levels, "col", "code", limit)
        found = {r.n: r.code for r in back.where("n >= 900 OR col = 'few'").collect()}
        assert found == {**{i: "AB"[i % 2] for i in range(100)}, **dict.fromkeys(range(900, 906))}
        assert {(r.n, r.code) for r in back.where("col = 'many' AND n < 900").collect()} == {(i, f"c{i % 300:03d}") for i in range(600)}
        assert seen == shuffled
        seen.clear()


def test_dear_facts_are_not_read_for_each_part(spark, monkeypatch):
    df = spark.createDataFrame(cells(), FIELDS)
    levels = encode.level_table(df.where("col IS NOT NULL"), "col", "code")
    seen = watch(monkeypatch)
    found = encode.ordinal_encode(df.where("n >= 0"), levels, "col", "code", ["n"], 1000, measured=df)
    assert found.count() == len(cells()) and len(seen) == 1 and "few" in seen[0][0]


def test_small_parts_fit_together(spark):
    rows = [("a", 1)] * 2 + [("b", 1)] * 3 + [("c", 1)] * 4 + [(None, 1)]
    df = spark.createDataFrame(rows, "part string, v int")  # 33 bytes a row
    wanted = {65: [], 66: ["a"], 164: ["a"], 165: ["a", "b"], 1000: ["a", "b", "c"]}
    assert {limit: joins.small_parts(df, "part", limit) for limit in wanted} == wanted


def test_no_key_is_hot_by_an_accident_of_the_sample(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT_SAMPLE", 200)
    even = spark.range(3000).select((F.col("id") % 300).alias("k"))
    assert joins.hot_keys(even, ["k"], hot_share=0.01, hot_floor=100) is None  # ten rows a key
    monkeypatch.undo()
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.col("id") % 500)
    hot = joins.hot_keys(spark.range(3000).select(key.alias("k")), ["k"], hot_share=0.01, hot_floor=100)
    assert {r.k: r._fan for r in hot.collect()} in ({7: 10, None: 10}, {7: 11, None: 10})
