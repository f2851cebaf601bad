"""Hand-worked cases for code functions, buckets, score and narratives."""

import pytest
from pyspark.sql import functions as F

from caseloom.functions import codes, numbers
from caseloom.operators import comorbidity
from caseloom.operators.chapters import add_chapter
from caseloom.operators.narrative import narrative, narratives_from_codes

CIRCULATORY = "Diseases of the circulatory system"
ENDOCRINE = "Endocrine, nutritional and metabolic diseases"
RESPIRATORY = "Diseases of the respiratory system"

CHAPTER_CASES = [
    ("I10", CIRCULATORY),
    (" e11.9 ", ENDOCRINE),
    ("C4A0", "Neoplasms"),
    ("M1A0", "Diseases of the musculoskeletal system and connective tissue"),
    ("O9A1", "Pregnancy, childbirth and the puerperium"),
    ("D49", "Neoplasms"),
    ("D50", "Diseases of the blood and blood-forming organs"),
    ("H59", "Diseases of the eye and adnexa"),
    ("H60", "Diseases of the ear and mastoid process"),
    ("T88", "Injury, poisoning and certain other consequences of external causes"),
    *[(code, "Unclassified Code") for code in ("D90", "E90", "F00", "K96", "T89", "U07", "123", "~~~")],
    ("I1", "Incomplete Code"),
    ("   ", "Incomplete Code"),
    ("", None),
    (None, None),
]


def texts(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def column(df, value):
    return [row[0] for row in df.orderBy("i").select(value).collect()]


def test_chapter_expression_and_join_agree(spark):
    df = texts(spark, [c for c, _ in CHAPTER_CASES])
    expected = [title for _, title in CHAPTER_CASES]
    assert column(df, codes.chapter(F.col("v"))) == expected
    assert column(add_chapter(df, "v"), "title") == expected


def test_valid_codes(spark):
    values = ["I10", None, "", " ", "nan", "missing", " E119 "]
    row = spark.createDataFrame([(values,)], "v array<string>")
    assert row.select(codes.count_valid(F.col("v"))).first()[0] == 2


def test_clean_code(spark):
    assert column(texts(spark, [" A1\t", "nan", " ", None]), codes.clean_code(F.col("v"))) == ["A1", None, None, None]


def test_ordinal_suffix(spark):
    cases = {1: "st", 2: "nd", 3: "rd", 4: "th", 21: "st", 101: "st", 111: "th", 112: "th"}
    cases |= {n: "th" for n in range(10, 21)}
    df = texts(spark, list(cases), "int")
    assert column(df, codes.ordinal_suffix(F.col("v"))) == list(cases.values())


def test_score_bucket(spark):
    cases = {
        None: "Unknown Score", -1.0: "Unknown Score", -0.5: "0 (No Comorbidities)", 0.0: "0 (No Comorbidities)",
        2.9: "2", 5.0: "5-6", 6.0: "5-6", 9.0: "7-9", 10.0: "10+ (Very High Risk)", float("nan"): "Unknown Score",
        float("inf"): "10+ (Very High Risk)",
    }
    assert column(texts(spark, list(cases), "double"), numbers.score_bucket(F.col("v"))) == list(cases.values())


def test_count_bucket(spark):
    few, many, unknown = numbers.count_groups("Diagnoses")
    df = texts(spark, [None, -1.0, 0.0, 5.0, 5.5, 6.0], "double")
    assert column(df, numbers.count_bucket(F.col("v"), "Diagnoses")) == [unknown, unknown, few, few, many, many]


def test_lenient_double(spark):
    values = ["12", " 3.5 ", "-1e2", ".5", "12d", "abc", "", "nan", None, "1,5"]
    expected = [12.0, 3.5, -100.0, 0.5, None, None, None, None, None, None]
    assert column(texts(spark, values), numbers.lenient_double(F.col("v"))) == expected


def test_embedding_size(spark):
    df = texts(spark, [1, 2, 3, 99, 100, 1000], "int")
    assert column(df, numbers.embedding_size(F.col("v"))) == [1, 1, 2, 50, 50, 50]


def test_probabilities(spark):
    df = texts(spark, [[0.0, 0.0], [1000.0, 0.0], [-1.0, 1.0]], "array<double>")
    assert column(df, numbers.argmax(F.col("v"))) == [0, 0, 1]
    result = column(df, numbers.softmax(F.col("v")))
    assert result[0] == [0.5, 0.5] and result[1] == [1.0, 0.0]
    assert result[2][1] == pytest.approx(0.880797077977882)
    half = texts(spark, [0.5, 0.50001, 0.0], "double")
    assert column(half, numbers.above(F.col("v"))) == [0, 1, 0]


def test_prefix_rules():
    rules = comorbidity.rule_rows()
    prefixes = [p for p, _ in rules]
    assert len(prefixes) == len(set(prefixes)) == 289
    assert {len(p) for p in prefixes} == {3, 4}
    assert not [p for p in prefixes if len(p) == 4 and p[:3] in prefixes]
    assert set(comorbidity.PREFIXES) == set(comorbidity.WEIGHTS) and sum(comorbidity.WEIGHTS.values()) == 33


@pytest.mark.parametrize(
    "present, expected",
    [
        ([], 0),
        (["diabetes_w_complications", "diabetes_wo_complications"], 2),
        (["moderate_or_sever_liver_disease", "mild_liver_disease"], 3),
        (["cancer", "metastitic_carcinoma"], 6),
        (["myocardial_infarction", "renal_disease", "aids_hiv"], 9),
        (list(comorbidity.CONDITIONS), 29),
    ],
)
def test_score_of_flags(spark, present, expected):
    flags = spark.range(1).select(*[F.lit(c in present).alias(c) for c in comorbidity.CONDITIONS])
    assert flags.select(comorbidity.flag_score(flags)).first()[0] == expected


def test_score_uses_only_conditions_that_exist(spark):
    flags = spark.sql("SELECT CAST(NULL AS BOOLEAN) AS dementia, true AS cancer")
    assert flags.select(comorbidity.flag_score(flags)).first()[0] == 2


def test_score_ignores_order_duplicates_case_and_blanks(spark):
    rows = [(1, c) for c in ("I21", "e10.2", "E109", " c77 ", "C00", None, "")]
    rows += [(2, c) for c in ("C00", "C77", "E109", "E109", "i219", "E1021", "x")] + [(3, None)]
    long = spark.createDataFrame(rows, "n int, code string")
    masks = comorbidity.condition_mask(long, "n", "code")
    found = {r.n: r.s for r in masks.select("n", comorbidity.mask_score(F.col("mask")).alias("s")).collect()}
    assert found == {1: 9, 2: 9, 3: 0}
    wide = long.groupBy("n").agg(F.collect_list("code").alias("codes"))
    assert {r.n: r.score for r in comorbidity.add_array_score(wide, "codes").collect()} == found


def test_score_join_keeps_row_count_with_repeated_ids(spark):
    encounters = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "n int, x string")
    masks = comorbidity.condition_mask(spark.createDataFrame([(1, "I21"), (1, "I21")], "n int, code string"), "n", "code")
    scored = comorbidity.add_score(encounters, masks, "n")
    assert sorted((r.x, r.score) for r in scored.collect()) == [("a", 1), ("b", 1), ("c", 0), ("d", 0)]


PLAIN = "This patient was admitted to the hospital"
SCORE = "The calculated Charlson Comorbidity Index score for this encounter was {}."
NARRATIVE_CASES = [
    (
        ["I10", "E119", "E785", None, "J449"],
        2.0,
        ["Red cell", None, "Red cell"],
        f"{PLAIN} primarily for {CIRCULATORY}. Co-occurring conditions included {ENDOCRINE}, {RESPIRATORY}. "
        + SCORE.format(2)
        + " Key procedures performed included Red cell.",
    ),
    (["U071"], None, [], f"{PLAIN} with primary diagnosis code U071."),
    ([None, " "], 0.0, [None], f"{PLAIN}. {SCORE.format(0)}"),
    (
        ["I10", "I252"],
        None,
        [],
        f"{PLAIN} primarily for {CIRCULATORY}. Co-occurring conditions included {CIRCULATORY}.",
    ),
    ([], 1.9, [], f"{PLAIN}. {SCORE.format(1)}"),
]


def test_narrative_from_arrays(spark):
    rows = [(i, dx, score, names) for i, (dx, score, names, _) in enumerate(NARRATIVE_CASES)]
    df = spark.createDataFrame(rows, "i int, dx array<string>, score double, names array<string>")
    text = narrative(F.col("dx"), F.col("score"), F.col("names"))
    assert column(df, text) == [expected for *_, expected in NARRATIVE_CASES]


def test_narrative_from_code_rows(spark):
    encounters, lines = [], []
    for i, (dx, score, names, _) in enumerate(NARRATIVE_CASES):
        encounters.append((i, score))
        for pos in range(max(len(dx), len(names))):
            pick = [values[pos] if pos < len(values) else None for values in (dx, names)]
            lines.append((i, pos + 1, *pick))
    left = spark.createDataFrame(encounters, "i int, score double")
    right = spark.createDataFrame(lines, "i int, pos int, dx string, name string")
    text = narratives_from_codes(left, right, "i", "dx", "name", "score")
    assert column(text, "prompt") == [expected for *_, expected in NARRATIVE_CASES]
