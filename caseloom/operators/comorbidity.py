"""Comorbidity flags, weights, hierarchy and score (Charlson index over ICD-10 code prefixes)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions.codes import strip
from caseloom.functions.slots import slot_lookup, slot_table
from caseloom.operators.joins import spread_join
from caseloom.sources.constants import constant_table

# Condition names, with weights. The spelling of the names is part of the output schema.
WEIGHTS = {
    "myocardial_infarction": 1,
    "congestive_heart_failure": 1,
    "periphral_vascular_disease": 1,
    "cerebrovascular_disease": 1,
    "dementia": 1,
    "chronic_pulmonary_disease": 1,
    "connective_tissue_disease_rheumatic_disease": 1,
    "peptic_ulcer_disease": 1,
    "mild_liver_disease": 1,
    "diabetes_wo_complications": 1,
    "paraplegia_and_hemiplegia": 2,
    "renal_disease": 2,
    "diabetes_w_complications": 2,
    "cancer": 2,
    "moderate_or_sever_liver_disease": 3,
    "metastitic_carcinoma": 6,
    "aids_hiv": 6,
}
CONDITIONS = tuple(WEIGHTS)

# When both members of a pair are present, only the severe one counts.
SEVERE_OVER_MILD = (
    ("diabetes_w_complications", "diabetes_wo_complications"),
    ("moderate_or_sever_liver_disease", "mild_liver_disease"),
    ("metastitic_carcinoma", "cancer"),
)

# ICD-10 prefixes after Quan et al., Medical Care 43(11), 2005; "A-B" is a range over the last digit(s).
# Written from the published table without access to it here: verify before any clinical use.
PREFIXES = {
    "myocardial_infarction": "I21 I22 I252",
    "congestive_heart_failure": "I099 I110 I130 I132 I255 I420 I425-I429 I43 I50 P290",
    "periphral_vascular_disease": "I70 I71 I731 I738 I739 I771 I790 I792 K551 K558 K559 Z958 Z959",
    "cerebrovascular_disease": "G45 G46 H340 I60-I69",
    "dementia": "F00-F03 F051 G30 G311",
    "chronic_pulmonary_disease": "I278 I279 J40-J47 J60-J67 J684 J701 J703",
    "connective_tissue_disease_rheumatic_disease": "M05 M06 M315 M32-M34 M351 M353 M360",
    "peptic_ulcer_disease": "K25-K28",
    "mild_liver_disease": "B18 K700-K703 K709 K713-K715 K717 K73 K74 K760 K762-K764 K768 K769 Z944",
    "diabetes_wo_complications": (
        "E100 E101 E106 E108 E109 E110 E111 E116 E118 E119 E120 E121 E126 E128 E129 "
        "E130 E131 E136 E138 E139 E140 E141 E146 E148 E149"
    ),
    "paraplegia_and_hemiplegia": "G041 G114 G801 G802 G81 G82 G830-G834 G839",
    "renal_disease": "I120 I131 N032-N037 N052-N057 N18 N19 N250 Z490-Z492 Z940 Z992",
    "diabetes_w_complications": (
        "E102-E105 E107 E112-E115 E117 E122-E125 E127 E132-E135 E137 E142-E145 E147"
    ),
    "cancer": "C00-C26 C30-C34 C37-C41 C43 C45-C58 C60-C76 C81-C85 C88 C90-C97",
    "moderate_or_sever_liver_disease": "I850 I859 I864 I982 K704 K711 K721 K729 K765-K767",
    "metastitic_carcinoma": "C77-C80",
    "aids_hiv": "B20-B22 B24",
}


def expand_prefixes(text: str) -> list[str]:
    """``"I425-I427 I43"`` → ``["I425", "I426", "I427", "I43"]``."""
    found = []
    for item in text.split():
        first, _, last = item.partition("-")
        last = last or first
        digits = len(first) - 1
        found += [f"{first[0]}{number:0{digits}d}" for number in range(int(first[1:]), int(last[1:]) + 1)]
    return found


def rule_rows() -> list[tuple[str, str]]:
    return [(prefix, condition) for condition, text in PREFIXES.items() for prefix in expand_prefixes(text)]


def rules_frame(spark: SparkSession) -> DataFrame:
    """The built-in rule table ``(prefix, condition)``."""
    return constant_table(spark, ["prefix", "condition"], rule_rows())


def _bit(condition: str) -> int:
    return 1 << CONDITIONS.index(condition)


def condition_mask(codes: DataFrame, key: str, code: str, also: tuple[Column, ...] = ()) -> DataFrame:
    """``(key, mask)``: one bit per condition found among the codes of a key, plus the aggregates in ``also``.

    Two probes of the small rule table per code, then one map-side combined aggregate whose state is a single long, so a
    key with any number of codes stays cheap. No rule is a prefix of another, so at most one probe hits.
    """
    bits = [(prefix, _bit(condition)) for prefix, condition in rule_rows()]
    rules = constant_table(codes.sparkSession, ["prefix", "bit"], bits)
    bare = F.upper(F.replace(strip(F.col(code)), F.lit("."), F.lit("")))
    probes = codes.withColumns({"_p3": F.substring(bare, 1, 3), "_p4": F.substring(bare, 1, 4)})
    short = F.broadcast(rules.select(F.col("prefix").alias("_p3"), F.col("bit").alias("_b3")))
    long = F.broadcast(rules.select(F.col("prefix").alias("_p4"), F.col("bit").alias("_b4")))
    hits = probes.join(long, "_p4", "left").join(short, "_p3", "left")
    mask = F.coalesce(F.bit_or(F.coalesce("_b4", "_b3")), F.lit(0).cast("long")).alias("mask")
    return hits.groupBy(key).agg(mask, *also)


def mask_of_array(codes: Column) -> Column:
    """The same mask from an array of codes in one row, without a shuffle: two constant-table lookups per code."""
    bits = {prefix: _bit(condition) for prefix, condition in rule_rows()}
    table = slot_table(bits)

    def add(mask: Column, bare: Column) -> Column:
        found = [slot_lookup(bits, F.substring(bare, 1, length), table) for length in (4, 3)]
        return mask.bitwiseOR(F.coalesce(*found, F.lit(0).cast("long")))

    present = F.filter(codes, lambda c: c.isNotNull())
    bare = F.transform(present, lambda c: F.upper(F.replace(strip(c), F.lit("."), F.lit(""))))
    return F.coalesce(F.aggregate(bare, F.lit(0).cast("long"), add), F.lit(0).cast("long"))


def add_array_score(df: DataFrame, codes: str, out: str = "score") -> DataFrame:
    """Score of the codes in an array column; the mask is its own step so that it is computed once per row."""
    masked = df.withColumn("_mask", mask_of_array(F.col(codes)))
    return masked.withColumn(out, mask_score(F.col("_mask"))).drop("_mask")


def has_condition(mask: Column, condition: str) -> Column:
    return mask.bitwiseAND(F.lit(_bit(condition)).cast("long")) != 0


def flags(masks: DataFrame, mask: str = "mask") -> DataFrame:
    """Replace the mask by one boolean column per condition."""
    others = [c for c in masks.columns if c != mask]
    return masks.select(*others, *[has_condition(F.col(mask), c).alias(c) for c in CONDITIONS])


def weighted_score(present: dict[str, Column]) -> Column:
    """Sum of weights over the conditions given as boolean columns, minus the milder member of each full pair.

    Absent conditions are simply left out of ``present``; NULL counts as false.
    """
    flag = {name: F.coalesce(column, F.lit(False)) for name, column in present.items()}
    score = F.lit(0)
    for name, weight in WEIGHTS.items():
        if name in flag:
            score = score + F.when(flag[name], weight).otherwise(0)
    for severe, mild in SEVERE_OVER_MILD:
        if severe in flag and mild in flag:
            score = score - F.when(flag[severe] & flag[mild], WEIGHTS[mild]).otherwise(0)
    return score.cast("int")


def mask_score(mask: Column) -> Column:
    return weighted_score({c: has_condition(mask, c) for c in CONDITIONS})


def flag_score(df: DataFrame) -> Column:
    """Score from whichever condition columns the frame has."""
    return weighted_score({c: F.col(c) for c in CONDITIONS if c in df.columns})


def add_score(
    encounters: DataFrame, masks: DataFrame, key: str, out: str = "score", measured: DataFrame | None = None
) -> DataFrame:
    """Attach the score to every encounter; keys without any code get 0.

    ``masks`` has one row per key, so repeated ids cannot multiply rows; a very frequent id is split.
    """
    scores = masks.select(key, mask_score(F.col("mask")).alias(out))
    joined = spread_join(encounters, scores, [key], encounters.columns, measured=measured)
    return joined.select(*encounters.columns, F.coalesce(out, F.lit(0)).alias(out))
