"""Column expressions over single codes and arrays of codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseloom.functions.columns import bind

WHITESPACE = " \t\n\r\f\x0b"

# The texts that mean "no code", and the two answers for codes outside every chapter.
NO_CODE = ("", "nan", "missing")
UNCLASSIFIED = "Unclassified Code"
INCOMPLETE = "Incomplete Code"

# ICD-10 chapter ranges over the first three characters, with their titles.
CHAPTERS = (
    ("A00", "B99", "Certain infectious and parasitic diseases"),
    ("C00", "D49", "Neoplasms"),
    ("D50", "D89", "Diseases of the blood and blood-forming organs"),
    ("E00", "E89", "Endocrine, nutritional and metabolic diseases"),
    ("F01", "F99", "Mental, Behavioral and Neurodevelopmental disorders"),
    ("G00", "G99", "Diseases of the nervous system"),
    ("H00", "H59", "Diseases of the eye and adnexa"),
    ("H60", "H95", "Diseases of the ear and mastoid process"),
    ("I00", "I99", "Diseases of the circulatory system"),
    ("J00", "J99", "Diseases of the respiratory system"),
    ("K00", "K95", "Diseases of the digestive system"),
    ("L00", "L99", "Diseases of the skin and subcutaneous tissue"),
    ("M00", "M99", "Diseases of the musculoskeletal system and connective tissue"),
    ("N00", "N99", "Diseases of the genitourinary system"),
    ("O00", "O9A", "Pregnancy, childbirth and the puerperium"),
    ("P00", "P96", "Certain conditions originating in the perinatal period"),
    ("Q00", "Q99", "Congenital malformations, deformations and chromosomal abnormalities"),
    ("R00", "R99", "Symptoms, signs and abnormal clinical and laboratory findings"),
    ("S00", "T88", "Injury, poisoning and certain other consequences of external causes"),
    ("V00", "Y99", "External causes of morbidity"),
    ("Z00", "Z99", "Factors influencing health status and contact with health services"),
)


def strip(code: Column) -> Column:
    return F.btrim(code, F.lit(WHITESPACE))


def clean_code(code: Column) -> Column:
    """Trimmed code; blanks and the text ``nan`` become NULL, the single meaning of "no code"."""
    return F.nullif(F.nullif(strip(code), F.lit("")), F.lit("nan"))


def has_text(value: Column) -> Column:
    """True when the value is neither NULL nor blank."""
    return value.isNotNull() & (strip(value) != "")


def valid_code(code: Column) -> Column:
    """True for a real code: not NULL, not blank, not a placeholder text."""
    return code.isNotNull() & ~strip(code).isin(*NO_CODE)


def count_valid(codes: Column) -> Column:
    """Number of real codes in an array column."""
    return F.size(F.filter(codes, valid_code))


def code_prefix(code: Column, length: int = 3) -> Column:
    return F.upper(F.substring(strip(code), 1, length))


def chapter(code: Column) -> Column:
    """Chapter title of a diagnosis code; the trimmed prefix is computed once. For code rows ``add_chapter`` is faster."""

    def title(prefix: Column) -> Column:
        found = F.when(F.length(prefix) < 3, F.lit(INCOMPLETE))
        for low, high, name in CHAPTERS:
            found = found.when(prefix.between(low, high), F.lit(name))
        return found.otherwise(F.lit(UNCLASSIFIED))

    return F.when(code.isNotNull() & (code != ""), bind(code_prefix(code), title))


def classified(title: Column) -> Column:
    """The title, or NULL when the code fell outside every chapter."""
    return F.when(~title.isin(UNCLASSIFIED, INCOMPLETE), title)


def distinct_in_order(values: Column) -> Column:
    """NULL-free distinct values, first occurrence kept."""
    return F.array_distinct(F.filter(values, lambda v: v.isNotNull()))


def ordinal_suffix(number: Column) -> Column:
    tens, ones = F.pmod(number, F.lit(100)), F.pmod(number, F.lit(10))
    return (
        F.when(tens.between(10, 20), "th")
        .when(ones == 1, "st")
        .when(ones == 2, "nd")
        .when(ones == 3, "rd")
        .otherwise("th")
    )
