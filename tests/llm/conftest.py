import pytest

from caseloom.llm import queries  # noqa: F401  the package is there, or these tests are not either

#: Columns that the operators use inside.
CLASHING = "key string, fp long, size long, copies long, kept boolean, bucket long, token string, row long, part long, copy long, sha string"
FILLER = (None,) * 11


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, near and exact copies, other columns."""
    long = " ".join(f"Wort{i % 7919}ä" for i in range(60_000))
    plain = " ".join(f"word{i}" for i in range(120))
    rows = [
        (1, plain, "en", "a"),
        (2, plain.upper(), "en", "a"),
        (3, plain + " more", "en", "b"),
        (4, "", "en", "b"),
        (5, None, None, None),
        (6, " \t\n\x0b\x0c\r ", "de", "b"),
        (7, long, "de", "c"),
        (8, long, "de", "c"),
        (9, "one two", "fr", None),
        (9, "one two", "fr", None),
        (9, "three four", "fr", "c"),
        (None, "three FOUR", "fr", "c"),
        (None, None, None, None),
        (10, "\x00 🎉 ▁ end\n", "xx", ""),
        (11, plain.replace("word7 ", "WÖRD7 "), "en", "a"),
        (12, "dup line here\n" * 40 + plain, "en", "a"),
    ]
    rows = [(*r, None if r[1] is None else len(r[1]), *FILLER) for r in rows]
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"
    return spark.createDataFrame(rows, schema).repartition(5).persist()


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.where("false")


@pytest.fixture(scope="session")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")
