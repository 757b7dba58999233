import pytest

LONG = "word " * 30_000 + "end."


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns whose names the operators use themselves."""
    rows = [
        (1, "The cat sat on the mat and it was happy there all day long.", "en", "s", 5), (1, "The cat sat on the mat and it was happy there all day long.", "en", "s", 5),
        (2, None, "en", None, None), (3, "", None, "s", 0), (None, "The cat sat on the mat and it was happy there all day long.", None, "s", 1), (None, None, None, None, None),
        (4, LONG, "en", "s", 9), (5, "!!! ???", "fr", "s", 7), (6, "Le chat est sur la table et il dort depuis ce matin dans la maison.", "fr", "s", 7), (7, "a", "en", "s", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("key", "sig", "label", "held_out_", "score", "node", "c", "band", "words", "row_key", "spans"):
        df = df.selectExpr("*", f"'x' as {name}")
    return df


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
