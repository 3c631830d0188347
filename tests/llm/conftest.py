import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and very long texts, ties, repeated rows and other columns of like names."""
    long = "lorem ipsum dolor " * 20000
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    rows = [
        (None, "a text without an id", "en", None, 1), (1, None, None, "s", None), (2, "", "en", "s", 0), (3, long, "en", "a/b", len(long)), (4, base, "en", "a/b", len(base)), (5, base, "en", "a/c", len(base)), (5, base, "en", "a/c", len(base)),
        (6, base.replace("kappa", "other"), "en", "c", 0), (7, "x" * 50000, "en", "c", 0), (8, "\n \t", "en", "c", 0), (9, "日本語 テキスト é É ß", "ja", "c", 0),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for extra in ("id", "sig", "e", "value", "kind", "score", "TEXT2", "grade", "l", "n"):
        df = df.selectExpr("*", f"'clash' as {extra}")
    return df.repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
