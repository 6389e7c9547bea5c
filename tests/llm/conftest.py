import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    """200 documents and more."""
    return spark.read.parquet(f"{SMALL}/documents.parquet").cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, clashing column names."""
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa. " * 6000
    rows = [
        (1, "the first words of a text that is long enough to be judged by rules, truly", "en", "a", 1),
        (2, None, "en", None, 2), (3, "", None, "b", 3), (4, " \t\n ", "en", "b", 4), (5, "word", None, None, None),
        (6, long, "en", "a", 5), (7, "!!! 123 ???", "en", "a", 6), (8, "x" * 200_000, "en", "a", 7),
        (None, "no id has this one text of several words", "en", "a", 8),
        (9, "a text that comes twice with the same id and all", "en", "a", 9),
        (9, "a text that comes twice with the same id and all", "en", "a", 9),
        (10, "İß 中文 \U0001F600 é \x1c\x85  z", "de", "c", 10),
    ]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, score bigint")
    names = ["n_words", "shard", "sig", "component_id", "found", "lang_pred", "block", "node", "kept_", "query"]
    return frame.selectExpr("*", *[f"'x' AS {n}" for n in names], "doc_id AS DOC_NO").cache()


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")
