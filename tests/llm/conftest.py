import pytest

from checks.compare import connect


@pytest.fixture(scope="session")
def duck(folder):
    return connect(folder)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and long texts, rows repeated in full, columns with names the operators use."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(20_000))
    share = " ".join(f"shared{i}" for i in range(60))
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \t\n ", None, None, None), (4, long, "en", "b", len(long)),
        (5, f"one two {share} three", "en", "b", 1), (6, f"{share} four", "de", "a", 1), (7, "é ß 中文 😀 word", "fr", "c", 1),
        (8, "a", "en", "c", 1), (9, "a a a a a a a a", "en", "c", 1), (10, f"one two {share} three", "en", None, 1),
    ]
    rows = [(*r, 7, "x", 1.5, [1], "s") for r in rows]
    return spark.createDataFrame(
        rows,
        "doc_id long, text string, lang string, source string, n_chars long, digit int, node string, size double, n array<int>, component string",
    ).repartition(3)


@pytest.fixture(scope="session")
def nulled_docs(spark, odd_docs):
    """The same with a row of nulls and one row twice."""
    nothing = spark.createDataFrame([tuple([None] * len(odd_docs.columns))], odd_docs.schema)
    return odd_docs.union(nothing).union(odd_docs.filter("doc_id = 8"))
