import pytest

LONG = "lorem ipsum dolor " * 20_000
DOC = "doc_id long, text string, lang string, source string, n_chars long, th long, spans string, root string, size long, score double, _kept boolean, _draw string, _nth int, _fp long, _kept_id long, _hit_marks string, row string, draw string, quota long, _quality int"


def row(i, text, lang="en", source="a"):
    return (i, text, lang, source, len(text) if text else None, 1, "x", "y", 5, 0.5, None, "d", 1, 2, 3, "m", "r", "w", 4, 6)


@pytest.fixture(scope="session")
def odd(spark):
    """Null and empty values, repeated rows, one very long text, columns whose names operators use themselves."""
    rows = [
        row(1, None), row(2, ""), row(3, "  \n\t "), row(4, "one"), row(4, "one"), row(None, "one two three four five"), row(None, None), row(5, LONG),
        row(6, "Alpha beta, gamma! " * 40, None, None), row(7, "Alpha beta, gamma! " * 40), row(7, "another text with this id"), row(8, "naïve café – ÉTÉ 你好 \U0001f600 " * 30, "fr", "b"),
        row(9, "x"), row(10, "a b c d e f g h i j k l m", "de", "b"),
    ]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, "A, b. c d e f g h i j!"), (None, "gamma alpha beta"), (3, None), (4, ""), (5, "one two three")], "item_id long, text string")


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, q, t) for i, q, t in ((1, 0, 0), (2, 1, None), (4, 1, 0), (6, 1, 1), (7, 0, 0), (8, None, 0), (9, 1, 1), (None, 1, 1), (99, 0, 1), (10, 2, 0), (5, 1, 0))]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
