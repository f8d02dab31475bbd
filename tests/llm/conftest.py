"""Small tables with everything that may go wrong in them."""

import pytest

LOREM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(n, step=7, start=0):
    return " ".join(LOREM[(start + i * step + i * i // 5) % len(LOREM)] + str(i % 11 if i % 4 == 0 else "") for i in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns named like inner ones."""
    rows = [
        (1, prose(60), "en", "a"),
        (2, prose(60), "en", "a"),
        (3, prose(60) + " end", "en", "b"),
        (4, None, "en", "a"),
        (5, "", None, None),
        (6, "  \n\t ", "de", "b"),
        (7, "word " * 30_000, "de", "b"),
        (8, "x" * 50_000, "fr", None),
        (9, prose(300, 3, 5), "en", "c"),
        (9, prose(300, 3, 5), "en", "c"),
        (None, prose(40, 11, 2), None, "c"),
        (12, "één große ñandú \U0001f600 日本語 текст", "de", "a"),
        (13, prose(80, 9, 4), "fr", "a"),
    ]
    schema = "doc_id long, text string, lang string, source string, rk long, fp long, row string, id long, size long, kept boolean, bytes long, rid long, _text string"
    return spark.createDataFrame([(*r, 7, None, "r", 3, 4, True, 5, 6, "t") for r in rows], schema)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 0), (None, 1, 0), (3, None, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")


def rows(df):
    return [tuple(r) for r in df.collect()]
