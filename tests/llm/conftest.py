import duckdb
import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def texts():
    """``[(doc_id, text)]`` of the small documents table."""
    return duckdb.sql(f"select doc_id, text from '{SMALL}/documents.parquet' order by doc_id").fetchall()


LONG = " ".join(f"word{i % 977} and more" for i in range(20_000))
ROWS = [
    (1, "One plain text of some words that says nothing new.\nAnd a second line follows it here."),
    (2, None),
    (3, ""),
    (None, "A text without an id, but with words in it all the same."),
    (4, "Twice the same row, twice the same words, in every column."),
    (4, "Twice the same row, twice the same words, in every column."),
    (5, LONG),
    (6, "ça été là — naïve ÉTÉ Straße İstanbul \U0001f642 中文"),
    (7, "\n\n \t\n"),
    (8, "One plain text of some words that says nothing new.\nAnd a second line follows it here."),
]
CLASHING = "language hits signals votes fingerprint licenses deduplicated dropped_lines text_ part rank _id _lines _starts _ends _kept _k no key n".split()


@pytest.fixture
def edges(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns whose names operators use."""
    frame = spark.createDataFrame([(*r, "en", "src", 1) for r in ROWS], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name in CLASHING:
        frame = frame.selectExpr("*", f"'x' as {name}")
    return frame


@pytest.fixture
def empty(edges):
    return edges.limit(0)
