import pytest


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and columns that clash with inner names."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(9_000))
    same = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    rows = [(1, same), (2, same), (2, same), (3, None), (4, ""), (None, same), (None, None), (5, long), (6, long + " more"), (7, "x"), (8, "  \t\n "), (9, "é" * 300), (10, "a" * 400), (11, "İ ﬁ 漢字 ​ 🙂 end"), (100, "seven eight nine")]
    data = [(i, t, "x", "y", 1, 2, 3.0, "z") for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, n string, rep string, chunk int, leader int, score double, band string")
