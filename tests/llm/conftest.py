import pytest

from tests.conftest import spark  # noqa: F401

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, th string, spans string, fp int, c double"
LONG = "tok lorem " * 40_000 + "password = 'Zx81!kqPw02LmNbv'"


@pytest.fixture(scope="session")
def edges(spark):  # noqa: F811
    """Nulls, empty, blank, repeated, tied, very long and odd texts, with extra columns whose names operators use too."""
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen " * 6
    texts = [(None, None), (None, "x"), (1, ""), (1, ""), (2, " \n\t "), (3, base), (3, base), (4, base), (5, base + "more"), (6, "Ä" * 300), (7, "a" * 450), (8, LONG), (9, LONG), (10, "Mr. Peter Fox, +1 (212) 555-0100 a@b.example 4111 1111 1111 1111"), (11, "🙂 é\x00\x85 ſecret: abcdefgh TOKEN=abcdef 10.0.0.1"), (None, base), (12, "one two"), (13, "ONE two,")]
    rows = [(i, t, "en" if t else None, None, len(t or ""), 1, "x", None, 5, 0.5) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):  # noqa: F811
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):  # noqa: F811
    return spark.read.parquet(f"{SF}/documents.parquet")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)
