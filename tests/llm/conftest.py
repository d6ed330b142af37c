import duckdb
import pytest

SF = "/root/testdata/sf0.001"

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, size string, taken string, score string, chunk string, position string, h1 string"
BASE = "the quick brown fox jumps over the lazy dog while seven clever wizards mix strange potions under a pale winter moon and nobody dares to speak aloud about it".split()


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text), "x", "x", "x", "x", "x", "x", "x")


def odd_rows():
    """Nulls in every column, empty, white-space and very long texts, copies, repeated rows and clashing columns."""
    text = " ".join(BASE)
    return [
        row(1, text), row(2, text), row(2, text), row(3, text + " indeed"), row(4, None), row(5, ""), row(6, " \n\t "), row(7, "word"), row(8, "word"), row(9, "12 34 !?"),
        row(None, text), row(None, None, None, None), row(10, " ".join(f"w{i}" for i in range(40000)), None), row(11, "漢字 и слово naïve  café's x\n\n 's'll", "fr", None), row(12, "Der Hund und die Katze", "de", "b"), row(13, "\U0001F600 x" * 50, "en", "c"),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con
