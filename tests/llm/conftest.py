import pytest
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"

#: Rows that every operator on documents must take: nulls, empty and long texts, repeats, ties.
ODD = [
    (900001, None),
    (900002, ""),
    (900003, "A b"),
    (900004, "a B "),
    (900004, "a B "),
    (None, "a b"),
    (None, "zz"),
    (900005, "q" * 450),
    (900006, "é" * 150 + "x"),
    (900007, "<|endoftext|> a  b\t \n c "),
    (900008, "word " * 3000),
    (900009, " \n\t "),
    (900010, "漢字" * 2000 + "𝒳"),
]


def documents(spark, rows):
    return spark.createDataFrame([(*r, None, None, None) for r in rows], DOCUMENT)


@pytest.fixture(scope="session")
def docs(spark):
    """A small table with the odd rows, and columns whose names clash with those operators use inside."""
    given = spark.read.parquet(f"{FOLDER}/documents.parquet")
    both = given.unionByName(documents(spark, ODD))
    return both.withColumns({"key": F.lit(1), "cid": F.lit("x"), "component": F.lit(2), "score": F.lit(0.5)})


@pytest.fixture(scope="session")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
