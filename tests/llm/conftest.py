import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from curbside.llm.tables import ship

    return ship(spark)


@pytest.fixture(scope="session")
def tables(spark):
    """The smallest given tables."""
    return lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")


LONG = "lorem ipsum dolor sit amet " * 4000

#: (doc_id, text): nulls, empty and very long texts, ties, repeated rows.
EDGES = [
    (1, "one two three four five six seven"), (2, "ONE two three\tfour five\nsix seven"), (3, None), (4, ""), (5, " \n\t "),
    (6, LONG), (7, LONG + "end"), (8, "short"), (9, "Short"), (10, "12345 !!! ---"), (None, "no id here at all friend"), (None, None),
    (11, "repeated row of a few words"), (11, "repeated row of a few words"), (12, "x" * 3000),
]


@pytest.fixture(scope="session")
def edges(spark):
    """Edge cases, with further columns whose names the operators use themselves, in clashing types."""
    rows = spark.createDataFrame(EDGES, "doc_id long, text string")
    extra = {name: F.lit("clash") for name in ("node", "key", "n", "start", "score", "lang_pred", "_text", "_spans", "row", "block", "piece", "a.b")}
    return rows.withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long"), **extra})


@pytest.fixture(scope="session")
def no_docs(edges):
    return edges.limit(0)
