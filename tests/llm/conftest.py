import pytest

from samples import EXTRA, prose


@pytest.fixture(scope="session")
def edge_rows():
    """(doc_id, text): nulls, empty and very long texts, ties, repeated rows."""
    base = prose(1, 60)
    return [(1, base), (2, None), (3, ""), (4, prose(2, 30000)), (5, base), (5, base), (None, "some text without a number"), (None, None), (6, "a"), (7, "   \n "), (8, "ñandú 日本語 😀 'tis x’s"), (9, "x" * 5000), (10, prose(3, 60))]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    n = len(EXTRA.split(","))
    return spark.createDataFrame([(i, t, *[None] * n) for i, t in edge_rows], "doc_id bigint, text string, " + EXTRA).repartition(3)


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.limit(0)
