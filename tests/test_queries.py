"""Every search query against its SQL in DuckDB, over the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from sonda.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def rows(df: pd.DataFrame) -> list:
    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return "null"
        return round(float(v), 5) + 0.0 if isinstance(v, (int, float)) or hasattr(v, "item") else str(v)

    df = df.astype(object)[sorted(df.columns)]
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLE_SQL:
        want = con.execute(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got) > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(QUERIES) <= set(e.queries()) and set(ORACLE_SQL) <= set(e.oracle_sql())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_json_schemas():
    from sonda.plans.json_schema import index_schema, search_request

    kinds = {x["properties"]["type"]["const"] for x in index_schema()["additionalProperties"]["oneOf"]}
    assert kinds == {"vectorFlat", "vectorVamana", "text", "string", "stringArray", "integer", "float"}
    q = search_request()["$defs"]["query"]["properties"]
    assert kinds < set(q) and q["_and"]["items"] == {"$ref": "#/$defs/query"} and q["integer"]["properties"]["operator"]["enum"][-1] == "inRange"
