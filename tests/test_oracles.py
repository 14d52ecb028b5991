"""Every query of the engine against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from tidemark.plans import catalogue as registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, tables, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), tables.execute(registry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want)

    def rows(df):
        out = []
        for row in df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False):
            out.append(tuple(f"{float(x):.6g}" if isinstance(x, (float, int)) and not isinstance(x, bool) else str(x)[:10] for x in row))
        return sorted(out)

    assert rows(got) == rows(want)


def test_queries_without_sql_run(spark):
    for name in set(registry.queries()) - set(registry.oracle_sql()):
        assert registry.queries()[name](spark, SF).count() > 0
