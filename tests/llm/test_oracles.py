"""The operators' SQL against their queries, on the smallest tables."""

import duckdb
import pytest

from lodestone.llm import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    want = con.execute(catalog.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    as_text = lambda rows: sorted(map(repr, rows))
    assert as_text(want.fetchall()) == as_text(map(tuple, df.select(*names).collect()))
