"""The registered queries and their oracles on the smallest tables."""

import glob
import math
import os
import random

import duckdb
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from lodestone.functions.chunking import chunked
from lodestone.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the synthetic tables aren't here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    plain = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert _rows(df.columns, map(tuple, df.collect())) == _rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_an_oracle_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_oracle_of_chunks_packs_paragraphs_as_the_chunker():
    r = random.Random(5)
    sentence = lambda: " ".join("w" * r.randint(1, 9) for _ in range(r.choice((3, 20, 60, 500)))) + r.choice((".", "!", "", "?"))
    paragraph = lambda: r.choice((" ", "\n", "  ")).join(sentence() for _ in range(r.choice((1, 1, 2, 9))))
    texts = ["", " \n\n ", *(r.choice(("\n\n", "\n \n\n")).join(paragraph() for _ in range(r.randint(1, 9))) for _ in range(60))]
    docs = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts})
    c = duckdb.connect()
    c.register("documents", docs)
    want = [(d, n, *x) for d, t in enumerate(texts) for n, x in enumerate(chunked(t))]
    assert sorted(c.sql(catalog.ORACLES["chunks"]).project("doc_id, chunk_index, text, start_line, end_line").fetchall()) == want
