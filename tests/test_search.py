"""Search over a small index built by hand."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import lexical
from lodestone.plans import search as S
from lodestone.schema import CHUNKS, POSTINGS, SYMBOLS, VECTORS, Index

NOW = 1_800_000_000.0
DOCS = "doc_id long, path string, filename string, extension string, size_bytes long, mtime double"


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame([(1, "/p/doc1.txt", "doc1.txt", ".txt", 9, NOW - 100), (2, "/p/doc2.py", "doc2.py", ".py", 9, NOW - 20 * 86400.0), (3, "/q/cache.py", "cache.py", ".py", 9, NOW - 90 * 86400.0)], DOCS)
    chunks = [(11, 1, 0, "linux kernel process", None, None, None, None, 1, 1, 6), (12, 1, 1, "linux again", None, None, None, None, 1, 1, 6), (13, 1, 2, "linux third", None, "Linux Notes", None, None, 1, 1, 6), (21, 2, 0, "python database linux", None, None, "python", "FastCache", 1, 1, 6), (31, 3, 0, "nothing here", None, None, "python", None, 1, 1, 6)]
    postings = [("linux", 1, 11, 2), ("kernel", 1, 11, 1), ("process", 1, 11, 1), ("linux", 1, 12, 1), ("linux", 1, 13, 1), ("python", 2, 21, 2), ("database", 2, 21, 1), ("linux", 2, 21, 1), ("here", 3, 31, 1)]
    symbols = [(1, 2, 21, "FastCache", "class", 1), (2, 2, 21, "FastCache", "class", 9), (3, 3, None, "orphan_cache", "function", 2)]
    vectors = [(11, [1.0, 0.0]), (21, [0.6, 0.8]), (31, [0.0, 1.0])]
    return Index(docs, spark.createDataFrame(chunks, CHUNKS), spark.createDataFrame(symbols, SYMBOLS), spark.createDataFrame(postings, POSTINGS), spark.createDataFrame(vectors, VECTORS))


def _ids(df):
    return [r.chunk_id for r in df.collect()]


def test_rankings(index):
    b = lexical.bm25(index.postings, index.chunks, "linux kernel").collect()
    assert b[0].chunk_id == 11 and b[0].bm25 > 0
    assert _ids(lexical.tfidf(index.postings, index.chunks, "python")) == [21]
    assert _ids(lexical.bm25(index.postings, index.chunks, "kern")) == [11]
    assert _ids(lexical.bm25(index.postings, index.chunks, "zzz")) == [] and _ids(lexical.bm25(index.postings, index.chunks, "")) == []


def test_an_empty_index(spark):
    i = Index(spark.createDataFrame([], DOCS), *(spark.createDataFrame([], s) for s in (CHUNKS, SYMBOLS, POSTINGS, VECTORS)))
    assert S.search(i, "linux", NOW).count() == 0 and S.search(i, "ext:py", NOW).count() == 0 and S.search(i, "  ", NOW).count() == 0
    assert lexical.corpus_summary(i.chunks).first().avg_tokens == 0


def test_the_weakest_of_several_goes_and_a_document_gives_two(index):
    found = S.results(index, "linux", NOW, alpha=1.0).collect()
    assert {r.doc_id for r in found} == {1} and len(found) <= 2
    page, total = S.search_paginated(index, "linux", NOW, limit=1)
    assert page.count() == 1 and total.first().total == len(S.results(index, "linux", NOW).collect())


def test_alpha_picks_the_side(index):
    dense = S.search(index, "linux", NOW, alpha=0.0, query_vector=[0.0, 1.0]).collect()
    assert dense[0].chunk_id == 31 and dense[0].semantic_score == 1.0


def test_filters_names_and_recency(index):
    found = S.search(index, "cache ext:py", NOW).collect()
    assert {r.chunk_id for r in found} <= {21, 31} and found[0].chunk_id == 31  # the name; the symbol is weaker
    only = S.search(index, "ext:py", NOW).collect()
    assert [(r.chunk_id, round(r.score, 2)) for r in only] == [(21, 0.74), (31, 0.70)]
    assert [r.chunk_id for r in S.search(index, "type:code linux", NOW).collect()] == [21]
    assert S.search(index, "linux path:nowhere", NOW).count() == 0
    assert S.search_code(index, "linux", NOW).select("chunk_id").collect()[0][0] == 21


def test_reranking_is_idempotent(index, spark):
    r = spark.createDataFrame([(1, 1, 0.4, "İslemYoneticisi", None, "a.py", "text")], "chunk_id long, doc_id long, raw_score double, symbol_name string, section string, filename string, snippet string")
    once = S.reranked(r, "islem")
    assert once.first().score == S.reranked(once, "islem").first().score == pytest.approx(0.55)
    assert S.reranked(r, "islem", symbols=False).first().score == pytest.approx(0.4)


def test_symbols(index):
    got = S.search_symbol(index, "CACHE").collect()
    assert [(r.name, r.chunk_id, r.code_snippet) for r in got] == [("FastCache", 21, "python database linux"), ("FastCache", 21, "python database linux"), ("orphan_cache", None, "")]


def test_filter_before_top_and_recency_switch(index):
    assert S.search(index, "linux ext:py", NOW, filter_before_top=True).count() == 1
    a = S.search(index, "linux", NOW, recency_in_rank=True).first()
    assert a.score == pytest.approx(min(1.0, S.search(index, "linux", NOW).first().score + 0.08))


def test_scans_are_pruned_and_filtered(spark, index, tmp_path):
    index.postings.write.parquet(str(tmp_path / "p"))
    df = lexical.bm25(spark.read.parquet(str(tmp_path / "p")), index.chunks, "linux kernel", fallback=False)
    plan = df._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term, [kernel,linux])" in plan and "CartesianProduct" not in plan
