"""Tokenizer, chunker, scores and the query language."""

import math

import pytest
from pyspark.sql import functions as F

from lodestone.functions import chunking
from lodestone.functions import text as T
from lodestone.operators import dense, lookup
from lodestone.plans import syntax
from lodestone.sources import listing

TEXTS = [
    "Linux kernel memory management architecture", "İşletim sistemi bellek tahsisi ve süreç yönetimi", "MemoryManager allocate_memory_block", "İslemYoneticisi", "HTTPServer parseXMLDoc _x_ __a__b__",
    "the of and", "", None, "I", "a b1 22 --- é漢字", "snake_the_case ABC ÇĞİ ABCdef x2Y",
]


def test_tokens_in_plan_and_on_driver_agree(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    for split in (True, False):
        got = {r.i: r.w for r in df.select("i", T.tokens(F.col("t"), split).alias("w")).collect()}
        assert got == {i: T.tokens_of(t or "", split) for i, t in enumerate(TEXTS)}


def test_token_goldens():
    assert set(T.tokens_of(TEXTS[0])) >= {"linux", "kernel", "memory", "management"}
    w = T.tokens_of(TEXTS[1])
    assert {"işletim", "sistemi", "bellek"} <= set(w) and "ve" not in w
    assert set(T.tokens_of(TEXTS[2])) == {"memorymanager", "memory", "manager", "allocate_memory_block", "allocate", "block"}
    assert {"islem", "yoneticisi"} <= set(T.tokens_of(TEXTS[3]))
    assert T.tokens_of("the of and") == ["the", "of", "and"]


def test_chunks():
    assert chunking.chunked(" \n ") == [] and chunking.chunked(None) == []
    assert chunking.chunked("one\n\ntwo\n \nthree") == [("one\n\ntwo\n\nthree", 1, 5)]
    sentence = " ".join(["w"] * 9) + "."
    text = " ".join([sentence] * 10)
    parts = chunking.chunked(text, most=40, overlap=10)
    assert all(p[0].count(".") <= 4 for p in parts) and len(parts) > 2
    assert parts[0][0].split(". ")[-1].strip(".") == parts[1][0].split(". ")[0].strip(".")
    long = " ".join(["w"] * 100)
    assert chunking.chunked(long, most=40) == [(long, 1, 1)]
    paras = ["a " * 20, "b " * 20, "c " * 5, "d " * 20]
    got = [c[0] for c in chunking.chunked("\n\n".join(paras), most=60, overlap=10)]
    assert got == ["a " * 19 + "a\n\n" + "b " * 19 + "b\n\n" + "c " * 4 + "c", "c " * 4 + "c\n\n" + "d " * 19 + "d"]


def test_estimated_tokens(spark):
    df = spark.createDataFrame([("",), ("a",), ("a b\u00a0c",), ("w " * 1000,)], "t string")
    assert [r[0] for r in df.select(T.estimate_tokens(F.col("t"))).collect()] == [chunking.estimated(t) for t in ("", "a", "a b\u00a0c", "w " * 1000)] == [1, 1, 3, 1300]


def test_snippets(spark):
    text = "x" * 200 + " needle " + "y" * 400
    df = spark.createDataFrame([(" short ",), (text,), ("z" * 400,), ("😀" * 150 + " NEEDLE " + "q" * 300,)], "t string")
    a, b, c, d = (r[0] for r in df.select(T.snippet(F.col("t"), "Needle")).collect())
    assert a == "short" and c == "z" * 350 + "..."
    assert b == "..." + text[101:451].strip() + "..."
    assert d == "..." + ("😀" * 150 + " NEEDLE " + "q" * 300)[51:401].strip() + "..."


def test_scores(spark):
    one = spark.range(1)
    v = one.select(T.idf(F.lit(1), F.lit(10)), T.idf(F.lit(10), F.lit(10)), T.idf(F.lit(0), F.lit(0)), T.smooth_idf(F.lit(1), F.lit(3)), T.min_max(F.lit(5.0), F.lit(5.0), F.lit(5.0), F.lit(1)), T.calibrated(F.lit(0.68))).first()
    assert v[0] == pytest.approx(math.log(9.5 / 1.5 + 1)) and v[1] == pytest.approx(math.log(0.5 / 10.5 + 1)) and v[2] == 0
    assert v[3] == pytest.approx(math.log(4 / 2) + 1) and v[4] == 1.0 and v[5] == pytest.approx(0.5)


def test_highlight_and_sizes(spark):
    r = spark.range(1).select(T.highlight(F.lit("a Cat catalog"), "cat a"), T.human_size(F.lit(2048)), T.human_size(F.lit(5)), T.duration(F.lit(125.9)), T.extension(F.lit("/a.b/.env")), T.extension(F.lit("/a/x.tar.GZ"))).first()
    assert list(r) == ["a <mark>Cat</mark> <mark>cat</mark>alog", "2.0 KB", "5 B", "2:05", "", ".gz"]


def test_query_language():
    q = syntax.parse('auth memory allocation ext:py,ts -ext:tmp path:"app/services" type:code after:2026-01-01 symbol:AuthHandler')
    assert (q.text, q.extensions, q.exclude_extensions, q.path, q.file_type, q.symbol) == ("auth memory allocation", {".py", ".ts"}, {".tmp"}, "app/services", "code", "AuthHandler")
    assert q.after == 1767225600 and q.has_filters
    assert syntax.parse("İşlemHavuzu workerThreadPool ext:py").text == "İşlemHavuzu workerThreadPool"
    assert syntax.parse("http://x y").text == "http://x y" and syntax.parse("not:ext:pdf").text == "not:ext:pdf"
    assert syntax.parse("") == syntax.Query() and not syntax.parse("a type:nothing after:tomorrow").has_filters
    assert syntax.parse("to:31.12.2025").before == 1767225599
    m = syntax.parse("ext:pdf path:docs/ after:2026-01-01")
    assert syntax.matches(m, "/home/user/docs/manual.pdf", ".pdf", 1.8e9) and not syntax.matches(m, "/home/user/docs/x.docx", ".docx", 1.8e9) and not syntax.matches(m, "/images/x.pdf", ".pdf", 1.8e9)
    assert syntax.matches(syntax.parse("type:code"), "/a.json", ".json", 0) and not syntax.matches(syntax.parse("type:doc"), "/a.json", ".json", 0)


def test_safe_paths(spark):
    paths = [("/a/b.txt", 1), ("/a/.git/x", 1), ("/a/node_modules/x.py", 1), ("/a/.hidden/x", 1), ("/a/.bashrc", 1), ("/a/.x.py", 1), ("/a/x.tmp", 1), ("/a/id_rsa.pub", 1), ("/a/my.env", 1), ("/a/big.pdf", 60 * 2**20), ("/a/noext", 1)]
    df = spark.createDataFrame(paths, "p string, n long")
    for fallback in (True, False):
        got = [r[0] for r in df.select(lookup.safe_path(F.col("p"), F.col("n"), fallback)).collect()]
        assert got == [listing.safe(p, n, fallback) for p, n in paths]
    assert [listing.safe(p, n) for p, n in paths] == [True, False, False, False, False, True, False, False, False, False, True]


def test_vectors(spark):
    v = spark.createDataFrame([(101, [3.0, 4.0]), (102, [0.0, 5.0]), (103, [0.0, 0.0])], "chunk_id long, embedding array<float>")
    u = dense.normalised(v)
    assert [round(r[0], 5) for r in u.orderBy("chunk_id").select(dense.norm(F.col("embedding"))).collect()] == [1.0, 1.0, 0.0]
    among = spark.createDataFrame([(101,)], "chunk_id long")
    assert [r.chunk_id for r in dense.vector_top(u, [0.0, 2.0], 5, among).collect()] == [101]
    assert [r.chunk_id for r in dense.vector_top(u, [0.0, 2.0], 2).collect()] == [102, 101]
    assert dense.upsert_vectors(u, v.where("chunk_id = 101")).count() == 3
    wide = [float(i % 7) for i in range(200)]
    w = spark.createDataFrame([(1, wide)], "chunk_id long, embedding array<float>")
    assert w.select(dense.dot(F.col("embedding"), wide)).first()[0] == sum(x * x for x in wide)
