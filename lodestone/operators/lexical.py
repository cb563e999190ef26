"""Postings, their statistics, BM25 and TF-IDF."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone import config
from lodestone.functions import text as T
from lodestone.schema import Index

#: Postings that the prefix fallback takes a term.
PREFIX_ROWS = 100


def analysed(chunks: DataFrame) -> DataFrame:
    """chunks with `tokens`, their distinct words. Written once, it gives both lengths and postings."""
    return chunks.withColumn("tokens", T.tokens(F.col("text")))


def _tokens(chunks: DataFrame):
    return F.col("tokens") if "tokens" in chunks.columns else T.tokens(F.col("text"))


def token_rows(chunks: DataFrame) -> DataFrame:
    """doc_id, chunk_id, term: the distinct words of each chunk."""
    return chunks.select("doc_id", "chunk_id", F.explode(_tokens(chunks)).alias("term"))


def postings(chunks: DataFrame) -> DataFrame:
    """term, doc_id, chunk_id, term_freq. Words of a chunk are distinct, so term_freq is 1 as indexed."""
    return token_rows(chunks).select("term", "doc_id", "chunk_id", F.lit(1).alias("term_freq"))


def token_counts(chunks: DataFrame) -> DataFrame:
    """chunks with token_count: distinct words, at least 1."""
    return chunks.withColumn("token_count", F.greatest(F.lit(1), F.size(_tokens(chunks))))


def index_stats(index: Index) -> DataFrame:
    """One row: documents, chunks, symbols, terms, tokens."""
    parts = (
        (index.documents, F.count("*").alias("documents")),
        (index.chunks, F.count("*").alias("chunks")),
        (index.symbols, F.count("*").alias("symbols")),
        (index.postings, F.count_distinct("term").alias("terms")),
        (index.chunks, F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens")),
    )
    rows = [df.agg(c) for df, c in parts]
    out = rows[0]
    for r in rows[1:]:
        # One row each.
        out = out.crossJoin(F.broadcast(r))
    return out


def term_stats(posting_rows: DataFrame) -> DataFrame:
    """term, doc_freq: chunks that hold it. (term, chunk_id) is a key, so counting rows is counting chunks."""
    return posting_rows.groupBy("term").agg(F.count("*").alias("doc_freq"))


def refreshed_stats(stats: DataFrame, posting_rows: DataFrame, terms: DataFrame) -> DataFrame:
    """stats with the given terms counted anew; a term without postings goes."""
    anew = term_stats(posting_rows.join(terms.select("term").distinct(), "term", "left_semi"))
    return stats.join(terms.select("term").distinct(), "term", "left_anti").unionByName(anew)


def frequencies(stats: DataFrame, terms: DataFrame, absent: int = 0) -> DataFrame:
    """term, doc_freq of the given terms; `absent` for those without postings."""
    return terms.select("term").distinct().join(stats, "term", "left").select("term", F.coalesce("doc_freq", F.lit(absent)).alias("doc_freq"))


def posting_lists(posting_rows: DataFrame, terms: list[str]) -> DataFrame:
    """term, postings: sorted array of (chunk_id, doc_id, term_freq)."""
    found = posting_rows.where(F.col("term").isin(terms))
    return found.groupBy("term").agg(F.sort_array(F.collect_list(F.struct("chunk_id", "doc_id", "term_freq"))).alias("postings"))


def corpus_summary(chunks: DataFrame) -> DataFrame:
    """One row: n_chunks, avg_tokens (0 for no chunk)."""
    return chunks.agg(F.count("*").alias("n_chunks"), F.coalesce(F.avg("token_count"), F.lit(0.0)).alias("avg_tokens"))


def term_frame(spark: SparkSession, terms: list[str]) -> DataFrame:
    return spark.createDataFrame([(t,) for t in terms], "term string")


def prefix_postings(posting_rows: DataFrame, prefixes: list[str], most: int = PREFIX_ROWS) -> DataFrame:
    """Postings of terms that start with one of the prefixes (two characters or more): the first `most` of each prefix by term and chunk."""
    longer = [p for p in prefixes if len(p) >= 2]
    if not longer:
        return posting_rows.limit(0).withColumn("prefix", F.lit(""))
    each = F.explode(F.filter(F.array(*map(F.lit, longer)), lambda p: F.col("term").startswith(p)))
    some = posting_rows.where(reduce(lambda a, b: a | b, [F.col("term").startswith(p) for p in longer]))
    order = Window.partitionBy("prefix").orderBy("term", "chunk_id")
    return some.withColumn("prefix", each).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def bm25(posting_rows: DataFrame, chunks: DataFrame, query: str, top: int | None = 100, k1: float = config.BM25_K1, b: float = config.BM25_B, fallback: bool = True) -> DataFrame:
    """chunk_id, bm25: Okapi scores of the query's words, best first, ties by chunk_id.

    Filters on the terms reach the scan of postings; what is then joined and
    grouped are the matching rows alone. Whether any word has a posting, on
    which the prefix fallback depends, is asked first: one small job that
    stops at the first row.
    """
    spark = posting_rows.sparkSession
    terms = T.tokens_of(query)
    if not terms:
        return spark.createDataFrame([], "chunk_id long, bm25 double")
    summary = corpus_summary(chunks)
    hit = F.col("term").isin(terms)
    exact = posting_rows.where(hit).select("term", "chunk_id", "term_freq")
    if fallback and exact.isEmpty():
        # A term that several prefixes reach has a row for each, as each word of the query counts.
        exact = prefix_postings(posting_rows, terms).select("term", "chunk_id", "term_freq")
        hit = reduce(lambda a, b: a | b, [F.col("term").startswith(t) for t in terms])
    stats = term_stats(posting_rows.where(hit))
    lengths = chunks.select("chunk_id", F.col("token_count").cast("double").alias("length"))
    hits = exact.join(stats, "term").join(lengths, "chunk_id", "left").crossJoin(F.broadcast(summary))
    weight = T.idf(F.col("doc_freq"), F.col("n_chunks"))
    hits = hits.withColumn("idf", weight).where((F.col("idf") > 0) & (F.col("avg_tokens") > 0))
    length = F.coalesce("length", F.floor("avg_tokens").cast("double"))
    scored = hits.groupBy("chunk_id").agg(F.sum(T.bm25_weight(F.col("idf"), F.col("term_freq"), length, F.col("avg_tokens"), k1, b)).alias("bm25"))
    return scored.orderBy(F.desc("bm25"), "chunk_id").limit(top) if top else scored


def tfidf(posting_rows: DataFrame, chunks: DataFrame, query: str, top: int = 50) -> DataFrame:
    """chunk_id, tfidf: cosine of the query's and the chunk's weights over the query's words."""
    spark = posting_rows.sparkSession
    terms = T.tokens_of(query)
    if not terms:
        return spark.createDataFrame([], "chunk_id long, tfidf double")
    n = F.broadcast(chunks.agg(F.count("*").alias("n_chunks")))
    found = posting_rows.where(F.col("term").isin(terms)).select("term", "chunk_id", "term_freq")
    weights = frequencies(term_stats(found), term_frame(spark, terms)).crossJoin(n).withColumn("idf", T.smooth_idf(F.col("doc_freq"), F.col("n_chunks")))
    weights = weights.withColumn("q", F.col("idf") / len(terms)).select("term", "idf", "q")
    norm = F.broadcast(weights.agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("q_norm")))
    totals = found.groupBy("chunk_id").agg(F.sum("term_freq").alias("total"))
    d = F.col("term_freq") / F.col("total") * F.col("idf")
    # At most as many weights as the query has words.
    rows = found.join(totals, "chunk_id").join(F.broadcast(weights), "term").withColumn("d", d)
    cos = rows.groupBy("chunk_id").agg(F.sum(F.col("d") * F.col("q")).alias("dot"), F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("d_norm")).crossJoin(norm)
    score = F.when((F.col("d_norm") > 0) & (F.col("q_norm") > 0), F.col("dot") / (F.col("d_norm") * F.col("q_norm"))).otherwise(0.0)
    return cos.select("chunk_id", score.alias("tfidf")).where("tfidf > 0").orderBy(F.desc("tfidf"), "chunk_id").limit(top)
