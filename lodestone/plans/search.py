"""Hybrid search as one lazy plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from lodestone import config
from lodestone.functions import text as T
from lodestone.operators import dense, lexical, lookup
from lodestone.plans.syntax import Query, parse
from lodestone.schema import RESULT, Index


def _pooled() -> WindowSpec:
    """All rows of a score table in one task. Score tables are pools: cut to POOL rows or a page's need before they get here."""
    return Window.partitionBy()


def with_names(bm25: DataFrame, names: DataFrame, symbols: DataFrame) -> DataFrame:
    """chunk_id, bm25 with what names and symbols add.

    A hit of weight w adds w * max where the chunk has no score yet, else half
    of it; names come before symbols, and max is the best lexical score (1 if
    there is none).
    """
    hits = names.select("chunk_id", F.lit(0).alias("kind"), "weight").unionByName(symbols.select("chunk_id", F.lit(1).alias("kind"), "weight"))
    # The first hit is the one of least kind; symbols of one chunk are taken the heaviest first.
    order = Window.partitionBy("chunk_id").orderBy("kind", F.desc("weight"))
    hits = hits.withColumn("n", F.row_number().over(order)).groupBy("chunk_id").agg(F.sum("weight").alias("all"), F.sum(F.when(F.col("n") == 1, F.col("weight"))).alias("first"))
    both = bm25.join(hits, "chunk_id", "full_outer").withColumn("most", F.coalesce(F.max("bm25").over(_pooled()), F.lit(1.0)))
    fresh = (F.col("first") + (F.col("all") - F.col("first")) * 0.5) * F.col("most")
    added = F.when(F.col("all").isNull(), F.col("bm25")).when(F.col("bm25").isNull(), fresh).otherwise(F.col("bm25") + F.col("all") * F.col("most") * 0.5)
    return both.select("chunk_id", added.alias("bm25"))


def normalised(scores: DataFrame, column: str) -> DataFrame:
    """The column spread over [0, 1] by the least and greatest of all rows."""
    x = scores.withColumns({"_low": F.min(column).over(_pooled()), "_high": F.max(column).over(_pooled()), "_n": F.count("*").over(_pooled())})
    value = F.when(F.col("_high") <= 0, 0.0).otherwise(T.min_max(F.col(column), F.col("_low"), F.col("_high"), F.col("_n")))
    return x.select("chunk_id", value.alias(column))


def fused(bm25: DataFrame, semantic: DataFrame, alpha: float = config.ALPHA) -> DataFrame:
    """chunk_id, raw_score, bm25_score, semantic_score above the floor, of chunks that either side has."""
    # A single semantic score keeps its value, which min_max does too.
    both = normalised(bm25, "bm25").join(normalised(semantic, "semantic"), "chunk_id", "full_outer")
    b, s = F.coalesce("bm25", F.lit(0.0)), F.coalesce("semantic", F.lit(0.0))
    raw = alpha * b + (1.0 - alpha) * s
    return both.select("chunk_id", raw.alias("raw_score"), b.alias("bm25_score"), s.alias("semantic_score")).where(F.col("raw_score") > config.FUSED_FLOOR)


def boost(query: str, symbol: Column, section: Column, filename: Column, snippet: Column, symbols: bool = True) -> Column:
    """What matches of the whole query in the metadata add to a score."""
    q = T.fold_text(query).strip()
    low = T.fold
    zero = F.lit(0.0)
    sym = F.when(low(symbol) == q, 0.35).when(low(symbol).contains(q), 0.15).otherwise(0.0) if symbols else zero
    sym = F.when(F.coalesce(symbol, F.lit("")) == "", 0.0).otherwise(sym)
    sec = F.when((F.coalesce(section, F.lit("")) != "") & low(section).contains(q), 0.20).otherwise(0.0)
    words = F.regexp_extract_all(low(filename), F.lit(T.WORD), F.lit(0))
    name = F.when(F.coalesce(filename, F.lit("")) == "", 0.0).when((low(filename) == q) | F.array_contains(words, q), 0.40).when(low(filename).contains(q), 0.20).otherwise(0.0)
    return sym + sec + name + F.when(low(snippet).contains(q), 0.10).otherwise(0.0)


def reranked(results: DataFrame, query: str, symbols: bool = True) -> DataFrame:
    """score = raw_score with the boosts, at most 1; the same however often it is applied."""
    b = boost(query, F.col("symbol_name"), F.col("section"), F.col("filename"), F.col("snippet"), symbols)
    return results.withColumn("score", F.least(F.lit(1.0), F.col("raw_score") + b))


ORDER = (F.desc, "score"), (F.desc, "raw_score"), (F.asc, "chunk_id")


def order() -> list[Column]:
    return [f(c) for f, c in ORDER]


def diverse(results: DataFrame, most: int = config.PER_DOCUMENT) -> DataFrame:
    """At most so many results of a document, its best."""
    w = Window.partitionBy("doc_id").orderBy(*order())
    return results.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def page_of(results: DataFrame, page: int, limit: int, by: list[Column] | None = None) -> DataFrame:
    page, limit = max(1, page), max(1, limit)
    return results.orderBy(*(by or order())).offset((page - 1) * limit).limit(limit)


def detailed(scores: DataFrame, index: Index, query: str, now: float) -> DataFrame:
    """Results of the given chunk ids: text and document are joined only now, late."""
    d = index.documents.select("doc_id", "path", "filename", "mtime")
    rows = scores.join(index.chunks, "chunk_id").join(d, "doc_id")
    return rows.select(
        "chunk_id", "doc_id", "filename", "path", F.lit(0.0).alias("score"), "raw_score", T.recency(F.col("mtime"), now).alias("recency_boost"), "mtime",
        (T.snippet(F.col("text"), query) if query else T.head_snippet(F.col("text"))).alias("snippet"),
        "page_number", F.col("section_title").alias("section"), "code_type", "symbol_name", "start_line", "end_line", "bm25_score", "semantic_score",
    )


def results(
    index: Index, query: str, now: float, page: int = 1, limit: int = config.LIMIT, alpha: float = config.ALPHA, code_only: bool = False,
    query_vector: list[float] | None = None, filter_before_top: bool = False, recency_in_rank: bool = False,
) -> DataFrame:
    """All results of a query in the pool, before they are cut into pages.

    query_vector: the embedded words; without it the search is lexical.
    filter_before_top: filter postings before the pool is cut (else after).
    recency_in_rank: let recency count in queries with words (else it counts
    only in those without, and is only reported).
    """
    spark = index.documents.sparkSession
    q = parse(query)
    if not (query or "").strip():
        return spark.createDataFrame([], RESULT)
    pool = max(config.POOL, (max(1, page) - 1) * max(1, limit) + max(1, limit) * 5)
    filtered = q.has_filters or code_only
    if not q.text:
        return _without_words(index, q, now, code_only, pool) if filtered else spark.createDataFrame([], RESULT)
    among = lookup.candidates(index, q, code_only).select("chunk_id") if filtered else None
    keep = (lambda df: df.join(among, "chunk_id", "left_semi")) if filtered else (lambda df: df)
    postings = keep(index.postings) if filter_before_top else index.postings
    b = keep(lexical.bm25(postings, index.chunks, q.text, pool))
    if query_vector is not None:
        s = dense.semantic(index.vectors, query_vector, pool, among)
    else:
        s = spark.createDataFrame([], "chunk_id long, semantic double")
    scores = with_names(b, keep(lookup.by_filename(index, q.text)), keep(lookup.by_symbol(index, q.text)))
    best = fused(scores, s, alpha).orderBy(F.desc("raw_score"), "chunk_id").limit(pool)
    out = reranked(detailed(best, index, q.text, now), q.text)
    if recency_in_rank:
        out = out.withColumn("score", F.least(F.lit(1.0), F.col("score") + F.col("recency_boost")))
    return diverse(out)


def _without_words(index: Index, q: Query, now: float, code_only: bool, pool: int) -> DataFrame:
    """Filters alone: a chunk a document, by recency."""
    rows = lookup.first_chunks(lookup.candidates(index, q, code_only, pool * 2)).select("chunk_id")
    rows = rows.select("chunk_id", F.lit(config.FILTER_ONLY_SCORE).alias("raw_score"), F.lit(0.0).alias("bm25_score"), F.lit(0.0).alias("semantic_score"))
    out = detailed(rows, index, "", now)
    return out.withColumn("score", F.least(F.lit(1.0), F.col("raw_score") + F.col("recency_boost")))


def search(index: Index, query: str, now: float, page: int = 1, limit: int = config.LIMIT, **more) -> DataFrame:
    """One page of results, best first."""
    found = results(index, query, now, page, limit, **more)
    by = None if parse(query).text else [F.desc("score"), F.desc("mtime"), F.asc("chunk_id")]
    return page_of(found, page, limit, by)


def search_paginated(index: Index, query: str, now: float, page: int = 1, limit: int = config.LIMIT, **more) -> tuple[DataFrame, DataFrame]:
    """A page and, as a one-row frame, `total`: the results in the pool after at most two of a document."""
    found = results(index, query, now, page, limit, **more)
    return search(index, query, now, page, limit, **more), found.agg(F.count("*").alias("total"))


def search_code(index: Index, query: str, now: float, limit: int = config.LIMIT, **more) -> DataFrame:
    return search(index, query, now, 1, limit, code_only=True, **more)


def search_symbol(index: Index, name: str, limit: int = 20) -> DataFrame:
    return lookup.find_symbols(index, name, limit)


def presented(found: DataFrame) -> DataFrame:
    """Results for display: scores rounded to four places, without the raw score."""
    rounded = {c: F.round(c, 4) for c in ("score", "bm25_score", "semantic_score", "recency_boost")}
    return found.withColumns(rounded).drop("raw_score")
