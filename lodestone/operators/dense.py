"""Vectors: normalising, upserts, exact top-k cosine, embedding."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import config

#: Dimensions up to which a dot product is unrolled into one expression.
UNROLL = 128


def norm(e: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(e, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))


def normalised(vectors: DataFrame) -> DataFrame:
    """chunk_id, embedding of length 1; a zero vector stays zero."""
    v = vectors.withColumn("_n", norm(F.col("embedding")))
    unit = F.transform("embedding", lambda x: F.when(F.col("_n") > 0, x / F.col("_n")).otherwise(x).cast("float"))
    return v.select("chunk_id", unit.alias("embedding"))


def upsert_vectors(vectors: DataFrame, new: DataFrame) -> DataFrame:
    """new rows, normalised, in place of those of the same id."""
    return vectors.join(new.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id", "embedding").unionByName(normalised(new))


def delete_vectors(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    return vectors.join(ids.select("chunk_id"), "chunk_id", "left_anti")


def dot(e: Column, query: list[float]) -> Column:
    """In double precision, added from the first component on; unrolled so that it compiles."""
    if len(query) <= UNROLL:
        total = F.lit(0.0)
        for i, q in enumerate(query):
            total = total + F.get(e, F.lit(i)).cast("double") * F.lit(float(q))
        return total
    q = F.array(*map(F.lit, map(float, query)))
    return F.aggregate(F.zip_with(e, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)


def vector_top(vectors: DataFrame, query: list[float], top: int = 50, among: DataFrame | None = None) -> DataFrame:
    """chunk_id, cosine of the nearest vectors (of unit length); with `among`, of those chunk ids only, filtered first."""
    q = np.asarray(query, float)
    length = float(np.sqrt((q**2).sum()))
    q = q / length if length else q
    v = vectors.join(among.select("chunk_id"), "chunk_id", "left_semi") if among is not None else vectors
    return v.select("chunk_id", dot(F.col("embedding"), q.tolist()).alias("cosine")).orderBy(F.desc("cosine"), "chunk_id").limit(top)


def semantic(vectors: DataFrame, query: list[float], top: int, among: DataFrame | None = None, floor: float = config.SEMANTIC_FLOOR) -> DataFrame:
    """chunk_id, semantic: the cosines above the floor, spread over [0, 1]."""
    from lodestone.functions.text import calibrated

    return vector_top(vectors, query, top, among).where(F.col("cosine") >= floor).select("chunk_id", calibrated(F.col("cosine"), floor).alias("semantic"))


Embed = Callable[[list[str]], np.ndarray]


def hashed_words(texts: list[str], dim: int = config.EMBED_DIM) -> np.ndarray:
    """An embedding without a model: signed hashes of the words, of unit length."""
    from lodestone.functions.text import tokens_of

    out = np.zeros((len(texts), dim), np.float32)
    import zlib

    for i, t in enumerate(texts):
        for w in tokens_of(t):
            h = zlib.crc32(w.encode())
            out[i, h % dim] += 1 if h >> 31 else -1
    n = np.sqrt((out**2).sum(1, keepdims=True))
    return out / np.where(n > 0, n, 1)


def embed_chunks(chunks: DataFrame, embed: Embed = hashed_words, batch: int = config.EMBED_BATCH) -> DataFrame:
    """chunk_id, embedding by a function from texts to unit vectors, called with `batch` texts at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                yield pd.DataFrame({"chunk_id": part["chunk_id"], "embedding": list(embed(part["text"].fillna("").tolist()))})

    return chunks.select("chunk_id", "text").mapInPandas(run, "chunk_id long, embedding array<float>")


def embed_query(query: str, embed: Embed = hashed_words) -> list[float]:
    return embed([query])[0].astype(float).tolist()
