"""Look-ups by name and symbol, and filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone import config
from lodestone.functions import text as T
from lodestone.plans.syntax import Query
from lodestone.schema import Index


def by_filename(index: Index, query: str, top: int = 100) -> DataFrame:
    """chunk_id, weight: first chunks of documents whose name or path holds the query; 1 for an equal name, else 0.85."""
    q = query.strip()
    hit = T.contains_ci(F.col("filename"), q) | T.contains_ci(F.col("path"), q)
    docs = index.documents.where(hit).select("doc_id", "filename")
    rows = docs.join(index.chunks.where("chunk_index = 0").select("doc_id", "chunk_id"), "doc_id")
    rows = rows.orderBy(F.desc(F.col("filename") == q), F.length("filename"), "chunk_id").limit(top)
    return rows.select("chunk_id", F.when(F.lower("filename") == q.lower(), 1.0).otherwise(0.85).alias("weight"))


def by_symbol(index: Index, query: str, top: int = 100) -> DataFrame:
    """chunk_id, name, weight of chunks with a symbol whose name holds the query; 0.95 for an equal name, else 0.75."""
    q = query.strip()
    found = index.symbols.where(T.contains_ci(F.col("name"), q)).join(index.chunks.select("chunk_id"), "chunk_id", "left_semi").select("chunk_id", "name").distinct()
    rows = found.orderBy(F.desc(F.col("name") == q), F.length("name"), "chunk_id", "name").limit(top)
    return rows.withColumn("weight", F.when(F.lower("name") == q.lower(), 0.95).otherwise(0.75))


def find_symbols(index: Index, query: str, top: int = 20) -> DataFrame:
    """Symbols whose name holds the query, with their document and, if any, their chunk."""
    s = index.symbols.where(T.contains_ci(F.col("name"), query))
    rows = s.join(index.documents.select("doc_id", "path", "filename"), "doc_id").join(index.chunks.select("chunk_id", "text", "start_line", "end_line"), "chunk_id", "left")
    rows = rows.orderBy(F.desc(F.col("name") == query), F.length("name"), "symbol_id").limit(top)
    return rows.select("symbol_id", "name", "kind", "line_number", "chunk_id", "path", "filename", F.coalesce(F.substring("text", 1, 300), F.lit("")).alias("code_snippet"), "start_line", "end_line")


def conditions(q: Query, code_only: bool = False) -> list[Column]:
    """The filters of a query on a row of chunks joined with documents."""
    ext, out = F.lower("extension"), []
    code = code_only or q.file_type == "code"
    if q.extensions:
        out.append(ext.isin(sorted(q.extensions)))
    if q.exclude_extensions:
        out.append(~ext.isin(sorted(q.exclude_extensions)))
    if q.path:
        out.append(F.lower(F.translate("path", "\\", "/")).contains(q.path.lower()))
    if code:
        out.append(F.col("code_type").isNotNull())
    elif q.file_type:
        out.append(ext.isin(sorted(config.TYPE_EXTENSIONS[q.file_type])))
    if q.after is not None:
        out.append(F.col("mtime") >= q.after)
    if q.before is not None:
        out.append(F.col("mtime") <= q.before)
    if q.symbol:
        out.append(F.lower("symbol_name").contains(q.symbol.lower()))
    return out


def candidates(index: Index, q: Query, code_only: bool = False, top: int | None = None) -> DataFrame:
    """chunk_id, doc_id, chunk_index, mtime of the chunks that pass; the latest `top` if given."""
    where = conditions(q, code_only)
    rows = index.chunks.select("chunk_id", "doc_id", "chunk_index", "code_type", "symbol_name").join(index.documents.select("doc_id", "extension", "path", "mtime"), "doc_id")
    rows = rows.where(reduce(lambda a, b: a & b, where)) if where else rows
    rows = rows.select("chunk_id", "doc_id", "chunk_index", "mtime")
    return rows.orderBy(F.desc("mtime"), "chunk_id").limit(top) if top else rows


def first_chunks(rows: DataFrame) -> DataFrame:
    """Of the candidates, the first chunk of each document."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("mtime"), "chunk_index", "chunk_id")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def safe_path(path: Column, size: Column, fallback: bool = True) -> Column:
    """Whether a file is read: no ignored or hidden folder above it, no sensitive or scratch name, not too large."""
    parts = F.split(path, "/")
    above = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    bad = F.exists(above, lambda p: p.isin(sorted(config.IGNORED_DIRS)) | (p.startswith(".") & (F.length(p) > 1)))
    name = F.lower(T.filename(path))
    ends = lambda c, suffixes: reduce(lambda a, b: a | b, [c.endswith(s) for s in sorted(suffixes)])
    bad = bad | (name.startswith(".") & ~ends(name, config.SUPPORTED_EXTENSIONS)) | ends(name, config.SCRATCH_SUFFIXES)
    bad = bad | reduce(lambda a, b: a | b, [name.contains(p) for p in config.SENSITIVE_NAMES])
    ok = ~bad & (size <= config.MAX_FILE_BYTES)
    return ok if fallback else ok & T.extension(path).isin(sorted(config.SUPPORTED_EXTENSIONS))
