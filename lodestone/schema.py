"""Schemas of the index tables, and the tables together."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

DOCUMENTS = "doc_id long, path string, filename string, extension string, sha256 string, size_bytes long, mtime double, indexed_at timestamp"
CHUNKS = "chunk_id long, doc_id long, chunk_index int, text string, page_number int, section_title string, code_type string, symbol_name string, start_line int, end_line int, token_count int"
SYMBOLS = "symbol_id long, doc_id long, chunk_id long, name string, kind string, line_number int"
POSTINGS = "term string, doc_id long, chunk_id long, term_freq int"
VECTORS = "chunk_id long, embedding array<float>"
WATCHED = "path string, added_at timestamp"
TABLES = {"documents": DOCUMENTS, "chunks": CHUNKS, "symbols": SYMBOLS, "postings": POSTINGS, "vectors": VECTORS}

RESULT = "chunk_id long, doc_id long, filename string, path string, score double, raw_score double, recency_boost double, mtime double, snippet string, page_number int, section string, code_type string, symbol_name string, start_line int, end_line int, bm25_score double, semantic_score double"


@dataclass(frozen=True)
class Index:
    """The tables that a search reads."""

    documents: DataFrame
    chunks: DataFrame
    symbols: DataFrame
    postings: DataFrame
    vectors: DataFrame

    def having(self, **tables: DataFrame) -> Index:
        return replace(self, **tables)
