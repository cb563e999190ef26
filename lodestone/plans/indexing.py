"""Batch indexing: list, compare, read, analyse, commit."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import dense, lexical
from lodestone.schema import Index
from lodestone.sources import listing, routing, snapshots
from lodestone.functions import text as T

COUNTERS = ("scanned", "indexed", "skipped", "deleted", "failed")


def analysed(files: DataFrame, embed: dense.Embed | None = dense.hashed_words, staged: Callable[[DataFrame], DataFrame] = lambda df: df, ocr: routing.Ocr | None = None) -> Index:
    """The index of the given files alone. files: path, size_bytes, mtime, sha256, content.

    staged: keeps the chunks and their words, from which all tables follow, so
    that files are read once. ocr: a function that reads the text in pictures.
    """
    parsed = staged(lexical.analysed(routing.read_files(files, ocr)))
    documents = files.select(
        routing.document_id(F.col("path")).alias("doc_id"), "path", T.filename(F.col("path")).alias("filename"), T.extension(F.col("path")).alias("extension"),
        "sha256", "size_bytes", "mtime", F.current_timestamp().alias("indexed_at"),
    )
    chunks = lexical.token_counts(parsed)
    each = parsed.select("doc_id", "chunk_id", F.posexplode("symbols").alias("n", "s"))
    symbols = each.select(F.xxhash64("chunk_id", "n").alias("symbol_id"), "doc_id", "chunk_id", "s.name", "s.kind", "s.line_number")
    vectors = dense.embed_chunks(chunks, embed) if embed else files.sparkSession.createDataFrame([], "chunk_id long, embedding array<float>")
    return Index(documents, chunks.drop("symbols", "tokens"), symbols, lexical.postings(chunks), dense.normalised(vectors))


def index_folder(store: snapshots.Store, folder: str, embed: dense.Embed | None = dense.hashed_words, files: DataFrame | None = None, ocr: routing.Ocr | None = None) -> dict[str, int]:
    """Bring the index up to date with a folder: new and changed files are read, documents whose files are gone deleted.

    Returns the counters. Documents whose files still exist but are no longer
    listed (now ignored, say) stay, as only files that are gone are deleted.
    """
    folder = os.path.abspath(folder) if "://" not in folder else folder
    files = (listing.folder(store.spark, folder) if files is None else files).persist()
    index = store.index
    # At most a row for each file, and only paths and marks.
    marks = snapshots.changes(index.documents, files, folder).persist()
    count = {r["status"]: r["count"] for r in marks.groupBy("status").count().collect()}
    fresh = files.join(marks.where(F.col("status").isin("new", "changed")), "path", "left_semi")
    gone = marks.where("status = 'deleted'").select(routing.document_id(F.col("path")).alias("doc_id"), "path")
    still = [r["path"] for r in gone.select("path").toLocalIterator() if "://" not in r["path"] and os.path.exists(r["path"])]
    if still:
        gone = gone.join(store.spark.createDataFrame([(p,) for p in still], "path string"), "path", "left_anti")
    deleted = count.get("deleted", 0) - len(still)
    indexed = count.get("new", 0) + count.get("changed", 0)
    if indexed or deleted:
        # Companions may be unchanged themselves, so they are looked for among all files.
        whole = routing.with_companions(files).join(fresh.select("path"), "path", "left_semi")
        store.apply(analysed(whole, embed, store.staged, ocr) if indexed else None, gone if deleted else None)
        store.unstage()
    marks.unpersist()
    files.unpersist()
    known = sum(v for k, v in count.items() if k != "deleted")
    return dict(zip(COUNTERS, (known, indexed, count.get("unchanged", 0), deleted, count.get("failed", 0)), strict=True))


def remove_files(store: snapshots.Store, paths: list[str]) -> None:
    gone = store.spark.createDataFrame([(p,) for p in paths], "path string").select(routing.document_id(F.col("path")).alias("doc_id"))
    store.apply(gone=gone)


def rebuild(store: snapshots.Store, folders: list[str], embed: dense.Embed | None = dense.hashed_words, ocr: routing.Ocr | None = None) -> dict[str, int]:
    """Clear, then index all folders; the counters are added up."""
    store.clear()
    total = dict.fromkeys(COUNTERS, 0)
    for f in folders:
        for k, v in index_folder(store, f, embed, ocr=ocr).items():
            total[k] += v
    return total
