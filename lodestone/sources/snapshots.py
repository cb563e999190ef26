"""Index tables as Parquet segments; manifests, numbered without gaps, are the versions.

A commit writes the rows of the documents that it adds as a new segment, and
the ids of those that it removes or replaces as a list of deletions, so its
cost follows the change and not the index. A manifest lists what belongs to a
version and is renamed into place under the next number, which only one
writer can take: another one finds it taken, reads the new manifest and adds
its change to that. So a reader sees all of a commit or none of it, a failed
one leaves the last version current, and writers need no lock. A pointer file
spares readers the count from one. A row counts unless its document was
deleted by a later version than the one that its segment came with.
Compaction writes the rows that count as one segment, in the place of those
that it read.
"""

from __future__ import annotations

import json
import logging
import threading
import uuid
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import dense, lexical
from lodestone.schema import TABLES, WATCHED, Index

log = logging.getLogger(__name__)

POINTER = "CURRENT"
#: Segments beyond which a commit compacts.
SEGMENTS = 12


def _columns(name: str) -> list[str]:
    return [f.strip().split(" ")[0] for f in TABLES[name].split(",")]


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))
        self._mine = threading.local()

    # -- the pointer -----------------------------------------------------------

    @property
    def version(self) -> int:
        """The current snapshot's number; 0 before the first commit. The pointer may lag behind the manifests, not lead."""
        p = f"{self.root}/{POINTER}"
        v = int(self.spark.read.text(p).first()[0]) if self._fs.exists(self._path(p)) else 0
        while self._fs.exists(self._path(self._manifest_path(v + 1))):
            v += 1
        return v

    def _manifest_path(self, version: int) -> str:
        return f"{self.root}/manifests/{version}.json"

    def _put(self, path: str, text: str, overwrite: bool) -> bool:
        """Write a file whole: beside its place, then renamed (one step in file systems whose rename is one). False if another is there."""
        new, now = self._path(f"{path}.{uuid.uuid4().hex}"), self._path(path)
        out = self._fs.create(new, True)
        out.write(bytearray(text, "utf-8"))
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        rename = getattr(jvm, "org.apache.hadoop.fs.Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE if overwrite else rename.NONE
        try:
            context.rename(self._fs.makeQualified(new), self._fs.makeQualified(now), how)
        except Py4JJavaError as e:
            if overwrite or "FileAlreadyExistsException" not in str(e.java_exception):
                raise
            self._fs.delete(new, False)
            return False
        return True

    def _commit(self, change: Callable[[dict, int], dict]) -> int:
        """Make the next version: change(manifest, number) of the current one, again if another writer took the number."""
        while True:
            v = self.version
            if self._put(self._manifest_path(v + 1), json.dumps(change(self._manifest(v), v + 1)), overwrite=False):
                self._put(f"{self.root}/{POINTER}", str(v + 1), overwrite=True)
                return v + 1

    # -- tables ------------------------------------------------------------------

    def _manifest(self, version: int | None = None) -> dict:
        """Segments and deletions, each as version and folder."""
        v = self.version if version is None else version
        if not v:
            return {"segments": [], "deletions": []}
        return json.loads(self.spark.read.text(self._manifest_path(v), wholetext=True).first()[0])

    def _segment(self, at: str, name: str) -> DataFrame | None:
        """A segment's rows; None for vectors that are damaged or missing, as a search goes on without them."""
        try:
            return self.spark.read.parquet(f"{self.root}/segments/{at}/{name}")
        except (PySparkException, Py4JJavaError) as e:
            if name != "vectors":
                raise
            log.warning("vectors of segment %s can't be read, going on without them: %s", at, str(e).split("\n")[0])
            return None

    def _stored(self, name: str, manifest: dict) -> DataFrame | None:
        """All rows of a table that count, with doc_id; None without a segment."""
        out = None
        for n, at in manifest["segments"]:
            df = self._segment(at, name)
            if df is None:
                continue
            df = df.withColumn("_segment", F.lit(n))
            out = df if out is None else out.unionByName(df)
        if out is None:
            return None
        first = min(n for n, _ in manifest["segments"])
        gone = [self.spark.read.parquet(f"{self.root}/deletions/{at}").withColumn("_at", F.lit(n)) for n, at in manifest["deletions"] if n > first]
        if gone:
            # Spark joins the list by its size: broadcast if small.
            dead = reduce(DataFrame.union, gone).groupBy(F.col("doc_id").alias("_doc")).agg(F.max("_at").alias("_at"))
            out = out.join(dead, (F.col("doc_id") == F.col("_doc")) & (F.col("_segment") < F.col("_at")), "left_anti")
        return out.drop("_segment")

    def table(self, name: str) -> DataFrame:
        out = self._stored(name, self._manifest())
        return self.spark.createDataFrame([], TABLES[name]) if out is None else out.select(*_columns(name))

    @property
    def index(self) -> Index:
        m = self._manifest()
        tables = {n: self._stored(n, m) for n in TABLES}
        return Index(**{n: self.spark.createDataFrame([], TABLES[n]) if df is None else df.select(*_columns(n)) for n, df in tables.items()})

    def _write_segment(self, index: Index) -> str:
        """The folder of a new segment. Postings are ordered by term (and chunk, so that a common term is dealt over many files): a look-up reads few row groups."""
        at = uuid.uuid4().hex
        for name in TABLES:
            df = getattr(index, name)
            if name == "vectors" and "doc_id" not in df.columns:
                df = df.join(index.chunks.select("chunk_id", "doc_id"), "chunk_id")
            df = df.select(*dict.fromkeys([*_columns(name), "doc_id"]))
            if name == "postings":
                df = df.repartitionByRange("term", "chunk_id").sortWithinPartitions("term", "chunk_id")
            df.write.parquet(f"{self.root}/segments/{at}/{name}")
        return at

    def apply(self, new: Index | None = None, gone: DataFrame | None = None) -> int:
        """Commit a change: documents to delete (doc_id) and documents to add, which replace those with their ids."""
        lists = [df.select("doc_id") for df in (gone, new.documents if new else None) if df is not None]
        dead = uuid.uuid4().hex if lists else None
        if dead:
            reduce(DataFrame.union, lists).distinct().write.parquet(f"{self.root}/deletions/{dead}")
        added = self._write_segment(new) if new is not None else None

        def change(m: dict, n: int) -> dict:
            return {"segments": m["segments"] + ([[n, added]] if added else []), "deletions": m["deletions"] + ([[n, dead]] if dead and m["segments"] else [])}

        v = self._commit(change)
        return self.compact() if len(self._manifest(v)["segments"]) > SEGMENTS else v

    def commit(self, index: Index) -> int:
        """Write all tables anew as one segment."""
        at = self._write_segment(index)
        return self._commit(lambda _, n: {"segments": [[n, at]], "deletions": []})

    def compact(self) -> int:
        """The rows that count as one segment; what others commit meanwhile stays beside it."""
        v = self.version
        m = self._manifest(v)
        if not m["segments"]:
            return v
        at = self._write_segment(Index(**{n: self._stored(n, m) for n in TABLES}))

        def change(now: dict, _: int) -> dict:
            if any(s not in now["segments"] for s in m["segments"]):
                # Written anew or compacted by another writer.
                return now
            return {"segments": [[v, at], *(s for s in now["segments"] if s not in m["segments"])], "deletions": [d for d in now["deletions"] if d[0] > v]}

        return self._commit(change)

    def staged(self, df: DataFrame) -> DataFrame:
        """df, written beside the segments and read back: what is dear to compute is computed once a commit."""
        at = f"{self.root}/staging/{uuid.uuid4().hex}"
        df.write.parquet(at)
        self._mine.at = [*getattr(self._mine, "at", ()), at]
        return self.spark.read.schema(df.schema).parquet(at)

    def unstage(self) -> None:
        """Delete what this thread has staged."""
        for at in getattr(self._mine, "at", ()):
            self._fs.delete(self._path(at), True)
        self._mine.at = []

    def clear(self) -> int:
        empty = {n: self.spark.createDataFrame([], s) for n, s in TABLES.items()}
        return self.commit(Index(**empty))

    def vacuum(self, keep: int = 2) -> None:
        """Delete what the last `keep` versions don't need."""
        v = self.version
        kept = [self._manifest(n) for n in range(max(1, v - keep + 1), v + 1)]
        gone = [n for n in range(1, v - keep + 1) if self._fs.exists(self._path(self._manifest_path(n)))]
        older = [self._manifest(n) for n in gone]
        for kind in ("segments", "deletions"):
            needed = {at for m in kept for _, at in m[kind]}
            # Only what an older version names: a folder that none names may be a commit under way.
            for at in {at for m in older for _, at in m[kind]} - needed:
                self._fs.delete(self._path(f"{self.root}/{kind}/{at}"), True)
        for n in gone:
            self._fs.delete(self._path(self._manifest_path(n)), False)

    def size_bytes(self) -> int:
        m = self._manifest()
        paths = [f"{self.root}/{kind}/{at}" for kind in ("segments", "deletions") for _, at in m[kind]]
        return sum(self._fs.getContentSummary(self._path(p)).getLength() for p in paths)

    def stats(self) -> dict:
        """Counts of the tables, distinct terms, tokens, documents by suffix, and the size on disk."""
        i = self.index
        by = {r["extension"]: r["n"] for r in i.documents.groupBy("extension").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "extension").collect()}
        tokens = i.chunks.agg(F.coalesce(F.sum("token_count"), F.lit(0))).first()[0]
        return {"documents": i.documents.count(), "chunks": i.chunks.count(), "symbols": i.symbols.count(), "terms": lexical.term_stats(i.postings).count(), "tokens": tokens, "by_extension": by, "size_bytes": self.size_bytes()}

    # -- watched folders -----------------------------------------------------------

    def watched(self) -> DataFrame:
        p = f"{self.root}/watched"
        return self.spark.read.schema(WATCHED).json(p).orderBy("added_at", "path") if self._fs.exists(self._path(p)) else self.spark.createDataFrame([], WATCHED)

    def _save_watched(self, rows: list) -> None:
        self.spark.createDataFrame(rows, WATCHED).coalesce(1).write.mode("overwrite").json(f"{self.root}/watched")

    def add_watched(self, path: str) -> bool:
        """Whether it wasn't there already."""
        rows = self.watched().collect()
        if any(r["path"] == path for r in rows):
            return False
        now = self.spark.range(1).select(F.current_timestamp()).first()[0]
        self._save_watched([*rows, (path, now)])
        return True

    def remove_watched(self, path: str) -> bool:
        rows = self.watched().collect()
        left = [r for r in rows if r["path"] != path]
        if len(left) < len(rows):
            self._save_watched(left)
        return len(left) < len(rows)


# -- changes to an index, as plans ---------------------------------------------------


def without(index: Index, doc_ids: DataFrame) -> Index:
    """The index without documents (doc_id): their chunks, symbols, postings and vectors go with them."""
    gone = doc_ids.select("doc_id").distinct()
    chunks = index.chunks.join(gone, "doc_id", "left_semi").select("chunk_id")
    keep = lambda df: df.join(gone, "doc_id", "left_anti")
    return Index(keep(index.documents), keep(index.chunks), keep(index.symbols), keep(index.postings), dense.delete_vectors(index.vectors, chunks))


def upserted(index: Index, new: Index) -> Index:
    """The index with the documents of `new` in place of those with the same ids."""
    old = without(index, new.documents)
    return Index(*(getattr(old, n).unionByName(getattr(new, n).select(*getattr(old, n).columns)) for n in ("documents", "chunks", "symbols", "postings", "vectors")))


def latest(documents: DataFrame, more: DataFrame) -> DataFrame:
    """Documents by path: those of `more` replace those of the same path."""
    return documents.join(more.select("path"), "path", "left_anti").select(*documents.columns).unionByName(more.select(*documents.columns))


def appended_postings(postings: DataFrame, more: DataFrame) -> DataFrame:
    """Postings by term and chunk: the later ones win."""
    return postings.join(more.select("term", "chunk_id"), ["term", "chunk_id"], "left_anti").select(*postings.columns).unionByName(more.select(*postings.columns))


def changes(documents: DataFrame, files: DataFrame, under: str | None = None) -> DataFrame:
    """path, status: new, changed, unchanged, failed (no digest) of the files; deleted of documents under the folder that are no files."""
    old = documents.select("path", F.col("sha256").alias("was"))
    if under is not None:
        old = old.where(F.col("path").startswith(under.rstrip("/") + "/"))
    both = files.select("path", "sha256", F.lit(True).alias("here")).join(old.withColumn("known", F.lit(True)), "path", "full_outer")
    status = F.when(F.col("here").isNull(), "deleted").when(F.col("sha256").isNull(), "failed").when(F.col("known").isNull(), "new").when(F.col("sha256") == F.col("was"), "unchanged").otherwise("changed")
    return both.select("path", status.alias("status"))
