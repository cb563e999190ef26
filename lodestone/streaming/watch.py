"""Keeping an index up to date with folders: file events, debounced, applied in micro-batches."""

from __future__ import annotations

import hashlib
import json
import os
import threading
import time
from collections.abc import Iterator
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery

from lodestone.plans import indexing
from lodestone.sources import listing, snapshots

EVENTS = "path string, event string, ts timestamp"
QUIET_SECONDS = 1.0

# -- events ----------------------------------------------------------------------


def difference(old: dict[str, list[float]], new: dict[str, list[float]]) -> list[tuple[str, str]]:
    """(path, event) between two listings (path -> time and size). A move is a deletion and a creation."""
    made = [(p, "created") for p in new.keys() - old.keys()]
    changed = [(p, "modified") for p in new.keys() & old.keys() if new[p] != old[p]]
    return sorted(made + changed + [(p, "deleted") for p in old.keys() - new.keys()])


def debounced(pending: dict[str, list], fresh: list[tuple[str, str]], now: float, quiet: float) -> tuple[list[tuple[str, str]], dict[str, list]]:
    """Events that are due and those that wait on. A path's last event counts, once the path was quiet long enough."""
    waiting = pending | {p: [e, now] for p, e in fresh}
    due = sorted((p, e) for p, (e, at) in waiting.items() if now - at >= quiet)
    return due, {p: x for p, x in waiting.items() if p not in dict(due)}


class _Events(SimpleDataSourceStreamReader):
    """Compares listings; an offset holds the last listing and the events that wait.

    The file source of Spark sees additions alone. As waiting events are part
    of the offset, a restart from the checkpoint goes on with them.
    """

    def __init__(self, roots: list[str], start: str, quiet: float):
        self.roots, self.start, self.quiet = roots, start, quiet

    def _now(self) -> dict[str, list[float]]:
        return {p: [t, s] for root in self.roots for p, s, t in listing.walk(root)}

    @staticmethod
    def _rows(due: list[tuple[str, str]]) -> Iterator[tuple]:
        at = datetime.now(UTC)
        return iter([(p, e, at) for p, e in due])

    def initialOffset(self) -> dict:
        return {"listing": json.dumps({} if self.start == "all" else self._now()), "pending": "{}"}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        new = self._now()
        due, pending = debounced(json.loads(start["pending"]), difference(json.loads(start["listing"]), new), time.time(), self.quiet)
        return self._rows(due), {"listing": json.dumps(new), "pending": json.dumps(pending)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """The same rows again: what waited or changed at the start of the batch and doesn't wait at its end."""
        had = {p: e for p, (e, _) in json.loads(start["pending"]).items()} | dict(difference(json.loads(start["listing"]), json.loads(end["listing"])))
        return self._rows(sorted((p, e) for p, e in had.items() if p not in json.loads(end["pending"])))

    def commit(self, end: dict) -> None:
        pass


class FolderEvents(DataSource):
    """format("lodestone_events"): options roots (separated by a line end), start: all (a first event for every file) or now, quiet: seconds."""

    @classmethod
    def name(cls) -> str:
        return "lodestone_events"

    def schema(self) -> str:
        return EVENTS

    def simpleStreamReader(self, schema) -> _Events:
        return _Events(self.options["roots"].split("\n"), self.options.get("start", "now"), float(self.options.get("quiet", QUIET_SECONDS)))


def events(spark: SparkSession, roots: list[str], start: str = "now", quiet: float = QUIET_SECONDS) -> DataFrame:
    spark.dataSource.register(FolderEvents)
    return spark.readStream.format("lodestone_events").option("roots", "\n".join(subsumed(roots))).option("start", start).option("quiet", str(quiet)).load()


# -- debouncing ---------------------------------------------------------------------


def latest_events(rows: DataFrame) -> DataFrame:
    """The last event of each path."""
    return rows.groupBy("path").agg(F.max_by("event", "ts").alias("event"), F.max("ts").alias("ts"))


def sessions(rows: DataFrame, key: str, quiet: str, *last: str) -> DataFrame:
    """Event-time form of debouncing: the last event of each run of events without a gap longer than `quiet`."""
    w = F.session_window("ts", quiet)
    return rows.groupBy(key, w).agg(F.count("*").alias("events"), F.max_by(F.struct(*last), F.struct("ts", *last)).alias("last")).select(key, F.col("session_window.start").alias("started"), "events", "last.*")


# -- applying -------------------------------------------------------------------------


def apply_events(store: snapshots.Store, rows: list[tuple[str, str]], embed=indexing.dense.hashed_words) -> dict[str, int]:
    """Delete and index the files of the events; one that is gone counts as deleted, whatever its event."""
    wanted = [p for p, e in rows if listing.safe(p, None)]
    here = [p for p in wanted if os.path.isfile(p) and dict(rows)[p] != "deleted"]
    gone = [p for p in wanted if p not in set(here)]
    spark, new, ids = store.spark, None, None
    if gone:
        ids = spark.createDataFrame([(p,) for p in gone], "path string").select(indexing.routing.document_id(F.col("path")).alias("doc_id"))
    if here:
        files = reduce(DataFrame.union, [listing.folder(spark, f) for f in subsumed(sorted({os.path.dirname(p) for p in here}))])
        files = indexing.routing.with_companions(files).where(F.col("path").isin(here) & F.col("sha256").isNotNull())
        new = indexing.analysed(files, embed, store.staged)
    if here or gone:
        store.apply(new, ids)
        store.unstage()
    return {"indexed": len(here), "deleted": len(gone)}


def watch(store: snapshots.Store, roots: list[str], checkpoint: str, start: str = "now", available_now: bool = False, quiet: float = QUIET_SECONDS, poll: str = "500 milliseconds") -> StreamingQuery:
    """Start a stream that applies the events of the folders. With available_now it handles what there is, and ends."""

    def batch(df: DataFrame, _: int) -> None:
        # One row a changed path, of folders that this process lists anyway.
        due = [(r["path"], r["event"]) for r in latest_events(df).toLocalIterator()]
        if due:
            apply_events(store, due)

    w = events(store.spark, roots, start, 0.0 if available_now else quiet).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=poll)).start()


class Watcher:
    """The stream over a set of folders that may change while it runs. A changed set is a new stream; one that ran before goes on where it stopped."""

    def __init__(self, store: snapshots.Store, checkpoints: str, quiet: float = QUIET_SECONDS, poll: str = "500 milliseconds"):
        self.store, self.checkpoints, self.quiet, self.poll = store, checkpoints, quiet, poll
        self.roots: list[str] = []
        self.query: StreamingQuery | None = None
        self._changing = threading.Lock()

    def follow(self, paths: list[str], timeout: float = 10.0) -> None:
        """Watch these folders and no others."""
        with self._changing:
            roots = subsumed(paths)
            if roots != self.roots or not self.active:
                self._end(timeout)
                self.roots = roots
                if roots:
                    self.query = watch(self.store, roots, f"{self.checkpoints}/{name_of(roots)}", quiet=self.quiet, poll=self.poll)

    @property
    def active(self) -> bool:
        return self.query is not None and self.query.isActive

    def watches(self, path: str) -> bool:
        return self.active and any(covers(r, path) for r in self.roots)

    def stop(self, timeout: float = 10.0) -> bool:
        """End the stream; whether it did within so many seconds."""
        with self._changing:
            return self._end(timeout)

    def _end(self, timeout: float) -> bool:
        query, self.query = self.query, None
        if query is None:
            return True
        # stop() waits for the batch under way, so it gets a thread of its own.
        t = threading.Thread(target=query.stop, daemon=True)
        t.start()
        t.join(timeout)
        return not t.is_alive()


# -- the set of watched folders ----------------------------------------------------------


def covers(root: str, path: str) -> bool:
    return path == root or path.startswith(root.rstrip("/") + "/")


def with_root(roots: set[str], new: str) -> set[str]:
    """Roots with a new one: nothing if one covers it already; those that it covers go."""
    if any(covers(r, new) for r in roots):
        return set(roots)
    return {r for r in roots if not covers(new, r)} | {new}


def subsumed(roots: list[str]) -> list[str]:
    out: set[str] = set()
    for r in roots:
        out = with_root(out, r)
    return sorted(out)


def covered(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """path, root: the roots that a path lies under. Roots are few; they are listed by hand."""
    p = F.col("path")
    return paths.join(F.broadcast(roots), (p == F.col("root")) | p.startswith(F.concat(F.regexp_replace("root", "/+$", ""), F.lit("/"))))


def name_of(roots: list[str]) -> str:
    """A name for the checkpoint of a set of roots; a changed set is a new stream."""
    return hashlib.sha256("\n".join(subsumed(roots)).encode()).hexdigest()[:16]
