"""Listing and reading folders of files."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestone import config
from lodestone.operators.lookup import safe_path

FILES = "path string, size_bytes long, mtime double, sha256 string, content binary"
#: Bytes that one task reads, about.
TASK_BYTES = 64 * 1024 * 1024


def safe(path: str, size: int | None, fallback: bool = True) -> bool:
    """What `safe_path` says, for one path on the driver; size None: not known."""
    *above, name = path.split("/")
    name = name.lower()
    suffix = os.path.splitext(name)[1]
    return not (
        any(p in config.IGNORED_DIRS or (p.startswith(".") and len(p) > 1) for p in above)
        or (name.startswith(".") and not name.endswith(tuple(config.SUPPORTED_EXTENSIONS)))
        or name.endswith(config.SCRATCH_SUFFIXES)
        or any(p in name for p in config.SENSITIVE_NAMES)
        or (size is not None and size > config.MAX_FILE_BYTES)
        or (not fallback and suffix not in config.SUPPORTED_EXTENSIONS)
    )


def walk(root: str, below: str = "") -> Iterator[tuple[str, int, float]]:
    """Path, size and time of the files to read; ignored and hidden folders aren't entered, links to folders not followed."""
    root = os.path.abspath(root)
    for folder, folders, names in os.walk(root):
        folders[:] = sorted(d for d in folders if d not in config.IGNORED_DIRS and not d.startswith("."))
        for name in sorted(names):
            path = os.path.join(folder, name)
            try:
                s = os.stat(path)
            except OSError:
                continue
            if os.path.isfile(path) and safe(path, s.st_size):
                yield path, s.st_size, s.st_mtime


class _Part(InputPartition):
    def __init__(self, files: list[tuple[str, int, float]]):
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, root: str, content: bool):
        self.root, self.content = root, content

    def partitions(self) -> list[_Part]:
        parts, held = [[]], 0
        for f in walk(self.root):
            if parts[-1] and held + f[1] > TASK_BYTES:
                parts.append([])
                held = 0
            parts[-1].append(f)
            held += f[1]
        return [_Part(p) for p in parts]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for path, size, mtime in partition.files:
            try:
                with open(path, "rb") as f:
                    content = f.read()
            except OSError:  # gone or closed to us since it was listed: no digest marks it as failed
                yield path, size, mtime, None, None
                continue
            yield path, size, mtime, hashlib.sha256(content).hexdigest(), content if self.content else None


class FolderSource(DataSource):
    """format("lodestone_folder"): the files under `path` that every executor can open."""

    @classmethod
    def name(cls) -> str:
        return "lodestone_folder"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], self.options.get("content", "true") == "true")


def folder(spark: SparkSession, path: str) -> DataFrame:
    """FILES of a folder that driver and executors share; no row for one that doesn't exist."""
    if not os.path.isdir(path):
        return spark.createDataFrame([], FILES)
    spark.dataSource.register(FolderSource)
    return spark.read.format("lodestone_folder").option("path", path).load()


def store(spark: SparkSession, path: str) -> DataFrame:
    """FILES of a folder in any store that Spark reads. Its listing leaves out names that start with _ or a dot."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    plain = F.regexp_replace("path", r"^file:/*(?=/)", "")
    files = b.select(plain.alias("path"), F.col("length").alias("size_bytes"), F.unix_micros("modificationTime").cast("double").alias("t"), "content")
    files = files.where(safe_path(F.col("path"), F.col("size_bytes")))
    return files.select("path", "size_bytes", (F.col("t") / 1e6).alias("mtime"), F.sha2("content", 256).alias("sha256"), "content")
