"""What the operators of this package share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch that a Python function makes.
BATCH_ROWS = 2000
#: log2 of a gate's bits.
GATE_BITS = 27
#: While this is true, a query's shuffle files go when it ends, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set: a temp folder, gone at exit, on a local master; an error on any other."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, d, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


#: Tables that this process has written and not discarded.
_written: set[str] = set()


def materialize(df: DataFrame, label: str = "t") -> DataFrame:
    """Write df to the shared folder and read it back: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    _written.add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _written.discard(path)


def discard(*tables: DataFrame) -> None:
    """Delete what materialize wrote for tables that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df._written_at)


def sweep(spark: SparkSession) -> None:
    """Delete all tables that operators have left for their results; call it when these have been read."""
    for path in list(_written):
        _delete(spark, path)


def pieces(batch: pa.RecordBatch, most_bytes: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that one piece holds about most_bytes, at least a row."""
    n = batch.num_rows
    if n == 0:
        return
    step = max(1, int(n * most_bytes / max(batch.nbytes, 1)))
    for i in range(0, n, step):
        yield batch.slice(i, step)


def arrays(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class Gate:
    """A bitmap of keys by their first bits: has() is true for all of them, and for few others while it is sparse."""

    def __init__(self, keys: DataFrame):
        """keys: key (a 64-bit hash). The bitmap is made in parts, one for each of the first byte's values."""

        def run(part: pa.Table) -> pa.Table:
            slot = part.column("key").to_numpy().view(np.uint64) >> np.uint64(64 - GATE_BITS)
            bits = np.zeros(1 << (GATE_BITS - 8), np.uint8)
            bits[(slot & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
            return pa.table({"part": pa.array([int(slot[0]) >> (GATE_BITS - 8)], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

        parts = keys.select(F.shiftrightunsigned("key", 56).alias("part"), "key").groupBy("part").applyInArrow(run, "part int, bits binary").toArrow()
        whole = np.zeros((256, 1 << (GATE_BITS - 11)), np.uint8)
        for part, bits in zip(parts.column(0).to_pylist(), parts.column(1), strict=True):
            whole[part] = np.frombuffer(bits.as_buffer(), np.uint8)
        self.bits = whole.reshape(-1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        slot = keys >> np.uint64(64 - GATE_BITS)
        return (self.bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0
