"""Session factory."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def session(master: str | None = None, app: str = "lodestone") -> SparkSession:
    """A session with what the engine relies on: UTC, AQE and Arrow.

    Settings given by the cluster (spark-submit, defaults file) win for
    everything but the session time zone.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master).config("spark.sql.shuffle.partitions", os.environ.get("BENCH_CPUS", "8"))
        b = b.config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        b = b.config("spark.ui.showConsoleProgress", "false")
    return (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors share, below spark.checkpoint.dir; where that is unset, a temporary one if the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
