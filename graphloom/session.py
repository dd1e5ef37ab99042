"""Session helper for local runs and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; on a cluster the submitting side sets these."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("graphloom")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )


#: Deletes the shuffles of a query when it has ended; else they stay until the driver happens to collect its garbage.
SHUFFLES_GO = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Set within a scratch scope. With the second a task writes up to so many folders of ``partitionBy`` at once, in place of sorting its rows for it.
_WITHIN = SHUFFLES_GO | {"spark.sql.maxConcurrentOutputFileWriters": "8"}
#: Scratch paths of the innermost :func:`scratch_scope` of this thread.
_held: ContextVar[list[str] | None] = ContextVar("held", default=None)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for what is run inside; those of before are put back."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Scratch paths given out inside are deleted at the end, shuffles of what is written inside as soon as it is.

    For work whose result is *written* inside, to a path taken before: a frame that still reads one of these paths cannot
    be read afterwards. Nothing but paths of :func:`scratch_path` is ever deleted.
    """
    held: list[str] = []
    token = _held.set(held)
    try:
        with settings(spark, _WITHIN):
            yield
    finally:
        _held.reset(token)
        for path in held:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for ``name`` in the shared folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster a machine-local path would
    be invisible to the other executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        root = tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    held = _held.get()
    if held is not None:
        held.append(path)
    return path
