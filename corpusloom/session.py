"""Session defaults and the shared scratch space of long jobs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Settings that results depend on (UTC) or that large inputs need (AQE).
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: str = "8", app: str = "corpusloom", **conf: str) -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = DEFAULTS | {
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def workspace(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one the cluster names in ``spark.checkpoint.dir``.  Only where
    that is unset and all tasks run on this machine, as in tests, a new local
    folder is made and set once; on a cluster without the setting this raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


#: What the open scopes are to delete.
_SCOPES: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what :func:`materialize` has written inside, also after an error.

    For jobs that have written their result elsewhere: nothing may be computed
    afterwards from a DataFrame that was made inside.  Scopes may be nested.
    """
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            remove(spark, path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{workspace(spark)}/{label}-{uuid.uuid4().hex}"
    for paths in _SCOPES[-1:]:
        paths.append(path)
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.scratch_path = path
    return written


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in the folder ``path``; none if there is no such folder."""
    p, fs = _files(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    """Delete ``path`` and all in it."""
    p, fs = _files(spark, path)
    fs.delete(p, True)


def state_of(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of the files at ``path``: another text once a table has changed."""
    p, fs = _files(spark, path)
    found, rows = fs.listFiles(p, True), []
    while found.hasNext():
        f = found.next()
        rows.append(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}")
    return ",".join(sorted(rows))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark's file system has something at ``path``."""
    p, fs = _files(spark, path)
    return fs.exists(p)


def discard(written: DataFrame) -> None:
    """Delete what :func:`materialize` wrote, once nothing is to be computed from it any more."""
    remove(written.sparkSession, written.scratch_path)
