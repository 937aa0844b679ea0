"""Tables that are made once and read often, in the folder that driver and executors share."""

from __future__ import annotations

import os
import threading
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")


#: Setting under which a query's shuffle files are deleted at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``.

    Where the session names none, one below the temporary folder is used if the master is local (tests, a single
    machine); a cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + os.path.join(os.environ.get("TMPDIR", "/tmp"), "checkpoints")
    return f"{base.rstrip('/')}/siftlode-{spark.sparkContext.applicationId}"


_lock, _open = threading.Lock(), [0, None]


@contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """The setting, as long as any thread writes a table."""
    with _lock:
        if not _open[0]:
            _open[1] = spark.conf.get(CLEANUP, None)
            spark.conf.set(CLEANUP, "true")
        _open[0] += 1
    try:
        yield
    finally:
        with _lock:
            _open[0] -= 1
            if not _open[0]:
                spark.conf.unset(CLEANUP) if _open[1] is None else spark.conf.set(CLEANUP, _open[1])


def together(*makers: Callable[[], T], at_once: int = 4) -> list[T]:
    """Results of independent makers of tables, some of which run at the same time: small jobs then fill the cluster."""
    with ThreadPoolExecutor(at_once) as threads:
        return [f.result() for f in [threads.submit(inheritable_thread_target(m)) for m in makers]]


def keep(df: DataFrame) -> DataFrame:
    """``df`` written below ``spark.checkpoint.dir`` and read back: its plan is a scan, and a lost executor costs a reread. The
    shuffles behind it leave the disks when it is written."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    with _cleaning(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application has kept; results not yet computed need them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
