"""Session construction and the few settings the operators rely on."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from millrace.sources import store


def build_session(master: str | None = None, shuffle_partitions: int | None = None, app: str = "millrace") -> SparkSession:
    """A session for local use and tests.  On a cluster the submitted configuration wins."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        conf["spark.driver.memory"] = os.environ.get("MILLRACE_DRIVER_MEMORY", "8g")
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


class NoSharedFolder(RuntimeError):
    """The session names no folder that all executors share."""


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (``local`` masters: tests) a
    temporary one is set; a cluster without one is refused, since its executors would write
    to disks of their own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise NoSharedFolder("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", path)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(path)
    return path


#: Intermediate tables of this process, by the session's application.
_WRITTEN: list[tuple[SparkSession, str]] = []


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows by way of a table in the shared folder: computed once, whatever reads them and whichever executor is lost.

    The table is read whenever the result is, so it stays until ``clear_written`` or the end
    of the process.
    """
    path = scratch(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, removed with the others."""
    path = f"{shared_dir(spark)}/millrace-{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def clear_written(since: int = 0) -> None:
    """Remove the intermediate tables, all or those written after the first ``since``.  Results that read them can't be read again."""
    for spark, path in _WRITTEN[since:]:
        if spark.sparkContext._jsc is not None:
            store.delete(spark, path)
    del _WRITTEN[since:]


@contextmanager
def intermediates() -> Iterator[None]:
    """Intermediate tables written within are removed at its end: to be left once the results are written or collected."""
    since = len(_WRITTEN)
    try:
        yield
    finally:
        clear_written(since)


@atexit.register
def _at_exit() -> None:
    try:
        clear_written()
    except Exception:  # the JVM may be gone; its folder is named by the application
        _WRITTEN.clear()
