"""Versioned Parquet tables: every write is a new version, a small file that names the folders it is made of."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources import store
from millrace.sources.store import AlreadyThere

_VERSIONS = "_versions"


class Conflict(RuntimeError):
    """Another writer has published a version since the one this write began from."""


class SnapshotTable:
    """A table on a folder of any file system that Spark reads.

    Readers see a whole version; a write becomes visible when its version file appears,
    which only one writer can make.  A new version can be computed from the current one, since
    files are never overwritten.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, str(path)

    def versions(self) -> list[int]:
        """Versions that can be read, in order."""
        return [int(n.removesuffix(".json")) for n in store.children(self.spark, store.join(self.path, _VERSIONS)) if n.endswith(".json")]

    def _file(self, version: int) -> str:
        return store.join(self.path, _VERSIONS, f"{version:012d}.json")

    def _state(self, version: int) -> dict:
        return json.loads(store.read_text(self.spark, self._file(version)))

    @property
    def exists(self) -> bool:
        return bool(self.versions())

    @property
    def version(self) -> int:
        return max(self.versions(), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        there = self.versions()
        if not there or (version is not None and version not in there):
            raise FileNotFoundError(f"{self.path} has no version {version or 'yet'}")
        state = self._state(version or there[-1])
        schema = T.StructType.fromJson(state["schema"])
        return self.spark.read.schema(schema).parquet(*[store.join(self.path, f) for f in state["folders"]])

    def _files(self, df: DataFrame, partition_by: list[str] | None) -> str:
        folder = f"v-{time.time_ns()}-{uuid.uuid4().hex[:6]}"
        w = df.write.option("compression", "snappy")
        (w.partitionBy(*partition_by) if partition_by else w).parquet(store.join(self.path, folder))
        return folder

    def _publish(self, version: int, folders: list[str], schema: T.StructType) -> None:
        text = json.dumps({"version": version, "folders": folders, "schema": schema.jsonValue()})
        store.write_text(self.spark, self._file(version), text, overwrite=False)

    def write(self, df: DataFrame, partition_by: list[str] | None = None, keep: int = 5, since: int | None = None) -> int:
        """Write ``df`` as the next version; the ``keep`` latest versions stay.

        ``since`` is the version that ``df`` was computed from, by default the one at this
        call.  If another writer has published since, nothing changes and ``Conflict`` is raised.
        """
        since = self.version if since is None else since
        folder = self._files(df, partition_by)
        try:
            self._publish(since + 1, [folder], df.schema)
        except AlreadyThere as e:
            store.delete(self.spark, store.join(self.path, folder))
            raise Conflict(f"{self.path}: version {since + 1} is another writer's") from e
        self._clean(keep)
        return since + 1

    def append(self, df: DataFrame, keep: int = 5) -> int:
        """Add the rows of ``df``: only they are written.  Appends of several writers all count, in some order."""
        if not self.exists:
            try:
                return self.write(df, keep=keep, since=0)
            except Conflict:
                pass
        schema = T.StructType.fromJson(self._state(self.version)["schema"])
        folder = self._files(df.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in schema.fields]), None)
        while True:
            last = self.version
            try:
                self._publish(last + 1, [*self._state(last)["folders"], folder], schema)
            except AlreadyThere:
                continue
            self._clean(keep)
            return last + 1

    def _clean(self, keep: int) -> None:
        """Drop versions before the ``keep`` latest, and the folders that only they name."""
        there = self.versions()
        old, kept = there[:-keep], there[-keep:]
        used = {f for v in kept for f in self._state(v)["folders"]}
        for v in old:
            for f in self._state(v)["folders"]:
                if f not in used:
                    store.delete(self.spark, store.join(self.path, f))
            store.delete(self.spark, self._file(v))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A snapshot table's current version, or plain Parquet."""
    t = SnapshotTable(spark, path)
    return t.read() if t.exists else spark.read.parquet(str(path))
