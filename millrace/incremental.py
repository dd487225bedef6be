"""High-water marks, stage checkpoints and incremental runs."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.ranking import deduplicate
from millrace.sources import store


def filter_since(df: DataFrame, col: str, mark: str | None) -> DataFrame:
    """Rows strictly after the mark; without a mark all rows, null times included.

    The mark is one literal of the column's type, so that the filter reaches the scan.
    """
    if mark is None:
        return df
    kind = df.schema[col].dataType.simpleString()
    literal = F.lit(mark) if kind == "string" else F.lit(mark).cast(kind)
    return df.filter(F.col(col) > literal)


def high_mark(df: DataFrame, col: str) -> str | None:
    """The latest value as text; None for an empty table or only nulls."""
    return df.agg(F.max(col).cast("string").alias("m")).first()["m"]


class StateFile:
    """A small JSON document per key, each its own file, on any file system: parallel writers of different keys do not meet."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, str(folder)

    def _path(self, key: str) -> str:
        return store.join(self.folder, f"{key.replace('/', '_')}.json")

    def get(self, key: str) -> dict:
        p = self._path(key)
        return json.loads(store.read_text(self.spark, p)) if store.exists(self.spark, p) else {}

    def put(self, key: str, value: dict) -> None:
        store.write_text(self.spark, self._path(key), json.dumps(value, sort_keys=True, default=str))

    def keys(self) -> list[str]:
        return [n.removesuffix(".json") for n in store.children(self.spark, self.folder) if n.endswith(".json")]


class Watermarks:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.state = spark, StateFile(spark, folder)

    def as_dataframe(self) -> DataFrame:
        rows = [(k, self.get(k)) for k in self.state.keys()]
        return self.spark.createDataFrame(rows, "table_name string, mark string")

    def get(self, table: str) -> str | None:
        return self.state.get(table).get("mark")

    def set(self, table: str, mark: str) -> None:
        self.state.put(table, {"mark": mark})

    def advance(self, table: str, df: DataFrame, col: str) -> str | None:
        """Set the mark to the latest value of ``df``; an empty ``df`` leaves it."""
        m = high_mark(df, col)
        if m is not None:
            self.state.put(table, {"mark": m})
        return self.get(table)

    def consume(self, table: str, df: DataFrame, col: str) -> int:
        """Count the rows after the mark, then move it to their latest value; both of one pass."""
        x = filter_since(df, col, self.get(table)).agg(F.count(F.lit(1)).alias("n"), F.max(col).cast("string").alias("m")).first()
        if x["m"] is not None:
            self.state.put(table, {"mark": x["m"]})
        return x["n"]


class Checkpoint:
    """Which stages of a run are done, failed or open, and what they left for the next."""

    def __init__(self, spark: SparkSession, folder: str, run_id: str) -> None:
        self.spark, self.state, self.run_id = spark, StateFile(spark, folder), run_id
        self.data = self.state.get(run_id) or {"stages": {}, "status": "running"}

    def is_done(self, stage: str) -> bool:
        return self.data["stages"].get(stage, {}).get("status") == "done"

    def result(self, stage: str):
        return self.data["stages"].get(stage, {}).get("result")

    def _set(self, stage: str, **x) -> None:
        self.data["stages"][stage] = x
        self.state.put(self.run_id, self.data)

    def mark_done(self, stage: str, result=None) -> None:
        self._set(stage, status="done", result=result)

    def mark_failed(self, stage: str, error: str) -> None:
        self.data["status"] = "failed"
        self._set(stage, status="failed", error=error)

    def complete(self) -> None:
        self.data["status"] = "complete"
        self.state.put(self.run_id, self.data)

    def status(self) -> dict:
        return {"run_id": self.run_id, **self.data}

    def as_dataframe(self) -> DataFrame:
        """A row per stage: ``run_id, stage, status, error``."""
        rows = [(self.run_id, n, x["status"], x.get("error")) for n, x in self.data["stages"].items()]
        return self.spark.createDataFrame(rows, "run_id string, stage string, status string, error string")


def run_stages(checkpoint: Checkpoint, stages: list[tuple[str, Callable]]) -> dict:
    """Run stages in order, skipping those done before.  Each gets the results so far.

    What a stage returns is kept as JSON, so that a resumed run sees the same bounds as the
    first did.
    """
    results = {}
    for name, f in stages:
        if not checkpoint.is_done(name):
            try:
                checkpoint.mark_done(name, f(results))
            except Exception as e:
                checkpoint.mark_failed(name, str(e)[:500])
                raise
        results[name] = checkpoint.result(name)
    checkpoint.complete()
    return results


def full_vs_incremental(full: DataFrame, delta: DataFrame, col: str, mark: str) -> DataFrame:
    """One row: rows of a full refresh and of the slice after the mark, and the share saved."""
    new = filter_since(delta, col, mark)
    x = full.agg(F.count(F.lit(1)).alias("full_rows")).withColumn("incremental_rows", new.agg(F.count(F.lit(1))).scalar())
    return x.withColumn("saved_pct", F.round((1 - F.try_divide(F.col("incremental_rows"), F.col("full_rows"))) * 100, 1))


def append_then_dedupe(table: DataFrame, delta: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The table after a delta: both together, of each key the first row in ``order``."""
    return deduplicate(table.unionByName(delta, allowMissingColumns=True), keys, order)


@dataclass(frozen=True)
class Comparison:
    """A full refresh beside an incremental run over the same data."""

    full_s: float
    incremental_s: float
    full_rows: int
    incremental_rows: int
    full_result: int
    incremental_result: int

    @property
    def speedup(self) -> float | None:
        return self.full_s / self.incremental_s if self.incremental_s else None

    @property
    def saved_pct(self) -> float:
        """Of the cost of a full refresh, by the rows that each handles."""
        return round((1 - self.incremental_rows / self.full_rows) * 100, 1) if self.full_rows else 0.0

    @property
    def accurate(self) -> bool:
        """Both lead to as many rows."""
        return self.full_result == self.incremental_result

    def as_dict(self) -> dict:
        return {**asdict(self), "speedup": self.speedup, "saved_pct": self.saved_pct, "accurate": self.accurate}


def benchmark(full: Callable[[], tuple[int, int]], incremental: Callable[[], tuple[int, int]], save: StateFile | None = None, name: str = "benchmark") -> Comparison:
    """Times of both ways; each callable returns the rows it handled and the rows of its result.  With ``save`` the record is kept."""
    took, got = [], []
    for run in (full, incremental):
        t = time.perf_counter()
        got.append(run())
        took.append(time.perf_counter() - t)
    c = Comparison(*took, got[0][0], got[1][0], got[0][1], got[1][1])
    if save:
        save.put(name, c.as_dict())
    return c
