"""An in-process flow of tasks: order, parallel branches, retries, deadlines and a log of runs."""

from __future__ import annotations

import json
import time
import traceback
from collections.abc import Callable, Mapping
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from millrace.quality.rules import Report
from millrace.sources import store


class GateFailed(RuntimeError):
    """A quality gate did not pass."""


@dataclass(frozen=True)
class Retry:
    """``retries`` further attempts; the pause doubles from ``delay_s`` up to ``max_delay_s``."""

    retries: int = 3
    delay_s: float = 300.0
    max_delay_s: float = 1800.0

    def pause(self, attempt: int) -> float:
        return min(self.delay_s * 2 ** (attempt - 1), self.max_delay_s)


@dataclass
class Task:
    name: str
    run: Callable[[dict], object]
    after: tuple[str, ...] = ()
    deadline_s: float | None = None
    always: bool = False  # runs whatever became of the tasks before


@dataclass
class TaskRun:
    task: str
    status: str
    attempts: int
    elapsed_s: float
    rows: int | None = None
    error: str = ""
    missed_deadline: bool = False
    at: str = field(default_factory=lambda: datetime.now(UTC).isoformat())


class Flow:
    """Tasks with their order.  A task's result is seen by those after it in ``context``."""

    def __init__(self, tasks: list[Task], retry: Retry | None = None, on_miss: Callable[[TaskRun], None] | None = None, sleep: Callable[[float], None] = time.sleep, workers: int = 4) -> None:
        self.tasks = {t.name: t for t in tasks}
        self.retry, self.on_miss, self.sleep, self.workers = retry or Retry(), on_miss, sleep, workers
        unknown = {d for t in tasks for d in t.after} - set(self.tasks)
        if unknown:
            raise ValueError(f"unknown tasks {sorted(unknown)}")
        self.order()

    def order(self) -> list[str]:
        """A topological order; cycles are refused."""
        left, out = {n: set(t.after) for n, t in self.tasks.items()}, []
        while left:
            ready = sorted(n for n, d in left.items() if not d)
            if not ready:
                raise ValueError(f"cycle among {sorted(left)}")
            out += ready
            left = {n: d - set(ready) for n, d in left.items() if n not in ready}
        return out

    def _one(self, t: Task, context: dict, began: float) -> TaskRun:
        start, attempt = time.monotonic(), 0
        while True:
            attempt += 1
            try:
                context[t.name] = t.run(context)
                rows = context[t.name] if isinstance(context[t.name], int) and not isinstance(context[t.name], bool) else None
                run = TaskRun(t.name, "success", attempt, time.monotonic() - start, rows)
                break
            except Exception as e:
                if attempt > self.retry.retries or isinstance(e, GateFailed):
                    run = TaskRun(t.name, "failed", attempt, time.monotonic() - start, error="".join(traceback.format_exception_only(e)).strip()[:500])
                    break
                self.sleep(self.retry.pause(attempt))
        if t.deadline_s is not None and time.monotonic() - began > t.deadline_s:
            run.missed_deadline = True
            if self.on_miss:
                self.on_miss(run)
        return run

    def execute(self, context: dict | None = None) -> list[TaskRun]:
        """Run all tasks, independent ones at the same time; one record per task."""
        context, began = context if context is not None else {}, time.monotonic()
        runs: dict[str, TaskRun] = {}
        pending, active = set(self.tasks), {}
        with ThreadPoolExecutor(self.workers) as pool:
            while pending or active:
                for n in sorted(pending):
                    t = self.tasks[n]
                    if not all(d in runs for d in t.after):
                        continue
                    pending.discard(n)
                    if not t.always and any(runs[d].status != "success" for d in t.after):
                        runs[n] = TaskRun(n, "skipped", 0, 0.0)
                    else:
                        active[pool.submit(self._one, t, context, began)] = n
                if active:
                    done: set[Future]
                    done, _ = wait(active, return_when=FIRST_COMPLETED)
                    for f in done:
                        runs[active.pop(f)] = f.result()
        return [runs[n] for n in self.order()]


def quality_gate(reports: Mapping[str, Report]) -> None:
    bad = sorted(n for n, r in reports.items() if not r.ok)
    if bad:
        raise GateFailed(f"quality suites failed: {', '.join(bad)}")


class RunLog:
    """Task records, failures included: one file per run, so that parallel runs append without meeting."""

    SCHEMA = "task string, status string, attempts int, elapsed_s double, rows bigint, error string, missed_deadline boolean, at string"

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, str(folder)

    def add(self, runs: list[TaskRun]) -> None:
        store.write_text(self.spark, store.join(self.folder, f"{time.time_ns()}.json"), "\n".join(json.dumps(r.__dict__) for r in runs))

    def read(self, last: int | None = None) -> list[dict]:
        lines = [x for n in store.children(self.spark, self.folder) for x in store.read_text(self.spark, store.join(self.folder, n)).splitlines()]
        rows = [json.loads(x) for x in lines]
        return rows[-last:] if last else rows

    def as_dataframe(self) -> DataFrame:
        if not store.children(self.spark, self.folder):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).json(self.folder)


def standard_flow(steps: Mapping[str, Callable[[dict], object]], **options) -> Flow:
    """The usual shape: three ingests side by side, cleaning, quality gate, analytics, then incremental and monitoring."""
    hour = 3600
    ingests = ("ingest_ratings", "ingest_movies", "ingest_users")
    tasks = [Task(n, steps[n], (), hour) for n in ingests]
    tasks += [
        Task("clean", steps["clean"], ingests, 3 * hour),
        Task("quality", steps["quality"], ("clean",), 4 * hour),
        Task("analytics", steps["analytics"], ("quality",), 7 * hour),
        Task("incremental", steps["incremental"], ("analytics",)),
        Task("monitoring", steps["monitoring"], ("analytics",), always=True),
    ]
    return Flow(tasks, **options)
