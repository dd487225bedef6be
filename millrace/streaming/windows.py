"""Streaming forms: windowed aggregates with a watermark, and upserts per micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.ranking import deduplicate
from millrace.operators.upsert import merge
from millrace.sources.snapshots import SnapshotTable


def tumbling(events: DataFrame, ts: str, value: str, width: str = "1 day", lateness: str = "7 days") -> DataFrame:
    """Counts and averages per window of event time; works on streams and tables.

    State of a window is dropped once the watermark passes its end, in output modes ``append``
    and ``update``.
    """
    e = events.withWatermark(ts, lateness) if events.isStreaming else events
    w = e.groupBy(F.window(ts, width)).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("avg_value"), F.approx_count_distinct("user_id").alias("users"))
    return w.select(F.col("window.start").alias("window_start"), "n", "avg_value", "users")


def latest_windows(updates: DataFrame) -> DataFrame:
    """The last state of each window, of updates that carry the ``batch`` they came with."""
    cols = [c for c in updates.columns if c not in ("window_start", "batch")]
    last = F.max_by(F.struct(*cols), "batch").alias("w")
    return updates.groupBy("window_start").agg(last).select("window_start", "w.*")


def distinct_within(events: DataFrame, keys: Sequence[str], ts: str, lateness: str = "7 days") -> DataFrame:
    """Repeated deliveries dropped, as far apart as ``lateness``."""
    e = events.withWatermark(ts, lateness) if events.isStreaming else events
    return e.dropDuplicatesWithinWatermark(list(keys)) if events.isStreaming else e.dropDuplicates(list(keys))


def upsert_batches(target: SnapshotTable, keys: Sequence[str], update_cols: Sequence[str], order: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that merges each micro-batch into a snapshot table."""

    def run(batch: DataFrame, _: int) -> None:
        fresh = deduplicate(batch, keys, [F.col(order).desc_nulls_last()])
        since = target.version
        target.write(merge(target.read(since), fresh, keys, update_cols, newer=order) if since else fresh, since=since)

    return run
