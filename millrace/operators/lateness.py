"""Problem 7: aggregates by event time, corrected as late events arrive, with a cut-off.

Method: K-slack reordering.  Arrivals are taken in the order in which they came; their
latest time is the clock.  An event waits in the buffer until no event that may still
count can be older than it: until the clock passes its time plus K.  Then it is released,
and so events leave the buffer in the order of their own time, for the order-sensitive
aggregation.  An arrival whose place was released before it came, more than K after its
time, is refused as too late.
What waits in the buffer is published meanwhile as provisional values.

The clock is the arrivals' own time, so that buffers of different event times do not depend
on each other: event time is range partitioned, rows of one time being cut on by row id, and
each task runs one buffer over its arrivals.  A hot day is thereby cut across tasks, and no
task holds more than its range.  A task folds what its buffer releases into one partial per
day, and partials of a day, a few per task, are merged in order.  The streaming form is in
``millrace.streaming.kslack``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.session import written

DAY_US = 86_400_000_000
ON_TIME_US = DAY_US
K_US = 7 * DAY_US
ON_TIME, LATE, TOO_LATE = "on_time", "late", "too_late"


def day_text(us: Column) -> Column:
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(us / DAY_US).cast("int")), "yyyy-MM-dd")


class SlackBuffer:
    """The K-slack buffer over arrays: arrivals in their order in, releases in the order of event time out.

    Columns are ``event_us, row_id, arrival_us, value``; ``value`` is NaN where there is none.
    What waits is kept in runs, each in order; a release takes the head of every run.
    """

    COLUMNS = ("event_us", "row_id", "arrival_us", "value")

    def __init__(self, k_us: int, clock: int = -(2**62)) -> None:
        self.k_us, self.clock = k_us, clock
        self.runs: list[dict[str, np.ndarray]] = []

    def push(self, rows: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
        """Take arrivals; what this releases, in order, and what is refused: what came more than K after its time."""
        refused = rows["arrival_us"] - rows["event_us"] > self.k_us
        order = np.lexsort((rows["row_id"], rows["event_us"]))
        order = order[~refused[order]]
        if len(order):
            self.runs.append({c: rows[c][order] for c in self.COLUMNS})
        if len(refused):
            self.clock = max(self.clock, int(rows["arrival_us"].max()))
        return self._release(self.clock - self.k_us), {c: rows[c][refused] for c in self.COLUMNS}

    def flush(self) -> dict[str, np.ndarray]:
        """All that still waits, when nothing more can come."""
        return self._release(np.iinfo(np.int64).max)

    def held(self) -> dict[str, np.ndarray]:
        return self._merged(self.runs)

    def _release(self, before: int) -> dict[str, np.ndarray]:
        cuts = [int(np.searchsorted(r["event_us"], before)) for r in self.runs]
        heads = [{c: v[:n] for c, v in r.items()} for r, n in zip(self.runs, cuts, strict=True) if n]
        self.runs = [{c: v[n:] for c, v in r.items()} for r, n in zip(self.runs, cuts, strict=True) if n < len(r["event_us"])]
        return self._merged(heads)

    def _merged(self, runs: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
        empty = {c: np.zeros(0, np.float64 if c == "value" else np.int64) for c in self.COLUMNS}
        out = {c: np.concatenate([empty[c], *(r[c] for r in runs)]) for c in self.COLUMNS}
        order = np.lexsort((out["row_id"], out["event_us"]))
        return {c: v[order] for c, v in out.items()}


def _columns(b: pa.RecordBatch) -> dict[str, np.ndarray]:
    out = {c: b[c].to_numpy() for c in ("event_us", "row_id", "arrival_us")}
    return out | {"value": b["value"].cast(pa.float64()).to_numpy(zero_copy_only=False)}


def _buffered(k_us: int, use: Callable[[Iterator[tuple[dict, dict]]], Iterator[pa.RecordBatch]]):
    """A task over arrivals in order: what its buffer releases and refuses goes to ``use``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flow() -> Iterator[tuple[dict, dict]]:
            buffer = SlackBuffer(k_us)
            for b in batches:
                yield buffer.push(_columns(b))
            yield buffer.flush(), buffer.held()  # nothing is held any more

        yield from use(flow())

    return run


def arrivals(df: DataFrame, event_us: Column, arrival_us: Column, row_id: str, value: str) -> DataFrame:
    """``event_us, row_id, arrival_us, value``, written once and cut into ranges of event time, each in order of arrival.

    Rows without event time or arrival have no place in time and are left out.  Repeated rows
    count like any row.  Arrivals at the same time are taken in the order of ``row_id``.
    """
    x = df.select(event_us.cast("bigint").alias("event_us"), F.col(row_id).cast("bigint").alias("row_id"), arrival_us.cast("bigint").alias("arrival_us"), F.col(value).cast("double").alias("value"))
    x = written(x.filter(F.col("event_us").isNotNull() & F.col("arrival_us").isNotNull()), "arrivals")  # range partitioning reads its input twice
    return x.repartitionByRange("event_us", "row_id").sortWithinPartitions("arrival_us", "row_id")


_VERDICTS = "row_id bigint, event_us bigint, verdict string"


def _verdicts(on_time_us: int):
    def run(flow: Iterator[tuple[dict, dict]]) -> Iterator[pa.RecordBatch]:
        for released, refused in flow:
            in_time = np.where(released["arrival_us"] - released["event_us"] > on_time_us, LATE, ON_TIME)
            kinds = np.concatenate([in_time, np.full(len(refused["row_id"]), TOO_LATE)])
            cols = [pa.array(np.concatenate([released[c], refused[c]])) for c in ("row_id", "event_us")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(kinds.astype(object), pa.string())], ["row_id", "event_us", "verdict"])

    return run


def reordered(arrived: DataFrame, k_us: int = K_US, on_time_us: int = ON_TIME_US) -> DataFrame:
    """``row_id, event_day, verdict`` of every arrival, as it leaves the buffer.

    ``on_time`` and ``late`` events were released, in order; they are late if they came more
    than ``on_time_us`` after their time.  ``too_late`` ones were refused: the clock had passed
    their time by more than K.  ``arrived`` comes from ``arrivals``.
    """
    x = arrived.mapInArrow(_buffered(k_us, _verdicts(on_time_us)), _VERDICTS)
    return x.select("row_id", day_text(F.col("event_us")).alias("event_day"), "verdict")


def _fold(flow: Iterator[tuple[dict, dict]]) -> Iterator[pa.RecordBatch]:
    """One partial per day of a run of releases, which are in the order of (event time, row)."""
    acc: dict[int, list] = {}  # day -> [first_us, first_row, first, last, n, sum, rated, ups]
    for released, _ in flow:
        us, row, v = released["event_us"], released["row_id"], released["value"]
        if not len(us):
            continue
        day = us // DAY_US
        at = np.flatnonzero(np.r_[True, day[1:] != day[:-1]])
        for a, e in zip(at, [*at[1:], len(day)], strict=True):
            x = v[a:e]
            x = x[~np.isnan(x)]
            p = acc.setdefault(int(day[a]), [int(us[a]), int(row[a]), None, None, 0, 0.0, 0, 0])
            p[4] += int(e - a)
            if len(x):
                p[7] += int((np.diff(x) > 0).sum()) + (p[3] is not None and x[0] > p[3])
                p[2] = float(x[0]) if p[2] is None else p[2]
                p[3] = float(x[-1])
                p[5] += float(x.sum())
                p[6] += len(x)
    cols = list(zip(*[[d, *p] for d, p in sorted(acc.items())], strict=True)) or [[]] * 9
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
    names = ["day", "at_us", "at_row", "first", "last", "n", "total", "rated", "ups"]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


_PARTIAL = "day bigint, at_us bigint, at_row bigint, first double, last double, n bigint, total double, rated bigint, ups bigint"


def ordered_daily(arrived: DataFrame, k_us: int = K_US) -> DataFrame:
    """Final values per event day over the released events, in event-time order.

    ``event_day, n, avg_value, first_value, last_value, ups``: ``ups`` counts events whose
    value is above that of the event before on the same day.  Events of the same time are
    ordered by ``row_id``.  Null values count in ``n`` only.  ``arrived`` comes from ``arrivals``.
    """
    runs = arrived.mapInArrow(_buffered(k_us, _fold), _PARTIAL)
    # a day's partials: at most one per task that held part of it
    order = W.partitionBy("day").orderBy("at_us", "at_row")
    before = F.last("last", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    step = F.coalesce((F.col("first") > before).cast("bigint"), F.lit(0))
    p = runs.withColumn("_ups", F.col("ups") + step).groupBy("day").agg(
        F.sum("n").alias("n"), F.try_divide(F.sum("total"), F.sum("rated")).alias("avg_value"),
        F.min_by("first", F.when(F.col("first").isNotNull(), F.struct("at_us", "at_row"))).alias("first_value"),
        F.max_by("last", F.when(F.col("last").isNotNull(), F.struct("at_us", "at_row"))).alias("last_value"),
        F.sum("_ups").alias("ups"),
    )
    return p.select(day_text(F.col("day") * DAY_US).alias("event_day"), "n", "avg_value", "first_value", "last_value", "ups")


def _published(flow: Iterator[tuple[dict, dict]]) -> Iterator[pa.RecordBatch]:
    """Per event day and day of lag, what the buffer took in; summed up as it is released."""
    acc: dict[tuple[int, int], list] = {}
    for released, _ in flow:
        if not len(released["row_id"]):
            continue
        day = released["event_us"] // DAY_US
        lag = np.maximum(0, -((released["event_us"] - released["arrival_us"]) // DAY_US) - 1)  # days begun, from 0
        keys, which = np.unique(np.stack([day, lag], 1), axis=0, return_inverse=True)
        v = released["value"]
        sums = [np.bincount(which, minlength=len(keys)), np.bincount(which, np.nan_to_num(v), len(keys)), np.bincount(which, ~np.isnan(v), len(keys))]
        for (d, g), n, total, rated in zip(keys.tolist(), *(x.tolist() for x in sums), strict=True):
            p = acc.setdefault((d, g), [0, 0.0, 0])
            p[0], p[1], p[2] = p[0] + int(n), p[1] + total, p[2] + int(rated)
    cols = list(zip(*[[*k, *p] for k, p in sorted(acc.items())], strict=True)) or [[]] * 5
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["day", "lag_day", "n", "total", "rated"])


def revisions(arrived: DataFrame, k_us: int = K_US) -> DataFrame:
    """What was published per event day from the buffer as late events came: one row per day and day of lag.

    ``event_day, lag_day, n, avg_value, final``: counts and averages of all that the buffer had
    taken in within ``lag_day`` days of its time.  The values are provisional until ``lag_day``
    reaches K; then the last of the day is released and they are final.
    """
    days = max(1, -(-k_us // DAY_US))
    part = arrived.mapInArrow(_buffered(k_us, _published), "day bigint, lag_day int, n bigint, total double, rated bigint")
    part = part.groupBy("day", "lag_day").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("rated").alias("rated"))
    order = W.partitionBy("day").orderBy("lag_day")
    w = order.rowsBetween(W.unboundedPreceding, 0)
    run = part.select("day", "lag_day", F.sum("n").over(w).alias("n"), F.try_divide(F.sum("total").over(w), F.sum("rated").over(w)).alias("avg_value"), F.lead("lag_day").over(order).alias("_next"))
    return run.select(day_text(F.col("day") * DAY_US).alias("event_day"), "lag_day", "n", "avg_value", (F.col("_next").isNull() | (F.col("lag_day") >= days - 1)).alias("final"))
