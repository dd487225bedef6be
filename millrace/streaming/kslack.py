"""K-slack reordering on a stream.

Each key has a buffer.  Events wait in it until the clock passes their time plus K; then they
are released in the order of their time.  The clock is that of all arrivals, of whatever key:
the stream's watermark on arrival times, one batch behind, wakes every key whose first event
is due.  What arrives more than K after its time is reported as too late and left out.
Whatever waits is published as a provisional value with every batch that touches the key.
A stream that has ended moves no clock; ``flush`` releases what it still holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators.lateness import DAY_US, K_US, SlackBuffer

_OUT = "key string, kind string, event_us bigint, row_id bigint, value double, n bigint, rated bigint, total double"
_STATE = "us array<bigint>, ids array<bigint>, vals array<double>"


def _rows(key: str, kind: str, x: dict[str, np.ndarray]) -> pd.DataFrame:
    values = pd.Series(x["value"]).astype(object).where(~np.isnan(x["value"]), None)
    return pd.DataFrame({"key": key, "kind": kind, "event_us": x["event_us"], "row_id": x["row_id"], "value": values, "n": None, "rated": None, "total": None}, dtype=object)


def _step(k_us: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        buffer = SlackBuffer(k_us, mark * 1000 if mark > 0 else -(2**62))  # 0 is no mark yet
        if state.exists:
            us, ids, vals = state.get
            values = np.array([np.nan if v is None else v for v in vals], float)
            buffer.runs.append({"event_us": np.array(us, np.int64), "row_id": np.array(ids, np.int64), "arrival_us": np.array(us, np.int64), "value": values})
        out, none = [], pd.DataFrame({c: [] for c in ("event_us", "row_id", "arrival_us", "value")})
        for b in (none, *batches):  # without arrivals, it is the clock that moved
            rows = {c: b[c].to_numpy(np.float64 if c == "value" else np.int64) for c in SlackBuffer.COLUMNS}
            released, refused = buffer.push(rows)
            out += [_rows(key[0], "released", released), _rows(key[0], "too_late", refused)]
        held = buffer.held()
        rated = held["value"][~np.isnan(held["value"])]
        out.append(pd.DataFrame([(key[0], "provisional", None, None, None, len(held["row_id"]), len(rated), float(rated.sum()))], columns=out[0].columns, dtype=object))
        if len(held["row_id"]):
            values = [None if np.isnan(v) else v for v in held["value"].tolist()]
            state.update((held["event_us"].tolist(), held["row_id"].tolist(), values))
            state.setTimeoutTimestamp(max(1, -(-(int(held["event_us"][0]) + k_us) // 1000)))
        elif state.exists:
            state.remove()
        yield pd.concat([x for x in out if len(x)], ignore_index=True)

    return run


def reorder(events: DataFrame, k_us: int = K_US, slices: int = 8) -> DataFrame:
    """Released, too late and provisional rows of a stream of ``row_id, value, event_us, arrival_us``.

    Buffers are kept per day of event time and slice, so that no day's events gather in one
    place; order-sensitive use merges the slices of a day, each in order, by time.  Rows
    without event time only move the clock, those without arrival are left out.  Null values
    stay null; ``rated`` counts the values in ``total``.  An event that comes within K of its
    time, but in a batch after the clock has passed, is released at once.
    """
    arrival = F.timestamp_micros("arrival_us")
    # Spark drops rows behind the watermark.  The event itself has a null mark, which is never
    # behind; a second row that carries the arrival is only seen by the watermark.
    marks = F.when(F.col("event_us").isNotNull(), F.array(F.lit(None).cast("timestamp"), arrival)).otherwise(F.array(arrival))
    e = events.filter(F.col("arrival_us").isNotNull()).withColumn("_mark", F.explode(marks)).withWatermark("_mark", "0 seconds").filter(F.col("_mark").isNull())
    key = F.concat_ws("/", F.floor(F.col("event_us") / DAY_US), F.pmod(F.xxhash64("row_id"), F.lit(slices)))
    e = e.select(key.alias("key"), F.col("row_id").cast("bigint").alias("row_id"), F.col("value").cast("double").alias("value"), "event_us", "arrival_us", "_mark")
    return e.groupBy("key").applyInPandasWithState(_step(k_us), _OUT, _STATE, "update", GroupStateTimeout.EventTimeTimeout)


def flush(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The events that an ended stream with this checkpoint still holds, as released rows of ``reorder``'s columns.

    For streams that are not started again: their state stays as it is.
    """
    s = spark.read.format("statestore").load(checkpoint).select("key.key", "value.groupState.*")
    x = s.select("key", F.explode(F.arrays_zip("us", "ids", "vals")).alias("e"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("n", "bigint"), ("rated", "bigint"), ("total", "double"))]
    x = x.select("key", F.lit("released").alias("kind"), F.col("e.us").alias("event_us"), F.col("e.ids").alias("row_id"), F.col("e.vals").alias("value"), *none)
    return x.orderBy("event_us", "row_id")
