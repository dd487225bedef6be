"""Problem 5: attributes as they were known at each event's time.

Method: events and changes are co-grouped by entity; per group a vectorised binary search
finds the latest version valid and recorded by each event time.

A group is a bucket of entities, so that a task searches many at once.  An entity with more
events than half a bucket is spread over slices of events, each with a copy of its changes;
one with that many changes is likewise cut into slices of changes, each probed by its
events, and the best of the slices' answers is taken by an aggregate.  The bound is a number
of rows, so that groups are bounded at every size of the data; the entities beyond it are a
table, joined to both sides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from millrace.session import written
from millrace.util import slices_for

ROWS_PER_BUCKET = 150_000


def _search(attrs: list[str]):
    def run(events: pa.Table, known: pa.Table) -> pa.Table:
        ids = events["row_id"]
        if not events.num_rows or not known.num_rows:
            none = pa.array([], pa.int64())
            return pa.table({"row_id": ids.slice(0, 0), "valid": none, "rec_us": none, "tie": none, **{a: pa.array([], pa.string()) for a in attrs}})
        key, at, valid, tie = (known[c].to_numpy() for c in ("key", "rec_us", "valid", "tie"))
        order = np.lexsort((tie, valid, at, key))
        key, at = key[order], at[order]
        # of versions recorded so far the newest counts: rank them by (valid, recorded, tie), keep the running best of an entity
        rank = np.empty(len(order), np.int64)
        rank[np.lexsort((tie[order], at, valid[order]))] = np.arange(len(order))
        starts = np.r_[True, key[1:] != key[:-1]]
        group = np.cumsum(starts) - 1
        best = np.maximum.accumulate(rank + group * len(order)) - group * len(order)
        row_of = np.empty(len(order), np.int64)
        row_of[rank] = order
        # binary search on (entity, time) as one ordered number: the position of the time among all times, by entity
        times = np.unique(at)
        slot = np.searchsorted(times, at)
        names = key[starts]
        e_key, e_at = events["key"].to_numpy(), events["at_us"].to_numpy()
        g = np.searchsorted(names, e_key)
        there = (g < len(names)) & (names[np.minimum(g, len(names) - 1)] == e_key)
        e_slot = np.searchsorted(times, e_at, side="right") - 1
        width = len(times) + 1
        pos = np.searchsorted(group * width + slot, g * width + e_slot, side="right") - 1
        ok = there & (pos >= 0) & (e_slot >= 0)
        ok &= group[np.maximum(pos, 0)] == g
        hit = np.flatnonzero(ok)
        rows = pa.array(row_of[best[pos[hit]]])
        got = known.take(rows)
        return pa.table({"row_id": ids.take(pa.array(hit)), **{c: got[c] for c in ("valid", "rec_us", "tie")}, **{a: got[a].cast(pa.string()) for a in attrs}})

    return run


def as_known(events: DataFrame, known: DataFrame, attrs: list[str], rows_per_bucket: int = ROWS_PER_BUCKET, event_keys: DataFrame | None = None) -> DataFrame:
    """``row_id, <attrs>`` of each event whose entity had a version recorded by then.

    ``events`` has ``row_id, key, at_us``; ``known`` has ``key, rec_us`` (when recorded),
    ``valid`` (from when on it holds, a number), ``tie`` and the attributes as strings.  Of the
    versions recorded at or before the event the one with the largest ``valid`` counts, then
    the latest recorded, then the largest ``tie``.  Rows with a null key or time are ignored
    on both sides; events without a version give no row; an empty side gives none at all.
    ``row_id`` is expected to be unique.  ``event_keys``, a ``key`` per event, is counted in
    place of ``events`` where those are costly to compute.
    """
    e = events.filter(F.col("key").isNotNull() & F.col("at_us").isNotNull()).select("row_id", F.col("key").cast("bigint").alias("key"), "at_us")
    k = known.filter(F.col("key").isNotNull() & F.col("rec_us").isNotNull() & F.col("valid").isNotNull())
    k = k.select(F.col("key").cast("bigint").alias("key"), "rec_us", F.col("valid").cast("bigint").alias("valid"), F.col("tie").cast("bigint").alias("tie"), *attrs)
    keys = e if event_keys is None else event_keys
    hot, rows, cut = hot_entities(keys, k, max(1, rows_per_bucket // 2))
    buckets = F.lit(slices_for(rows, rows_per_bucket))
    both = {"_ne": F.coalesce("_ne", F.lit(1)), "_nk": F.coalesce("_nk", F.lit(1))}
    one = lambda c, n: F.pmod(F.xxhash64(c), F.col(n).cast("bigint")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    group = F.pmod(F.xxhash64("key", "s", "c"), buckets).cast("int").alias("g")
    # a pair of slices (of events, of changes) of an entity meets in one bucket; c tells slices of changes apart that share it
    e = e.join(hot, "key", "left").withColumns(both).withColumn("s", one("row_id", "_ne")).select("*", every("_nk").alias("c")).select("row_id", "key", "at_us", group)
    k = k.join(hot, "key", "left").withColumns(both).withColumn("c", one("rec_us", "_nk")).select("*", every("_ne").alias("s")).select("key", "rec_us", "valid", "tie", *attrs, group)
    schema = "row_id bigint, valid bigint, rec_us bigint, tie bigint, " + ", ".join(f"{a} string" for a in attrs)
    found = e.groupBy("g").cogroup(k.groupBy("g")).applyInArrow(_search(attrs), schema)
    if cut:
        # slices of one entity may fall into one bucket, whose events then stand there more than once
        best = F.max(F.struct("valid", "rec_us", "tie", *attrs)).alias("b")
        found = found.groupBy("row_id").agg(best).select("row_id", "b.*")
    return found.select("row_id", *attrs)


def hot_entities(events: DataFrame, known: DataFrame, bound: int) -> tuple[DataFrame, int, bool]:
    """Entities with more than ``bound`` events or changes: ``key, _ne, _nk``, the slices each side is cut into.

    Also the rows of both sides, slices' copies included, and whether any changes are cut.  The
    table has at most rows / bound entries, and is written, so that the planner knows its size
    and broadcasts it only if it is small.
    """
    side = lambda df, n: df.filter(F.col("key").isNotNull()).select(F.col("key").cast("bigint").alias("key"), F.lit(n).alias("_side"))
    counts = side(events, 0).unionByName(side(known, 1)).groupBy("key").agg(F.count_if(F.col("_side") == 0).alias("n0"), F.count_if(F.col("_side") == 1).alias("n1"))
    slices = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / bound)).cast("int")
    seen = Observation()
    watched = counts.observe(seen, F.coalesce(F.sum("n0"), F.lit(0)).alias("n0"), F.coalesce(F.sum("n1"), F.lit(0)).alias("n1"))
    hot = written(watched.filter((F.col("n0") > bound) | (F.col("n1") > bound)).select("key", slices("n0").alias("_ne"), slices("n1").alias("_nk"), "n0", "n1"), "hot")
    more = hot.agg(F.coalesce(F.sum(F.col("n0") * (F.col("_nk") - 1) + F.col("n1") * (F.col("_ne") - 1)), F.lit(0)).alias("copies"), F.coalesce(F.max("_nk"), F.lit(1)).alias("nk")).first()
    return hot.drop("n0", "n1"), seen.get["n0"] + seen.get["n1"] + more["copies"], more["nk"] > 1
