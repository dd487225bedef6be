"""Problem 1: references to records that do not exist, are deleted or arrive later.

Method: parent keys are cut into ranges of equal size; the parents of a range are sorted
arrays in one task, and the references of that range are probed against them in vectorised
batches by binary search.  Ranges come from a sketch of the parent keys.  A range with more
parents or references than a task should hold is split by key, as often as its numbers
say, so that groups are bounded at every size; a single key with more references than that
(one key can hold a third of all rows) is cut into slices of rows, and only its own parent
is repeated for them.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import written
from millrace.util import range_key, sketch, slices_for

NEVER = np.iinfo(np.int64).max
PARENTS_PER_RANGE = 250_000
ROWS_PER_GROUP = 200_000
#: Ranges of a table's keys at most; beyond their size they are split by key.
RANGES = 256


def _us(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def parents_with_deletion(df: DataFrame, key: str, loaded: str, deleted: str) -> DataFrame:
    """One row per non-null key: its earliest load and its earliest deletion."""
    return df.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("bigint").alias("key")).agg(F.min(_us(F.col(loaded))).alias("seen_us"), F.min(_us(F.col(deleted))).alias("gone_us"))


def parents_from_snapshots(df: DataFrame, key: str, snapshot: str, loaded: str) -> DataFrame:
    """One row per non-null key: its earliest load, and 00:00 UTC of the snapshot after its last one.

    Keys in the last snapshot have no deletion.  Snapshot dates are a few distinct values
    made by a partial aggregate; the next one is found by a window over those alone.
    """
    from pyspark.sql import Window as W

    dates = df.filter(F.col(snapshot).isNotNull()).select(F.col(snapshot).alias("_d")).distinct()
    follow = dates.select("_d", F.lead("_d").over(W.orderBy("_d")).alias("_next"))
    keys = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("bigint").alias("key")).agg(F.min(_us(F.col(loaded))).alias("seen_us"), F.max(snapshot).alias("_last"))
    gone = (F.unix_date("_next").cast("bigint") * 86_400_000_000).alias("gone_us")
    return keys.join(follow, keys["_last"] == follow["_d"], "left").select("key", "seen_us", gone)


def _probe(left: pa.Table, right: pa.Table) -> pa.Table:
    """References (t, key, at_us, row_id) of a group, of one table, against the sorted parents of its range."""
    names = right["key"].to_numpy()
    order = np.argsort(names, kind="stable")
    names = names[order]
    seen = right["seen_us"].fill_null(NEVER).to_numpy()[order]
    gone = right["gone_us"].fill_null(NEVER).to_numpy()[order]
    key = left["key"].to_numpy()
    no_time = left["at_us"].is_null().to_numpy() if left.num_rows else np.zeros(0, bool)
    at = left["at_us"].fill_null(0).to_numpy()
    pos = np.searchsorted(names, key)
    inside = np.minimum(pos, max(len(names) - 1, 0))
    there = names[inside] == key if len(names) else np.zeros(len(key), bool)
    seen_at = seen[inside] if len(names) else at
    gone_at = gone[inside] if len(names) else at
    state = np.zeros(len(key), np.int8)  # 1 missing, 2 late, 3 deleted
    state[there & ~no_time & (gone_at <= at) & (gone_at != NEVER)] = 3
    state[there & ~no_time & (seen_at > at)] = 2
    state[~there] = 1
    hit = np.flatnonzero(state)
    states = np.array(["", "missing", "late", "deleted"], object)[state[hit]]
    cut = left.take(pa.array(hit))
    return pa.table({"t": cut["t"], "row_id": cut["row_id"], "at_us": cut["at_us"], "key": cut["key"], "state": pa.array(states, pa.string())})


def orphan_rows(
    refs: DataFrame, at: str, row_id: str, tables: Mapping[str, tuple[str, DataFrame]],
    parents_per_range: int = PARENTS_PER_RANGE, rows_per_group: int = ROWS_PER_GROUP,
) -> DataFrame:
    """References without a usable parent: ``ref_table, period, row_id, key, state``.

    ``tables`` gives per referred table the column of ``refs`` that refers to it and its
    parents, ``key, seen_us, gone_us`` with one row per key; all are probed in one pass.  The
    first state that applies: ``missing`` (no such key), ``late`` (first loaded after the
    reference), ``deleted`` (gone at or before it).  Null keys refer to nothing and give no
    row.  A reference without a time can only be ``missing`` and has the period ``''``.
    Repeated rows each give a row.  An empty parent table makes every reference missing.
    """
    p = None
    for i, (_, parents) in enumerate(tables.values()):
        x = parents.filter(F.col("key").isNotNull()).select(F.lit(i).alias("t"), F.col("key").cast("bigint").alias("key"), "seen_us", "gone_us")
        p = x if p is None else p.unionByName(x)
    p = written(p, "parents")
    # one sketch per table; of its quantiles as many are taken as there are ranges to make
    quantiles = {r["t"]: (r["n"], r["q"]) for r in p.groupBy("t").agg(F.count(F.lit(1)).alias("n"), sketch("key", RANGES).alias("q")).collect()}
    bounds = []
    for i in range(len(tables)):
        n, q = quantiles.get(i, (0, []))
        parts = min(RANGES, slices_for(n, parents_per_range))
        bounds.append(sorted({q[j * RANGES // parts - 1] for j in range(1, parts)}))
    first = np.r_[0, np.cumsum([len(b) + 1 for b in bounds])].tolist()
    part = lambda i, c: range_key(c, bounds[i]) + first[i]
    whose = lambda c: reduce(lambda e, i: F.when(F.col("t") == i, part(i, c)).otherwise(e), range(len(tables)), F.lit(None).cast("int"))
    keys = [F.col(k).cast("bigint") for k, _ in tables.values()]
    links = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), c.alias("key"), part(i, c).alias("g")) for i, c in enumerate(keys)])).alias("l")
    r = refs.select(_us(F.col(at)).alias("at_us"), F.col(row_id).cast("bigint").alias("row_id"), links).filter("l.key is not null").select("at_us", "row_id", "l.*")

    per_key = written(r.groupBy("t", "g", "key").agg(F.count(F.lit(1)).alias("n")), "references")
    hot = written(per_key.filter(F.col("n") > rows_per_group).select("t", "key", F.ceil(F.col("n") / rows_per_group).cast("int").alias("_s")), "hot")
    # of each range the references to keys that are not hot, and the parents: two numbers
    sizes = per_key.filter(F.col("n") <= rows_per_group).groupBy("g").agg(F.sum("n").alias("refs"), F.lit(0).cast("bigint").alias("parents"))
    sizes = sizes.unionByName(p.groupBy(whose(F.col("key")).alias("g")).agg(F.lit(0).cast("bigint").alias("refs"), F.count(F.lit(1)).alias("parents")))
    split = [1] * first[-1]
    for x in sizes.collect():
        split[x["g"]] = max(split[x["g"]], slices_for(x["refs"], rows_per_group), slices_for(x["parents"], parents_per_range))
    h = F.pmod(F.xxhash64("key"), F.element_at(F.array(*[F.lit(n) for n in split]), F.col("g") + 1).cast("bigint")).cast("int")
    slices = F.coalesce("_s", F.lit(1))
    r = r.withColumn("h", h).join(hot, ["t", "key"], "left").withColumn("s", F.pmod(F.xxhash64("row_id"), slices.cast("bigint")).cast("int")).drop("_s")
    p = p.withColumn("g", whose(F.col("key"))).withColumn("h", h).join(hot, ["t", "key"], "left").withColumn("s", F.explode(F.sequence(F.lit(0), slices - 1))).drop("_s")
    found = r.groupBy("g", "h", "s").cogroup(p.groupBy("g", "h", "s")).applyInArrow(_probe, "t int, row_id bigint, at_us bigint, key bigint, state string")
    period = F.coalesce(F.date_format(F.timestamp_micros("at_us").cast("timestamp_ntz"), "yyyy-MM"), F.lit(""))
    name = F.element_at(F.array(*[F.lit(t) for t in tables]), F.col("t") + 1)
    return found.select(name.alias("ref_table"), period.alias("period"), "row_id", "key", "state")


def orphan_report(rows: DataFrame) -> DataFrame:
    """Misses per table, period and state: rows and distinct keys."""
    by_key = rows.groupBy("ref_table", "period", "state", "key").agg(F.count(F.lit(1)).alias("n"))
    return by_key.groupBy("ref_table", "period", "state").agg(F.sum("n").alias("orphan_rows"), F.count(F.lit(1)).alias("orphan_keys"))
