"""Problem 4: history of changing entity attributes from periodic snapshots.

Method: consecutive snapshots are differenced by one null-safe full outer join, which
classifies keys as inserted, changed or deleted; the union of these change events gets its
validity by ``lead``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OPEN_END = "9999-12-31"


def latest_per_snapshot(df: DataFrame, key: str, snapshot: str, loaded: str, attrs: list[str], tie: str) -> DataFrame:
    """One row per (key, snapshot): the one loaded last; of equal loads that with the largest ``tie``.

    A partial aggregate reduces repeated rows before the shuffle, so a key that holds a
    large part of all rows does not gather them in one task.  Rows without key or snapshot
    are ignored; a null load time counts as the earliest.
    """
    best = F.max(F.struct(F.col(loaded), F.col(tie), *[F.col(a) for a in attrs]))
    rows = df.filter(F.col(key).isNotNull() & F.col(snapshot).isNotNull())
    return rows.groupBy(F.col(key).alias("key"), F.col(snapshot).cast("date").alias("snap")).agg(best.alias("b")).select("key", "snap", *[F.col("b")[a].alias(a) for a in attrs])


def changes(states: DataFrame, attrs: list[str]) -> DataFrame:
    """Change events ``key, at, op, <attrs>`` between consecutive snapshots.

    ``states`` has one row per (key, snap).  ``op`` is ``inserted``, ``changed`` or
    ``deleted``; for ``deleted`` the attributes are null and ``at`` is the first snapshot
    without the key.  Null attributes compare as values.
    """
    dates = states.select("snap").distinct()
    order = W.orderBy("snap")  # over the few distinct dates only
    index = dates.select("snap", F.lead("snap").over(order).alias("following"))
    cur = states.join(index, "snap")
    prev = cur.filter(F.col("following").isNotNull()).select(F.col("key").alias("p_key"), F.col("following").alias("p_at"), *[F.col(a).alias(f"p_{a}") for a in attrs])
    c = cur.select("key", "snap", *attrs)
    j = c.join(prev, (c["key"] == prev["p_key"]) & (c["snap"] == prev["p_at"]), "full_outer")
    differs = F.lit(False)
    for a in attrs:
        differs = differs | ~F.col(a).eqNullSafe(F.col(f"p_{a}"))
    op = F.when(F.col("p_key").isNull(), "inserted").when(F.col("key").isNull(), "deleted").when(differs, "changed")
    j = j.select(F.coalesce("key", "p_key").alias("key"), F.coalesce("snap", "p_at").alias("at"), op.alias("op"), *[F.col(a).alias(a) for a in attrs])
    return j.filter(F.col("op").isNotNull())


def versions(events: DataFrame, attrs: list[str]) -> DataFrame:
    """Validity periods ``key, valid_from, valid_to, <attrs>`` from change events.

    A version ends where the key's next event is; the last one is open.
    """
    follow = F.lead("at").over(W.partitionBy("key").orderBy("at"))
    x = events.withColumn("_end", follow).filter(F.col("op") != "deleted")
    return x.select("key", F.col("at").alias("valid_from"), F.coalesce("_end", F.lit(OPEN_END).cast("date")).alias("valid_to"), *attrs)


def snapshot_history(df: DataFrame, key: str, snapshot: str, loaded: str, attrs: list[str], tie: str) -> DataFrame:
    """Full history of ``attrs`` per key.  An empty input gives no versions."""
    return versions(changes(latest_per_snapshot(df, key, snapshot, loaded, attrs, tie), attrs), attrs)
