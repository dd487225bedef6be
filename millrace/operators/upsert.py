"""Merges, change capture and type-2 history as joins over snapshots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _keyed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return df.filter(cond)


def _on(keys: Sequence[str], a: str = "t", b: str = "s") -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & (F.col(f"{a}.{k}") == F.col(f"{b}.{k}"))
    return cond


def merge(target: DataFrame, source: DataFrame, keys: Sequence[str], update_cols: Sequence[str], newer: str | None = "rated_at", with_action: bool = False) -> DataFrame:
    """``target`` after an upsert of ``source``.

    Matched rows take ``update_cols`` from the source, if its ``newer`` is at least the
    target's (only where ``newer`` is among the updated columns, else always); other columns stay.  Unmatched source rows are inserted whole.
    Source rows with a null key are left out; null keys of the target stay as they are.
    ``source`` must have one row per key.  With ``with_action`` a column ``action`` tells
    ``insert``, ``update`` or ``keep``.
    """
    s = _keyed(source, keys).select(*[c for c in target.columns if c in source.columns]).withColumn("_in_s", F.lit(True)).alias("s")
    t = target.withColumn("_in_t", F.lit(True)).alias("t")
    j = t.join(s, _on(keys), "full_outer")
    matched = F.col("_in_t").isNotNull() & F.col("_in_s").isNotNull()
    if newer and newer in update_cols:
        matched = matched & (F.col(f"s.{newer}") >= F.col(f"t.{newer}"))
    matched = F.coalesce(matched, F.lit(False))
    insert = F.col("_in_t").isNull()
    has = set(source.columns)

    def value(c: str) -> Column:
        theirs = F.col(f"s.{c}") if c in has else F.lit(None).cast(target.schema[c].dataType)
        take = insert | matched if c in update_cols else insert
        return F.when(take, theirs).otherwise(F.col(f"t.{c}")).alias(c)

    action = F.when(insert, "insert").when(matched, "update").otherwise("keep").alias("action")
    return j.select(*[value(c) for c in target.columns], *([action] if with_action else []))


def merge_with_deletes(target: DataFrame, source: DataFrame, keys: Sequence[str], delete_col: str, with_action: bool = False) -> DataFrame:
    """``target`` after an upsert in which flagged source rows delete their match.

    Matched and flagged rows are deleted, other matched rows replaced, unmatched ones
    inserted, also if flagged.  The flag is not part of the result.
    """
    cols = target.columns
    s = _keyed(source, keys).withColumn("_in_s", F.lit(True)).alias("s")
    t = target.withColumn("_in_t", F.lit(True)).alias("t")
    j = t.join(s, _on(keys), "full_outer")
    both = F.col("_in_t").isNotNull() & F.col("_in_s").isNotNull()
    flag = F.coalesce(F.col(f"s.{delete_col}"), F.lit(False))
    action = F.when(both & flag, "delete").when(both, "update").when(F.col("_in_t").isNull(), "insert").otherwise("keep")
    x = j.select(*[F.when(F.col("_in_s").isNotNull(), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in cols], action.alias("action"))
    x = x.filter(F.col("action") != "delete")
    return x if with_action else x.drop("action")


def action_counts(target: DataFrame, source: DataFrame, keys: Sequence[str], delete_col: str | None = None) -> DataFrame:
    """One row ``inserted, updated, deleted``: what an upsert would do, counted on the keys alone."""
    flag = F.coalesce(F.col(delete_col), F.lit(False)) if delete_col else F.lit(False)
    s = _keyed(source, keys).select(*keys, flag.alias("_flag"), F.lit(True).alias("_in_s")).alias("s")
    t = target.select(*keys, F.lit(True).alias("_in_t")).alias("t")
    j = s.join(t, _on(keys), "left").select("_flag", F.col("_in_t").isNotNull().alias("_both"))
    both = F.col("_both")
    return j.agg(F.count_if(~both).alias("inserted"), F.count_if(both & ~F.col("_flag")).alias("updated"), F.count_if(both & F.col("_flag")).alias("deleted"))


def detect_changes(old: DataFrame, new: DataFrame, keys: Sequence[str], compare: Sequence[str], null_safe: bool = True) -> DataFrame:
    """``keys + compare + cdc_operation``: INSERT, UPDATE and DELETE rows between two snapshots, by one full outer join.

    Updates and inserts carry the new values, deletes the old ones.  Rows with a null key
    are left out.  Without columns to compare there are no updates.
    """
    o = _keyed(old, keys).select(*keys, *compare).withColumn("_in_t", F.lit(True)).alias("t")
    n = _keyed(new, keys).select(*keys, *compare).withColumn("_in_s", F.lit(True)).alias("s")
    differs = F.lit(False)
    for c in compare:
        a, b = F.col(f"t.{c}"), F.col(f"s.{c}")
        differs = differs | (~a.eqNullSafe(b) if null_safe else F.coalesce(a != b, F.lit(False)))
    op = F.when(F.col("_in_t").isNull(), "INSERT").when(F.col("_in_s").isNull(), "DELETE").when(differs, "UPDATE")
    side = lambda c: F.when(F.col("_in_s").isNotNull(), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c)
    j = o.join(n, _on(keys), "full_outer").select(*[side(c) for c in [*keys, *compare]], op.alias("cdc_operation"))
    return j.filter(F.col("cdc_operation").isNotNull())


def rewrite(df: DataFrame, where: Column, values: Mapping[str, Column]) -> DataFrame:
    """``df`` with the columns of ``values`` replaced in the rows that meet ``where``; a null condition is not met."""
    return df.withColumns({c: F.when(where, v.cast(df.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()})


def changes_by_kind(old: DataFrame, new: DataFrame, keys: Sequence[str], compare: Sequence[str]) -> dict[str, DataFrame]:
    c = detect_changes(old, new, keys, compare)
    return {name: c.filter(F.col("cdc_operation") == op) for name, op in (("inserts", "INSERT"), ("updates", "UPDATE"), ("deletes", "DELETE"))}


SCD_COLUMNS = ("scd_start_date", "scd_end_date", "is_current")


def scd2_first_load(new: DataFrame, now: Column) -> DataFrame:
    """Every row as a current version that starts ``now``."""
    return new.withColumns({"scd_start_date": now.cast("timestamp"), "scd_end_date": F.lit(None).cast("timestamp"), "is_current": F.lit(True)})


def apply_scd2(history: DataFrame, new: DataFrame, key: str, tracked: Sequence[str], now: Column) -> DataFrame:
    """``history`` after a snapshot ``new`` with one row per key.

    Current versions whose tracked columns differ (null-safe) are closed ``now`` and
    followed by the new version; new keys start a version; unchanged and absent keys stay.
    Only current versions are compared.
    """
    past = history.filter(~F.coalesce(F.col("is_current"), F.lit(False)))
    cols = [c for c in history.columns if c not in SCD_COLUMNS]
    t = history.filter(F.col("is_current")).withColumn("_in_t", F.lit(True)).alias("t")
    s = _keyed(new, [key]).select(*cols).withColumn("_in_s", F.lit(True)).alias("s")
    differs = F.lit(False)
    for c in tracked:
        differs = differs | ~F.col(f"t.{c}").eqNullSafe(F.col(f"s.{c}"))
    j = t.join(s, _on([key]), "full_outer")
    fresh = F.col("_in_t").isNull()
    changed = F.col("_in_t").isNotNull() & F.col("_in_s").isNotNull() & differs
    now = now.cast("timestamp")
    none, yes = F.lit(None).cast("timestamp"), F.lit(True)
    old_version = F.struct(*[F.col(f"t.{c}").alias(c) for c in cols], F.col("t.scd_start_date").alias("scd_start_date"), F.when(changed, now).otherwise(F.col("t.scd_end_date")).alias("scd_end_date"), (~changed).alias("is_current"))
    new_version = F.struct(*[F.col(f"s.{c}").alias(c) for c in cols], now.alias("scd_start_date"), none.alias("scd_end_date"), yes.alias("is_current"))
    rows = F.when(fresh, F.array(new_version)).when(changed, F.array(old_version, new_version)).otherwise(F.array(old_version))
    live = j.select(F.explode(rows).alias("v")).select(*[F.col(f"v.{c}").alias(c) for c in [*cols, *SCD_COLUMNS]])
    return past.select(*cols, *SCD_COLUMNS).unionByName(live)


def scd2_from_snapshots(states: DataFrame, key: str, snapshot: str, tracked: Sequence[str]) -> DataFrame:
    """The history that ``apply_scd2`` gives when all snapshots are applied in their order, in one pass.

    ``states`` has one row per (key, snapshot).  A version is its first row; it ends where
    the next one of the key starts, and the last is current, also of keys that are gone.
    """
    order = W.partitionBy(key).orderBy(snapshot)
    start = F.lag(F.lit(1)).over(order).isNull()
    for c in tracked:
        start = start | ~F.lag(c).over(order).eqNullSafe(F.col(c))
    v = _keyed(states, [key]).withColumn("_start", start).filter(F.col("_start")).drop("_start")
    end = F.lead(snapshot).over(order).cast("timestamp")
    v = v.withColumns({"scd_start_date": F.col(snapshot).cast("timestamp"), "scd_end_date": end})
    return v.withColumn("is_current", F.col("scd_end_date").isNull()).drop(snapshot)
