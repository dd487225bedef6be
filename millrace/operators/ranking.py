"""Ranks over all rows without a single-task window, and the latest row per key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.session import written
from millrace.util import range_key, sketch, slices_for


def deduplicate(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Of each key the row that comes first in ``order``.  Null keys are a key like others.

    ``order`` must end in a unique column, or which of equal rows stays is undefined.  The
    planner keeps one row per key of each task before the shuffle (WindowGroupLimit), so that
    a key with a large part of all rows does not gather them.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def top_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], n: int, rank: str) -> DataFrame:
    """The first ``n`` rows of each group with their rank; the limit reaches below the shuffle."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*groups).orderBy(*order))).filter(F.col(rank) <= n)


def top_overall(df: DataFrame, order: Sequence[Column], n: int, rank: str) -> DataFrame:
    """The first ``n`` rows of all with their rank: each task keeps n, only those are ranked."""
    return df.orderBy(*order).limit(n).withColumn(rank, F.row_number().over(W.orderBy(*order)))


#: Ranges that the order of a key is cut into at most, and the rows that one is meant to hold.
RANGES = 256
ROWS_PER_RANGE = 500_000


def _stats(df: DataFrame, keys: Sequence[str], tie: str, rows_per_range: int) -> tuple[int, dict[str, list]]:
    """Row count and the inner quantiles of each key and of ``tie``, in one aggregate of mergeable sketches."""
    aggs = [sketch(c, RANGES).alias(f"q{i}") for i, c in enumerate([*keys, tie])]
    r = df.agg(F.count(F.lit(1)).alias("n"), *aggs).first()
    parts = min(RANGES, slices_for(r["n"], rows_per_range))
    pick = lambda q: [q[j * RANGES // parts - 1] for j in range(1, parts)] if q else []
    return r["n"], {c: pick(r[f"q{i}"]) for i, c in enumerate([*keys, tie])}


def global_row_numbers(df: DataFrame, keys: Mapping[str, str], tie: str, rows_per_range: int = ROWS_PER_RANGE) -> tuple[int, DataFrame]:
    """The number of rows, and ``df`` with the 1-based place of each row in the order of (key, tie) for each ``name: key``.

    Keys and tie are numeric; nulls come first.  Rows are cut into ranges of the key by a
    quantile sketch; a value that fills several ranges by itself is cut on by ``tie``.  Rows
    are numbered within ranges, each in its own task, and shifted by the size of the
    ranges before: at most RANGES squared numbers, a table that is joined on the range by
    which the rows are laid out already.
    """
    base = x = written(df, "ranked")
    n, quantiles = _stats(base, sorted(set(keys.values())), tie, rows_per_range)
    ts = sorted(set(quantiles[tie]))
    for name, key in keys.items():
        ks = quantiles[key]
        heavy = sorted({v for v in ks if ks.count(v) > 1})
        fine = F.when(F.col(key).isin(heavy), F.coalesce(range_key(F.col(tie), ts), F.lit(0)) + 1).otherwise(0) if heavy else F.lit(0)
        rng = F.coalesce(range_key(F.col(key), sorted(set(ks))), F.lit(-1)) * (len(ts) + 2) + fine
        # sizes come from the written rows, not from the numbering of the key before
        sizes = base.groupBy(rng.alias("_r")).agg(F.count(F.lit(1)).alias("_n"))
        before = sizes.select("_r", F.coalesce(F.sum("_n").over(W.orderBy("_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
        place = F.row_number().over(W.partitionBy("_r").orderBy(F.col(key).asc_nulls_first(), F.col(tie).asc_nulls_first()))
        x = x.withColumn("_r", rng).withColumn("_i", place).join(before, "_r").withColumn(name, F.col("_i") + F.col("_before")).drop("_r", "_i", "_before")
    return n, x


def global_ntiles(df: DataFrame, keys: Mapping[str, str], tie: str, k: int, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``ntile(k)`` over all rows in the order of (key, tie) for each ``name: key``: the first ``rows mod k`` tiles are one longer."""
    n, x = global_row_numbers(df, {f"_place_{name}": key for name, key in keys.items()}, tie, rows_per_range)
    small, extra = divmod(n, k)
    head = extra * (small + 1)
    for name in keys:
        p = F.col(f"_place_{name}")
        tile = F.when(p <= head, F.ceil(p / (small + 1))).otherwise(F.lit(extra) + F.ceil((p - head) / max(small, 1)))
        x = x.withColumn(name, tile.cast("int")).drop(f"_place_{name}")
    return x


def global_ntile(df: DataFrame, key: str, tie: str, k: int, name: str, **options) -> DataFrame:
    return global_ntiles(df, {name: key}, tie, k, **options)
