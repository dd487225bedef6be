"""Helpers shared by the operators: table access, size checks, range keys and hot keys."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table read from files, over all cores if its files make less than a full split for each.

    A task cannot read less than a row group, so that small tables would be worked on by one
    or two cores.  Larger ones have splits enough and are left as they are: nothing is shuffled.
    """
    spark = df.sparkSession
    cores, split = spark.sparkContext.defaultParallelism, _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # of the files, as listed for the scan
    return df.repartition(cores) if size < cores * split else df


def _bytes(text: str) -> int:
    units = {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40}
    number, unit = re.fullmatch(r"(\d+)\s*([bkmgt]?)b?", text.strip().lower()).groups()
    return int(number) << units[unit]


def blank_to_null(c: Column) -> Column:
    """Text without surrounding white space; empty becomes null."""
    t = F.regexp_replace(c, r"^[\s ]+|[\s ]+$", "")
    return F.when(t != "", t)


def range_key(c: Column, bounds: Sequence[int | float]) -> Column:
    """Index of the range of ``c`` among ascending upper bounds: a balanced decision tree.

    ``log2(len(bounds))`` comparisons a row, inside generated code.  Range i holds
    values in (bounds[i-1], bounds[i]]; the last has no upper bound.  Null stays null.
    """

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(c <= F.lit(bounds[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return F.when(c.isNotNull(), tree(0, len(bounds)))


def sketch(col: str, parts: int) -> Column:
    """The inner quantiles of a column at ``parts`` equal steps, by a mergeable sketch: a few KB of each task."""
    return F.expr(f"percentile_approx(`{col}`, array({', '.join(f'{i / parts}D' for i in range(1, parts))}), {parts * 50})")


def slices_for(rows: int, target: int) -> int:
    return max(1, math.ceil(rows / target))
