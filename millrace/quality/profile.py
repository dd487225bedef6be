"""Column profiles: one wide aggregate, and the top values of all columns by one unpivot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def column_profile(df: DataFrame) -> DataFrame:
    """A row per column: ``column, nulls, null_pct, distinct_values, min, max, mean, stddev``.

    A null is one of the distinct values.  Mean and sample deviation of numeric columns
    only, else null.  Distinct values are counted per column over an unpivoted pass.
    """
    aggs, rows = [F.count(F.lit(1)).alias("_n")], []
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        num = isinstance(f.dataType, T.NumericType)
        aggs += [F.count_if(c.isNull()).alias(f"nulls{i}"), F.min(c).cast("string").alias(f"min{i}"), F.max(c).cast("string").alias(f"max{i}")]
        none = F.lit(None).cast("double")
        aggs += [(F.round(F.avg(c), 3) if num else none).alias(f"mean{i}"), (F.round(F.stddev_samp(c), 3) if num else none).alias(f"std{i}")]
        pct = F.round(F.try_divide(F.col(f"nulls{i}"), F.col("_n")) * 100, 1)
        rows.append(F.struct(F.lit(f.name).alias("column"), F.col(f"nulls{i}").alias("nulls"), pct.alias("null_pct"), F.col(f"min{i}").alias("min"), F.col(f"max{i}").alias("max"), F.col(f"mean{i}").alias("mean"), F.col(f"std{i}").alias("stddev")))
    one = df.agg(*aggs).select(F.explode(F.array(*rows)).alias("p")).select("p.*")
    d = _values(df).distinct().groupBy("column").agg(F.count(F.lit(1)).alias("distinct_values"))
    return one.join(d, "column", "left").select("column", "nulls", "null_pct", F.coalesce("distinct_values", F.lit(0)).alias("distinct_values"), "min", "max", "mean", "stddev")


def _values(df: DataFrame) -> DataFrame:
    pairs = [F.struct(F.lit(f.name).alias("column"), F.col(f"`{f.name}`").cast("string").alias("value")) for f in df.schema.fields]
    return df.select(F.explode(F.array(*pairs)).alias("p")).select("p.column", "p.value")


def top_values(df: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` most frequent values of each column: ``column, rank, value, n``."""
    c = _values(df).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("column").orderBy(F.col("n").desc(), F.col("value").asc_nulls_first())
    return c.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select("column", "rank", "value", "n")
