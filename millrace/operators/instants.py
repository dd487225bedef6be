"""Problem 6: timestamps in mixed formats and zones, brought to one UTC value.

Method: a mixture of formats per source, fitted by expectation-maximisation.  Each text
has a set of readings under which it is a real date; it contributes likelihood to each of
them.  The posterior picks the reading; a text whose best reading stays under
``min_posterior`` is left unresolved and marked so, never guessed.

``fit`` needs only counts of (source, set of readings), so what it iterates over is one
small row per source and kind of text whatever the number of rows; the iteration runs per
source in ``applyInPandas``.  ``transform`` is a chain of Catalyst expressions.  What is
fitted, a row per source and kind of text, is written to the shared folder, where the
planner sees its size.  ``with_instants`` also writes the readings, so that texts are parsed
once for both steps.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import timeparse as tp
from millrace.functions.timeparse import READINGS
from millrace.session import written

IMPLAUSIBLE_LIKELIHOOD = 1e-6
_ORDERS = {"MDY": 1, "DMY": 2, "YMD": 4}
_WORK = [f"_mr_{c}" for c in ("t", "sig", "choice", "posterior", "wall", "at")]


def with_readings(df: DataFrame, text_col: str, order_col: str | None = None) -> DataFrame:
    """Add ``_mr_t``, the text's readings, and ``_mr_sig``, the set of those that count.

    Where ``order_col`` names the order of the source, readings of slashes in another
    order are none at all.
    """
    x = df.withColumn("_mr_t", tp.parse_text(F.col(text_col)))
    sig = F.col("_mr_t.sig")
    if order_col is None:
        return x.withColumn("_mr_sig", sig)
    k, keep = len(READINGS), F.lit(-1)
    for order, bit in _ORDERS.items():
        drop = 7 - bit
        keep = F.when(F.col(order_col) == order, F.lit(~(drop | drop << k))).otherwise(keep)
    return x.withColumn("_mr_sig", sig.bitwiseAND(keep))


def _em(counts: dict[int, int], prior: float, rounds: int, tol: float) -> dict[int, tuple[str, float]]:
    """Weights of one source's formats from counts of reading sets: the posterior of each set's best reading."""
    k = len(READINGS)
    sigs = sorted(counts)
    like = np.zeros((len(sigs), k))
    for r, s in enumerate(sigs):
        for i in range(k):
            if s >> i & 1:
                like[r, i] = IMPLAUSIBLE_LIKELIHOOD if s >> (k + i) & 1 else 1.0
    n = np.array([counts[s] for s in sigs], float)
    w = np.full(k, 1 / k)
    for _ in range(rounds):
        joint = like * w
        post = joint / np.maximum(joint.sum(1, keepdims=True), 1e-300)
        new = (n[:, None] * post).sum(0) + prior
        new /= new.sum()
        if np.abs(new - w).max() < tol:
            w = new
            break
        w = new
    joint = like * w
    post = joint / np.maximum(joint.sum(1, keepdims=True), 1e-300)
    return {s: (READINGS[int(p.argmax())], float(p.max())) for s, p in zip(sigs, post, strict=True)}


@dataclass
class TimestampModel:
    """Readings chosen per (source, set of readings)."""

    choices: DataFrame
    source_col: str
    text_col: str
    zone_col: str | None
    order_col: str | None
    min_posterior: float

    def transform(self, df: DataFrame, date_only: bool = False) -> DataFrame:
        """``df`` with ``utc_us bigint`` and ``reading string``.

        ``utc_us`` is null where the text is null, blank, no real date or time, or
        unresolved; ``reading`` tells: the reading used, ``ambiguous`` if no reading
        reached ``min_posterior``, else null.  With ``date_only`` the value is 00:00 UTC of
        the date: as written if the text has no time of day, else of the instant's UTC date.
        Columns of ``df`` are kept, except that any named ``utc_us`` or ``reading`` give way.
        Names that start with ``_mr_`` are the operator's own.
        """
        df = df.drop(*[c for c in df.columns if c.lower() in ("utc_us", "reading") and c not in (self.text_col, self.source_col, self.zone_col, self.order_col)])
        return self.resolve(with_readings(df, self.text_col, self.order_col), date_only)

    def resolve(self, x: DataFrame, date_only: bool = False) -> DataFrame:
        """``transform`` of rows that have their readings (``with_readings``)."""
        src = F.coalesce(F.col(self.source_col).cast("string"), F.lit("\x00none"))
        c = self.choices
        cond = (src == c["_mr_src"]) & (x["_mr_sig"] == c["_mr_csig"])
        x = x.join(c, cond, "left").drop("_mr_src", "_mr_csig")
        sure = F.col("_mr_posterior") >= self.min_posterior
        reading = F.when(F.col("_mr_sig") == 0, F.lit(None).cast("string")).when(sure, F.col("_mr_choice")).otherwise(F.lit("ambiguous"))
        zone = F.col(self.zone_col) if self.zone_col else F.lit("UTC")
        return _with_utc(x.withColumn("reading", reading), zone, date_only).drop(*_WORK)


def _known(spark: SparkSession, region: str) -> Column:
    """Whether a text in brackets names a region that the JVM knows.  One expression of text: hundreds of literals are slow to build."""
    jvm = spark.sparkContext._jvm
    ids = jvm.java.lang.String.join("', '", jvm.java.time.ZoneId.getAvailableZoneIds())
    return F.expr(f"{region} IN ('{ids}')")


def _with_utc(x: DataFrame, zone: Column, date_only: bool) -> DataFrame:
    t, reading = F.col("_mr_t"), F.col("reading")
    wall = F.lit(None).cast("bigint")
    for name in READINGS:
        wall = F.when(reading == name, t[name.lower()]).otherwise(wall)
    x = x.withColumn("_mr_wall", wall)
    wall, region = F.col("_mr_wall"), t["region"]
    known = _known(x.sparkSession, "_mr_t.region")
    at = (
        F.when(reading == "epoch", wall)
        .when(t["off"].isNotNull(), wall - t["off"].cast("bigint") * 60_000_000)
        .when(region.isNotNull(), F.when(known, tp.clock_to_utc(wall, F.when(known, region))))
        .otherwise(tp.clock_to_utc(wall, zone))
    )
    if not date_only:
        return x.withColumn("utc_us", at)
    x = x.withColumn("_mr_at", F.when(t["dated"] & (reading != "epoch"), wall).otherwise(at))
    return x.withColumn("utc_us", F.floor(F.col("_mr_at") / tp.DAY_US).cast("bigint") * tp.DAY_US)


def fit(
    df: DataFrame, text_col: str, source_col: str, zone_col: str | None = None, order_col: str | None = None,
    min_posterior: float = 0.9, prior: float = 0.01, rounds: int = 200, tol: float = 1e-9,
) -> TimestampModel:
    """Fit the format mixture of every source over all rows of ``df``.

    Sources whose ``order_col`` is given have their order of slashes fixed by it; for the
    others the fit decides.  A null source is a source of its own.  An empty ``df`` gives a
    model under which every text is ambiguous or unreadable.
    """
    x = with_readings(df.filter(F.col(text_col).isNotNull()), text_col, order_col)
    return fit_readings(x, text_col, source_col, zone_col, order_col, min_posterior, prior, rounds, tol)


def fit_readings(
    x: DataFrame, text_col: str, source_col: str, zone_col: str | None = None, order_col: str | None = None,
    min_posterior: float = 0.9, prior: float = 0.01, rounds: int = 200, tol: float = 1e-9,
) -> TimestampModel:
    """``fit`` over rows that have their readings (``with_readings``)."""
    src = F.coalesce(F.col(source_col).cast("string"), F.lit("\x00none"))
    counts = x.filter(F.col("_mr_sig") != 0).select(src.alias("_mr_src"), "_mr_sig").groupBy("_mr_src", "_mr_sig").count()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        got = _em({int(s): int(n) for s, n in zip(pdf["_mr_sig"], pdf["count"], strict=True)}, prior, rounds, tol)
        return pd.DataFrame([(pdf["_mr_src"].iloc[0], s, c, p) for s, (c, p) in got.items()], columns=["_mr_src", "_mr_csig", "_mr_choice", "_mr_posterior"])

    fitted = counts.groupBy("_mr_src").applyInPandas(one, "_mr_src string, _mr_csig int, _mr_choice string, _mr_posterior double")
    return TimestampModel(written(fitted, "formats"), source_col, text_col, zone_col, order_col, min_posterior)


def with_instants(df: DataFrame, feeds: DataFrame, text_col: str, date_only: bool = False, keep: list[str] | None = None, **options) -> DataFrame:
    """``df`` with ``utc_us`` and ``reading`` of ``text_col``, under the zone and order of each row's feed.

    Rows whose feed is unknown are read as UTC, and their order of slashes is fitted.
    """
    cols = [c for c in (keep if keep is not None else df.columns) if c.lower() not in ("utc_us", "reading")]
    f = feeds.select(F.col("feed_id").alias("_mr_feed"), F.col("time_zone").alias("_mr_zone"), F.col("date_order").alias("_mr_order"))
    base = df.select(*cols, F.col("feed_id").alias("_mr_source"), F.col(text_col).alias("_mr_text"))
    x = base.join(f, base["_mr_source"] == f["_mr_feed"], "left").withColumn("_mr_zone", F.coalesce("_mr_zone", F.lit("UTC")))
    x = written(with_readings(x, "_mr_text", "_mr_order").drop("_mr_text", "_mr_feed", "_mr_order"), "readings")
    model = fit_readings(x, "_mr_text", "_mr_source", "_mr_zone", **options)
    return model.resolve(x, date_only).select(*cols, "utc_us", "reading")
