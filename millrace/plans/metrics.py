"""Engagement, popularity, segments, cohorts and time series over the fact table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators.ranking import global_ntiles, top_overall, top_per_group
from millrace.plans.star import LOW
from millrace.session import written


def _avg(c: str = "rating") -> Column:
    return F.round(F.avg(c), 3)


def _pct(part: Column, whole: Column) -> Column:
    return F.round(F.try_divide(part, whole) * 100, 1)


_SUMS = ("n", "total", "high", "low", "judged")


def per_user(fact: DataFrame, **grain: Column) -> DataFrame:
    """What each user did in each period: the sums all indicators are made of.

    A user then counts once per period, so that nothing further is distinct; sums of finer
    periods add up to those of coarser ones.
    """
    x = fact.select("user_id", "rating", "is_high_rating", *[c.alias(k) for k, c in grain.items()])
    return x.groupBy(*grain, "user_id").agg(
        F.count("rating").alias("n"), F.sum(F.col("rating").cast("double")).alias("total"), F.count_if("is_high_rating").alias("high"),
        F.count_if(F.col("rating") < LOW).alias("low"), F.count("is_high_rating").alias("judged"),
    )


def _coarser(sums: DataFrame, *grain: str) -> DataFrame:
    return sums.groupBy(*grain).agg(*[F.sum(c).alias(c) for c in _SUMS])


def _indicators(sums: DataFrame, *grain: str) -> DataFrame:
    """``total_ratings, active_users, avg_rating, high_rating_pct`` per period, of sums per user."""
    x = sums.groupBy(*grain).agg(F.count("user_id").alias("active_users"), *[F.sum(c).alias(c) for c in _SUMS])
    return x.select(*grain, F.col("n").alias("total_ratings"), "active_users", F.round(F.try_divide("total", "n"), 3).alias("avg_rating"), _pct(F.col("high"), F.col("judged")).alias("high_rating_pct"))


def daily_engagement(fact: DataFrame) -> DataFrame:
    """Users, ratings and shares per day; a day of null ratings only has no share."""
    x = per_user(fact, rating_date=F.col("rating_date")).groupBy("rating_date").agg(F.count("user_id").alias("active_users"), *[F.sum(c).alias(c) for c in _SUMS])
    high = F.when(F.col("judged") > 0, F.col("high"))
    return x.select(
        "rating_date", "active_users", F.col("n").alias("total_ratings"), F.round(F.try_divide("total", "n"), 3).alias("avg_rating"), high.alias("high_ratings"),
        F.col("low").alias("low_ratings"), _pct(high, F.col("n")).alias("high_rating_pct"),
    )


def _popularity_order() -> list[Column]:
    return [F.col("total_ratings").desc(), F.col("avg_rating").desc_nulls_last(), F.col("movie_id").asc()]


def _titles(movies: DataFrame) -> DataFrame:
    return movies.select("movie_id", "title")


def top_movies_overall(fact: DataFrame, movies: DataFrame, top_n: int = 100) -> DataFrame:
    """The most rated movies: counted per movie first, titles joined to the n that remain."""
    c = fact.groupBy("movie_id").agg(F.count("rating").alias("total_ratings"), _avg().alias("avg_rating"), F.countDistinct("user_id").alias("unique_raters"))
    top = top_overall(c, _popularity_order(), top_n, "rank")
    return top.join(_titles(movies), "movie_id", "left").select("movie_id", "title", "total_ratings", "avg_rating", "unique_raters", "rank")


def top_movies_by_genre(fact: DataFrame, movies: DataFrame, genres: DataFrame, top_n: int = 100) -> DataFrame:
    """Per genre the most rated movies.  Counts are made per movie before they fan out to genres."""
    c = fact.groupBy("movie_id").agg(F.count("rating").alias("total_ratings"), _avg().alias("avg_rating"))
    g = c.join(genres.filter(F.col("genre").isNotNull()), "movie_id")
    top = top_per_group(g, ["genre"], _popularity_order(), top_n, "rank_in_genre")
    return top.join(_titles(movies), "movie_id", "left").select("genre", "movie_id", "title", "total_ratings", "avg_rating", "rank_in_genre")


def top_movies_by_month(fact: DataFrame, movies: DataFrame, top_n: int = 100) -> DataFrame:
    c = fact.groupBy("rating_year", "rating_month", "movie_id").agg(F.count("rating").alias("total_ratings"), _avg().alias("avg_rating"))
    top = top_per_group(c, ["rating_year", "rating_month"], _popularity_order(), top_n, "rank_in_month")
    return top.join(_titles(movies), "movie_id", "left").select("rating_year", "rating_month", "movie_id", "title", "total_ratings", "avg_rating", "rank_in_month")


# Segments by recency and frequency scores, the first that fits.
def segment(r: Column, f: Column) -> Column:
    return (
        F.when((r >= 4) & (f >= 4), "Champions")
        .when(f >= 4, "Loyal Customers")
        .when((r <= 2) & (f >= 3), "At Risk")
        .when((r == 1) & (f == 1), "Lost")
        .otherwise("Potential Loyalists")
    )


def rfm_segmentation(fact: DataFrame, recency_best_high: bool = False) -> DataFrame:
    """Recency, frequency and value of each user in fifths, and the segment they make.

    By default the most recent users have ``r_score`` 1; with ``recency_best_high`` they
    have 5.  Users are counted once, into a table; the last date of the data is the latest of
    theirs, a scalar subquery over it.
    """
    u = written(fact.groupBy("user_id").agg(F.max("rating_date").alias("_latest"), F.count("rating").alias("frequency"), _avg().alias("monetary")), "users")
    last = u.agg(F.max("_latest")).scalar()
    u = u.select("user_id", F.datediff(last, "_latest").alias("recency_days"), "frequency", "monetary")
    key = "recency_days"
    if recency_best_high:
        u, key = u.withColumn("_recent", -F.col("recency_days")), "_recent"
    u = global_ntiles(u, {"r_score": key, "f_score": "frequency", "m_score": "monetary"}, "user_id", 5).drop("_recent")
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    return u.select("*", (r + f + m).alias("rfm_score"), segment(r, f).alias("segment"))


#: Stand in the list of a user's months for the user itself, and for ratings without a date.
_SELF, _UNDATED = -1, -2


def _month(c: Column) -> Column:
    return F.year(c) * 12 + F.month(c) - 1


def retention_cohorts(fact: DataFrame, users: DataFrame) -> DataFrame:
    """Share of the users who signed up in a month that were active in each month after.

    A user is one row with the list of its months, and itself; counting these per cohort
    gives the sizes and the active users at once.  Users without a sign-up date make a cohort
    without a size.
    """
    months = fact.groupBy("user_id").agg(F.collect_set(F.coalesce(_month(F.col("rating_date")), F.lit(_UNDATED))).alias("months"))
    since = users.filter(F.col("user_id").isNotNull()).select(F.col("user_id").alias("_user"), _month(F.col("signup_date").cast("date")).alias("cohort")).distinct()
    x = since.join(months, F.col("_user") == F.col("user_id"), "left")
    counts = x.select("cohort", F.explode(F.concat(F.array(F.lit(_SELF)), F.coalesce("months", F.array().cast("array<int>")))).alias("m")).groupBy("cohort", "m").agg(F.count(F.lit(1)).alias("users"))
    size = F.max(F.when((F.col("m") == _SELF) & F.col("cohort").isNotNull(), F.col("users"))).over(W.partitionBy("cohort"))  # over months, not users
    x = counts.withColumns({"cohort_size": size, "at": F.when(F.col("m") != _UNDATED, F.col("m"))}).filter(F.col("m") != _SELF)
    label = F.format_string("%04d-%02d", F.floor(F.col("cohort") / 12), F.col("cohort") % 12 + 1)
    return x.select(
        F.when(F.col("cohort").isNotNull(), label).alias("cohort_month"), "cohort_size", (F.col("at") - F.col("cohort")).alias("months_since_signup"),
        F.col("users").alias("active_users"), _pct(F.col("users"), F.col("cohort_size")).alias("retention_rate"),
    )


def _newcomers(fact: DataFrame, period: str, c: Callable[[Column], Column]) -> DataFrame:
    """How many users rated for the first time in each period."""
    first = fact.groupBy("user_id").agg(F.min("rating_date").alias("_first")).filter(F.col("_first").isNotNull())
    return first.groupBy(c(F.col("_first")).alias("_p")).agg(F.count(F.lit(1)).alias("new_raters")).withColumnRenamed("_p", period)


def _with_newcomers(x: DataFrame, fact: DataFrame, period: str, c: Callable[[Column], Column] = lambda d: d) -> DataFrame:
    return x.join(_newcomers(fact, period, c), period, "left").withColumn("new_raters", F.coalesce("new_raters", F.lit(0)))


def daily_kpis(fact: DataFrame) -> DataFrame:
    return _with_newcomers(_indicators(per_user(fact, rating_date=F.col("rating_date")), "rating_date"), fact, "rating_date")


def weekly_kpis(fact: DataFrame, iso_year: bool = False) -> DataFrame:
    """Per week.  By default under the calendar year, so that a week across New Year is two rows."""
    d = F.col("rating_date")
    grain = {"year": F.expr("extract(YEAROFWEEK FROM rating_date)") if iso_year else F.year(d), "week": F.weekofyear(d), "week_start": F.date_trunc("week", d).cast("date")}
    return _indicators(per_user(fact, **grain), *grain)


def monthly_kpis(fact: DataFrame) -> DataFrame:
    label = lambda d: F.date_format(d, "yyyy-MM")
    x = _indicators(per_user(fact, month_label=label(F.col("rating_date"))), "month_label")
    x = x.withColumns({"year": F.substring("month_label", 1, 4).cast("int"), "month": F.substring("month_label", 6, 2).cast("int")})
    return _with_newcomers(x, fact, "month_label", label)


def kpis_all_grains(fact: DataFrame) -> DataFrame:
    """Days, months and years of one scan: ``grain, period`` and the indicators.

    Users are summed per day; only these sums are then spread to the coarser grains.
    """
    daily = per_user(fact, d=F.date_format("rating_date", "yyyy-MM-dd"))
    grains = [F.struct(F.lit(g).alias("grain"), F.substring("d", 1, n).alias("period")) for g, n in (("year", 4), ("month", 7), ("day", 10))]
    spread = daily.select("user_id", *_SUMS, F.explode(F.array(*grains)).alias("g")).select("user_id", *_SUMS, "g.*")
    return _indicators(_coarser(spread, "grain", "period", "user_id"), "grain", "period")


# The order in which results are shown.
PRESENTATION = {
    "dim_dates": ["date"], "daily_engagement": ["rating_date"], "top_movies_overall": ["rank"], "top_movies_by_genre": ["genre", "rank_in_genre"],
    "top_movies_by_month": ["rating_year", "rating_month", "rank_in_month"], "rfm_segmentation": ["-rfm_score", "user_id"], "retention_cohorts": ["cohort_month", "months_since_signup"],
    "daily_kpis": ["rating_date"], "weekly_kpis": ["year", "week"], "monthly_kpis": ["year", "month"],
}


def presented(name: str, result: DataFrame) -> DataFrame:
    """A result in the order in which it is shown; results without one stay as they are."""
    order = [F.col(c[1:]).desc() if c.startswith("-") else F.col(c).asc() for c in PRESENTATION.get(name, [])]
    return result.orderBy(*order) if order else result
