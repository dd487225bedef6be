"""The catalogue of registered queries over rating activity, each with its SQL.

Dates and times come out as text, so that results compare alike in every engine.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import flow, incremental
from millrace.functions.standard import COUNTRY_CODES, country_code, parsed_date
from millrace.operators import ranking, upsert
from millrace.plans import metrics, star
from millrace.quality import profile, reports, rules
from millrace.session import scratch
from millrace.sources import files, store
from millrace.streaming import windows
from millrace.util import spread, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}



def plain(df: DataFrame) -> DataFrame:
    """Columns in types that every engine has: whole numbers as bigint, floats as double, dates and times as text."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.FloatType):
            c = c.cast("double")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf: plain(f(spark, sf))
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# --- inputs


def ratings(spark: SparkSession, sf: str) -> DataFrame:
    return star.clean_ratings(spread(table(spark, sf, "ratings")))


def movies(spark: SparkSession, sf: str) -> DataFrame:
    return star.clean_movies(table(spark, sf, "movies"))


def users(spark: SparkSession, sf: str) -> DataFrame:
    return star.current_users(table(spark, sf, "users"))


def enriched(spark: SparkSession, sf: str) -> DataFrame:
    return star.enriched_ratings(ratings(spark, sf), movies(spark, sf), users(spark, sf))


def fact(spark: SparkSession, sf: str) -> DataFrame:
    """The fact table as far as metrics read it: from ratings alone."""
    return star.keyed_facts(ratings(spark, sf))


def genres(spark: SparkSession, sf: str) -> DataFrame:
    return star.movie_genres(movies(spark, sf))


def _date_sql(c: str) -> str:
    return f"""CASE WHEN regexp_full_match({c}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}') THEN try_strptime({c}, '%Y-%m-%d %H:%M:%S')
 WHEN regexp_full_match({c}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN try_strptime({c}, '%Y-%m-%d')
 WHEN regexp_full_match({c}, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}') THEN try_strptime({c}, '%m/%d/%Y') END"""


def _country_sql(c: str) -> str:
    return f"CASE upper({c}) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in COUNTRY_CODES.items())} ELSE upper({c}) END"


_RATINGS = f"""sr0 AS (SELECT row_id, CAST(user_id AS BIGINT) AS user_id, CAST(movie_id AS BIGINT) AS movie_id, CAST(rating AS DOUBLE) AS rating, {_date_sql("rated_at")} AS rated_at,
 ingestion_timestamp FROM ratings WHERE user_id IS NOT NULL AND movie_id IS NOT NULL),
sr AS (SELECT * FROM sr0 QUALIFY row_number() OVER (PARTITION BY user_id, movie_id ORDER BY rated_at DESC NULLS LAST, row_id DESC) = 1)"""
_MOVIES = f"""sm AS (SELECT row_id, CAST(movie_id AS BIGINT) AS movie_id, title, genres, CAST(year AS BIGINT) AS year, language, {_country_sql("country")} AS country, ingestion_timestamp, deleted_at
 FROM movies WHERE movie_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY movie_id ORDER BY ingestion_timestamp DESC NULLS LAST, row_id DESC) = 1)"""
_USERS = f"""su AS (SELECT CAST(user_id AS BIGINT) AS user_id, {_country_sql("country")} AS country, plan, CAST({_date_sql("signup_date")} AS DATE) AS signup_date
 FROM users WHERE user_id IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY snapshot_date DESC NULLS LAST, ingestion_timestamp DESC NULLS LAST, row_id DESC) = 1)"""
_ENRICHED = f"""{_RATINGS}, {_MOVIES}, {_USERS},
en AS (SELECT r.row_id, r.user_id, r.movie_id, r.rating, r.rated_at, title, genres, m.year, m.country AS movie_country, plan, u.country AS user_country, signup_date,
 CAST(year(rated_at) AS BIGINT) AS rating_year, CAST(month(rated_at) AS BIGINT) AS rating_month, CAST(day(rated_at) AS BIGINT) AS rating_day, rating >= 4.0 AS is_high_rating,
 CAST(datediff('day', signup_date, CAST(rated_at AS DATE)) AS BIGINT) AS days_since_signup
 FROM sr r LEFT JOIN sm m ON r.movie_id = m.movie_id LEFT JOIN su u ON r.user_id = u.user_id)"""
_FACT = f"""{_ENRICHED}, ft AS (SELECT user_id, movie_id, CAST(rated_at AS DATE) AS rating_date, rating, rating_year, rating_month, is_high_rating, days_since_signup, plan, user_country FROM en)"""
_D = "strftime({0}, '%Y-%m-%d') AS {0}"
_DT = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"
_GENRES = "sg AS (SELECT DISTINCT movie_id, genre FROM (SELECT movie_id, unnest(string_split(genres, '|')) AS genre FROM sm) WHERE genre IS NOT NULL AND genre <> '')"
_KPI = "count(rating) AS total_ratings, count(DISTINCT user_id) AS active_users, round(avg(rating), 3) AS avg_rating, round(avg(CAST(is_high_rating AS INT)) * 100, 1) AS high_rating_pct"

# --- star


@query(f"WITH {_RATINGS} SELECT row_id, user_id, movie_id, rating, {_DT.format('rated_at')} FROM sr")
def dedupe_latest(spark, sf):
    return ratings(spark, sf).select("row_id", "user_id", "movie_id", "rating", "rated_at")


@query(f"""WITH {_ENRICHED} SELECT row_id, user_id, movie_id, rating, {_DT.format('rated_at')}, title, genres, year, movie_country, plan, user_country, {_D.format('signup_date')},
rating_year, rating_month, rating_day, is_high_rating, days_since_signup FROM en""")
def enriched_ratings(spark, sf):
    return enriched(spark, sf).select(
        "row_id", "user_id", "movie_id", "rating", "rated_at", "title", "genres", "year", "movie_country", "plan", "user_country", "signup_date",
        "rating_year", "rating_month", "rating_day", "is_high_rating", "days_since_signup",
    )


@query(f"WITH {_MOVIES}, {_GENRES} SELECT movie_id, genre FROM sg")
def movie_genres(spark, sf):
    return genres(spark, sf)


@query(f"""WITH {_FACT} SELECT strftime(rating_date, '%Y-%m-%d') AS date, CAST(year(rating_date) AS BIGINT) AS year, CAST(quarter(rating_date) AS BIGINT) AS quarter,
CAST(month(rating_date) AS BIGINT) AS month, strftime(rating_date, '%B') AS month_name, CAST(week(rating_date) AS BIGINT) AS week, CAST(day(rating_date) AS BIGINT) AS day,
CAST(dayofweek(rating_date) + 1 AS BIGINT) AS day_of_week, strftime(rating_date, '%A') AS day_name, dayofweek(rating_date) IN (0, 6) AS is_weekend,
CAST(strftime(rating_date, '%Y%m%d') AS BIGINT) AS date_key FROM (SELECT DISTINCT rating_date FROM ft WHERE rating_date IS NOT NULL)""")
def dim_dates(spark, sf):
    return star.dim_dates(fact(spark, sf), "rating_date")


@query(f"""WITH {_USERS} SELECT DISTINCT user_id, country AS user_country, plan, {_D.format('signup_date')}, strftime(signup_date, '%Y-%m-%d') AS signup_date_key FROM su""")
def dim_users(spark, sf):
    return star.dim_users(users(spark, sf))


@query(f"WITH {_MOVIES} SELECT DISTINCT movie_id, title, genres, year, language, country AS movie_country FROM sm")
def dim_movies(spark, sf):
    return star.dim_movies(movies(spark, sf))


@query(f"WITH {_FACT} SELECT user_id, movie_id, {_D.format('rating_date')}, rating, rating_year, rating_month, is_high_rating, days_since_signup, plan, user_country FROM ft")
def fact_ratings(spark, sf):
    return star.fact_ratings(ratings(spark, sf), users(spark, sf))


# --- metrics


@query(f"""WITH {_FACT} SELECT {_D.format('rating_date')}, count(DISTINCT user_id) AS active_users, count(rating) AS total_ratings, round(avg(rating), 3) AS avg_rating,
CAST(sum(CAST(is_high_rating AS INT)) AS BIGINT) AS high_ratings, count(CASE WHEN rating < 3.0 THEN 1 END) AS low_ratings,
round(CAST(sum(CAST(is_high_rating AS INT)) AS DOUBLE) / nullif(count(rating), 0) * 100, 1) AS high_rating_pct FROM ft GROUP BY ft.rating_date""")
def daily_engagement(spark, sf):
    return metrics.daily_engagement(fact(spark, sf))


@query(f"""WITH {_FACT}, fd AS (SELECT user_id, min(rating_date) AS f FROM ft GROUP BY 1)
SELECT {_D.format('rating_date')}, {_KPI}, count(DISTINCT CASE WHEN rating_date = f THEN user_id END) AS new_raters FROM ft JOIN fd USING (user_id) GROUP BY ft.rating_date""")
def daily_kpis(spark, sf):
    return metrics.daily_kpis(fact(spark, sf))


_WEEKLY = """WITH {0}, w AS (SELECT *, CAST({1}(rating_date) AS BIGINT) AS y, CAST(week(rating_date) AS BIGINT) AS wk, CAST(date_trunc('week', rating_date) AS DATE) AS ws FROM ft)
SELECT y AS year, wk AS week, strftime(ws, '%Y-%m-%d') AS week_start, {2} FROM w GROUP BY y, wk, ws"""


@query(_WEEKLY.format(_FACT, "year", _KPI))
def weekly_kpis(spark, sf):
    return metrics.weekly_kpis(fact(spark, sf))


@query(_WEEKLY.format(_FACT, "isoyear", _KPI))
def weekly_kpis_iso(spark, sf):
    return metrics.weekly_kpis(fact(spark, sf), iso_year=True)


@query(f"""WITH {_FACT}, fd AS (SELECT user_id, strftime(min(rating_date), '%Y-%m') AS f FROM ft GROUP BY 1),
x AS (SELECT *, CAST(year(rating_date) AS BIGINT) AS y, CAST(month(rating_date) AS BIGINT) AS m, strftime(rating_date, '%Y-%m') AS l FROM ft JOIN fd USING (user_id))
SELECT y AS year, m AS month, l AS month_label, {_KPI}, count(DISTINCT CASE WHEN f = l THEN user_id END) AS new_raters FROM x GROUP BY y, m, l""")
def monthly_kpis(spark, sf):
    return metrics.monthly_kpis(fact(spark, sf))


@query(f"""WITH {_FACT} SELECT 'year' AS grain, strftime(rating_date, '%Y') AS period, {_KPI} FROM ft GROUP BY 2
UNION ALL SELECT 'month', strftime(rating_date, '%Y-%m'), {_KPI} FROM ft GROUP BY 2
UNION ALL SELECT 'day', strftime(rating_date, '%Y-%m-%d'), {_KPI} FROM ft GROUP BY 2""")
def kpis_all_grains(spark, sf):
    return metrics.kpis_all_grains(fact(spark, sf))


_TOP = "count(rating) AS total_ratings, round(avg(rating), 3) AS avg_rating"
_ORDER = "ORDER BY total_ratings DESC, avg_rating DESC NULLS LAST, movie_id"


@query(f"""WITH {_FACT}, c AS (SELECT movie_id, {_TOP}, count(DISTINCT user_id) AS unique_raters FROM ft GROUP BY 1),
t AS (SELECT *, row_number() OVER ({_ORDER}) AS rank FROM c) SELECT t.movie_id, title, total_ratings, avg_rating, unique_raters, rank FROM t LEFT JOIN sm USING (movie_id) WHERE rank <= 100""")
def top_movies_overall(spark, sf):
    return metrics.top_movies_overall(fact(spark, sf), movies(spark, sf))


@query(f"""WITH {_FACT}, {_GENRES}, c AS (SELECT movie_id, {_TOP} FROM ft GROUP BY 1),
t AS (SELECT genre, c.*, row_number() OVER (PARTITION BY genre {_ORDER.replace('movie_id', 'c.movie_id')}) AS rank_in_genre FROM c JOIN sg ON c.movie_id = sg.movie_id)
SELECT genre, t.movie_id, title, total_ratings, avg_rating, rank_in_genre FROM t LEFT JOIN sm ON t.movie_id = sm.movie_id WHERE rank_in_genre <= 100""")
def top_movies_by_genre(spark, sf):
    return metrics.top_movies_by_genre(fact(spark, sf), movies(spark, sf), genres(spark, sf))


@query(f"""WITH {_FACT}, c AS (SELECT rating_year, rating_month, movie_id, {_TOP} FROM ft GROUP BY 1, 2, 3),
t AS (SELECT *, row_number() OVER (PARTITION BY rating_year, rating_month {_ORDER}) AS rank_in_month FROM c)
SELECT rating_year, rating_month, t.movie_id, title, total_ratings, avg_rating, rank_in_month FROM t LEFT JOIN sm ON t.movie_id = sm.movie_id WHERE rank_in_month <= 100""")
def top_movies_by_month(spark, sf):
    return metrics.top_movies_by_month(fact(spark, sf), movies(spark, sf))


_RFM = """WITH {0}, l AS (SELECT max(rating_date) AS last FROM ft),
u AS (SELECT user_id, datediff('day', max(rating_date), any_value(last)) AS recency_days, count(rating) AS frequency, round(avg(rating), 3) AS monetary FROM ft, l GROUP BY 1),
s AS (SELECT user_id, CAST(recency_days AS BIGINT) AS recency_days, frequency, monetary, ntile(5) OVER (ORDER BY {1}recency_days NULLS FIRST, user_id) AS r_score,
 ntile(5) OVER (ORDER BY frequency, user_id) AS f_score, ntile(5) OVER (ORDER BY monetary NULLS FIRST, user_id) AS m_score FROM u),
g AS (SELECT *, r_score + f_score + m_score AS rfm_score, CASE WHEN r_score >= 4 AND f_score >= 4 THEN 'Champions' WHEN f_score >= 4 THEN 'Loyal Customers'
 WHEN r_score <= 2 AND f_score >= 3 THEN 'At Risk' WHEN r_score = 1 AND f_score = 1 THEN 'Lost' ELSE 'Potential Loyalists' END AS segment FROM s)"""


@query(f"{_RFM.format(_FACT, '')} SELECT * FROM g")
def rfm_scores(spark, sf):
    return metrics.rfm_segmentation(fact(spark, sf))


@query(f"{_RFM.format(_FACT, '-')} SELECT * FROM g")
def rfm_scores_intent(spark, sf):
    return metrics.rfm_segmentation(fact(spark, sf), recency_best_high=True)


@query(f"{_RFM.format(_FACT, '')} SELECT segment, count(*) AS users FROM g GROUP BY 1")
def rfm_segment_counts(spark, sf):
    return metrics.rfm_segmentation(fact(spark, sf)).groupBy("segment").agg(F.count(F.lit(1)).alias("users"))


@query(f"""WITH {_FACT}, c AS (SELECT user_id, strftime(signup_date, '%Y-%m') AS cohort_month FROM su),
a AS (SELECT DISTINCT user_id, strftime(rating_date, '%Y-%m') AS am FROM ft), z AS (SELECT cohort_month, count(DISTINCT user_id) AS cohort_size FROM c GROUP BY 1),
x AS (SELECT cohort_month, am, count(DISTINCT user_id) AS active_users FROM a JOIN c USING (user_id) GROUP BY 1, 2)
SELECT x.cohort_month, cohort_size, (CAST(am[1:4] AS BIGINT) * 12 + CAST(am[6:7] AS BIGINT)) - (CAST(x.cohort_month[1:4] AS BIGINT) * 12 + CAST(x.cohort_month[6:7] AS BIGINT)) AS months_since_signup,
active_users, round(CAST(active_users AS DOUBLE) / cohort_size * 100, 1) AS retention_rate FROM x LEFT JOIN z ON x.cohort_month = z.cohort_month""")
def retention_cohorts(spark, sf):
    return metrics.retention_cohorts(fact(spark, sf), users(spark, sf))


# --- standardisation


@query(f"SELECT row_id, {_country_sql('country')} AS country FROM users")
def country_standardized(spark, sf):
    return table(spark, sf, "users").select("row_id", country_code(F.col("country")).alias("country"))


@query(f"SELECT row_id, strftime({_date_sql('rated_at')}, '%Y-%m-%d %H:%M:%S') AS rated_at FROM ratings")
def dates_standardized(spark, sf):
    return table(spark, sf, "ratings").select("row_id", parsed_date(F.col("rated_at")).alias("rated_at"))


# --- quality


@query("""SELECT count(*) FILTER (user_id IS NULL) AS user_id, count(*) FILTER (movie_id IS NULL) AS movie_id, count(*) FILTER (rating IS NULL) AS rating,
count(*) FILTER (rated_at IS NULL) AS rated_at FROM ratings""")
def null_check(spark, sf):
    return rules.null_counts(table(spark, sf, "ratings"), ["user_id", "movie_id", "rating", "rated_at", "no_such_column"])


@query("SELECT count(*) FILTER (rating < 1.0 OR rating > 5.0) AS out_of_range FROM ratings")
def range_check(spark, sf):
    return table(spark, sf, "ratings").agg(rules.out_of_range("rating", 1.0, 5.0).alias("out_of_range"))


@query("SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS excess_rows FROM (SELECT count(*) AS n FROM ratings GROUP BY user_id, movie_id)")
def duplicate_excess_rows(spark, sf):
    return rules.duplicate_excess(table(spark, sf, "ratings"), ["user_id", "movie_id"])


@query("SELECT count(*) FILTER (n > 1) AS duplicated_keys FROM (SELECT count(*) AS n FROM ratings GROUP BY user_id, movie_id)")
def duplicate_key_groups(spark, sf):
    return rules.duplicate_groups(table(spark, sf, "ratings"), ["user_id", "movie_id"])


@query("SELECT row_id FROM ratings r WHERE NOT EXISTS (SELECT 1 FROM movies m WHERE m.movie_id = r.movie_id)")
def orphan_keys(spark, sf):
    return rules.orphan_keys(table(spark, sf, "ratings"), "movie_id", table(spark, sf, "movies"), "movie_id").select("row_id")


@query("SELECT count(*) FILTER (plan NOT IN ('lite', 'plus', 'max', 'household')) AS not_in_set FROM users")
def in_set_check(spark, sf):
    return table(spark, sf, "users").agg(rules.not_in_set("plan", ["lite", "plus", "max", "household"]).alias("not_in_set"))


@query("SELECT count(*) AS n, count(*) BETWEEN 100 AND 10000000 AS ok FROM ratings")
def row_count_check(spark, sf):
    n = table(spark, sf, "ratings").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("ok", F.col("n").between(100, rules.MAX_ROWS))


_SUITE = rules.compile_rules({"not_null": ["user_id", "movie_id", "rating"], "range": [{"column": "rating", "min": 1.0, "max": 5.0}], "unique": [["user_id", "movie_id"]], "thresholds": {"min_row_count": 100}})


@query("""SELECT count(*) AS rows, count(*) FILTER (user_id IS NULL) AS r0, count(*) FILTER (movie_id IS NULL) AS r1, count(*) FILTER (rating IS NULL) AS r2,
count(*) FILTER (rating < 1.0 OR rating > 5.0) AS r3, (SELECT count(*) FILTER (n > 1) FROM (SELECT count(*) AS n FROM ratings GROUP BY user_id, movie_id)) AS r4 FROM ratings""")
def dq_suite_summary(spark, sf):
    return rules.measure(table(spark, sf, "ratings"), _SUITE)


# whole tables: every column with its kind; times are compared as text in UTC
_WHOLE = {
    "ratings": {"row_id": "number", "user_id": "number", "movie_id": "number", "rating": "number", "rated_at": "text", "feed_id": "text", "ingestion_timestamp": "time", "source_file_path": "text", "job_run_id": "text"},
    "movies": {"row_id": "number", "movie_id": "number", "title": "text", "genres": "text", "year": "number", "language": "text", "country": "text", "ingestion_timestamp": "time", "deleted_at": "time"},
    "users": {"row_id": "number", "snapshot_date": "text", "user_id": "number", "signup_date": "text", "country": "text", "plan": "text", "feed_id": "text", "ingestion_timestamp": "time", "job_run_id": "text"},
}


def _profile_sql(t: str, c: str, kind: str) -> str:
    v = f"({c} AT TIME ZONE 'UTC')" if kind == "time" else c
    mean, std = (f"round(avg({c}), 3)", f"round(stddev_samp({c}), 3)") if kind == "number" else ("CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)")
    return f"""SELECT '{c}' AS "column", count(*) FILTER ({c} IS NULL) AS nulls, round(CAST(count(*) FILTER ({c} IS NULL) AS DOUBLE) / count(*) * 100, 1) AS null_pct,
count(DISTINCT {c}) + CAST(count(*) > count({c}) AS INT) AS distinct_values, CAST(min({v}) AS VARCHAR) AS min, CAST(max({v}) AS VARCHAR) AS max, {mean} AS mean, {std} AS stddev FROM {t}"""


def _top5_sql(t: str, c: str, kind: str) -> str:
    v = f"({c} AT TIME ZONE 'UTC')" if kind == "time" else c
    return f"""SELECT * FROM (SELECT '{c}' AS "column", row_number() OVER (ORDER BY n DESC, v NULLS FIRST) AS rank, v AS value, n FROM
(SELECT CAST({v} AS VARCHAR) AS v, count(*) AS n FROM {t} GROUP BY 1)) WHERE rank <= 5"""


for _t, _kinds in _WHOLE.items():
    QUERIES[f"column_profile_{_t}"] = (lambda t: lambda spark, sf: plain(profile.column_profile(table(spark, sf, t))))(_t)
    SQL[f"column_profile_{_t}"] = " UNION ALL ".join(_profile_sql(_t, c, k) for c, k in _kinds.items())
    QUERIES[f"column_top5_{_t}"] = (lambda t: lambda spark, sf: plain(profile.top_values(table(spark, sf, t), 5)))(_t)
    SQL[f"column_top5_{_t}"] = " UNION ALL ".join(_top5_sql(_t, c, k) for c, k in _kinds.items())


# --- upserts, change capture, history

_SPLIT = "2024-09-01 00:00:00"


def _loads(spark, sf, before: bool) -> DataFrame:
    r = table(spark, sf, "ratings").filter((F.col("ingestion_timestamp") < F.lit(_SPLIT).cast("timestamp")) == F.lit(before))
    return star.clean_ratings(r).select("row_id", "user_id", "movie_id", "rating", "rated_at")


def _loads_sql(name: str, cond: str) -> str:
    return f"""{name} AS (SELECT row_id, user_id, movie_id, rating, rated_at FROM sr0 WHERE (ingestion_timestamp AT TIME ZONE 'UTC') {cond} TIMESTAMP '{_SPLIT}'
 QUALIFY row_number() OVER (PARTITION BY user_id, movie_id ORDER BY rated_at DESC NULLS LAST, row_id DESC) = 1)"""


@query(f"""WITH {_RATINGS}, {_loads_sql('t', '<')}, {_loads_sql('s', '>=')},
j AS (SELECT t.row_id AS ti, s.row_id AS si, coalesce(t.row_id, s.row_id) AS row_id, coalesce(t.user_id, s.user_id) AS user_id, coalesce(t.movie_id, s.movie_id) AS movie_id,
 t.rating AS tr, s.rating AS sr_, t.rated_at AS tt, s.rated_at AS st, CASE WHEN t.row_id IS NULL THEN 'insert' WHEN s.rated_at >= t.rated_at THEN 'update' ELSE 'keep' END AS action
 FROM t FULL JOIN s ON t.user_id = s.user_id AND t.movie_id = s.movie_id)
SELECT row_id, user_id, movie_id, CASE WHEN action = 'keep' THEN tr ELSE sr_ END AS rating, strftime(CASE WHEN action = 'keep' THEN tt ELSE st END, '%Y-%m-%d %H:%M:%S') AS rated_at, action FROM j""")
def merge_upsert(spark, sf):
    return upsert.merge(_loads(spark, sf, True), _loads(spark, sf, False), ["user_id", "movie_id"], ["rating", "rated_at"], with_action=True)


def _movie_loads(spark, sf, before: bool) -> DataFrame:
    m = table(spark, sf, "movies").filter((F.col("ingestion_timestamp") < F.lit(_SPLIT).cast("timestamp")) == F.lit(before))
    return star.clean_movies(m).select("movie_id", "title", "year", F.col("deleted_at").isNotNull().alias("is_deleted"))


def _movies_sql(name: str, cond: str) -> str:
    return f"""{name} AS (SELECT CAST(movie_id AS BIGINT) AS movie_id, title, CAST(year AS BIGINT) AS year, deleted_at IS NOT NULL AS d FROM movies
 WHERE movie_id IS NOT NULL AND (ingestion_timestamp AT TIME ZONE 'UTC') {cond} TIMESTAMP '{_SPLIT}'
 QUALIFY row_number() OVER (PARTITION BY movie_id ORDER BY ingestion_timestamp DESC NULLS LAST, row_id DESC) = 1)"""


@query(f"""WITH {_movies_sql('t', '<')}, {_movies_sql('s', '>=')}
SELECT coalesce(s.movie_id, t.movie_id) AS movie_id, CASE WHEN s.movie_id IS NOT NULL THEN s.title ELSE t.title END AS title, CASE WHEN s.movie_id IS NOT NULL THEN s.year ELSE t.year END AS year,
CASE WHEN t.movie_id IS NULL THEN 'insert' WHEN s.movie_id IS NULL THEN 'keep' ELSE 'update' END AS action FROM t FULL JOIN s ON t.movie_id = s.movie_id
WHERE NOT (t.movie_id IS NOT NULL AND coalesce(s.d, false))""")
def merge_soft_delete(spark, sf):
    return upsert.merge_with_deletes(_movie_loads(spark, sf, True).drop("is_deleted"), _movie_loads(spark, sf, False), ["movie_id"], "is_deleted", with_action=True)


def _snapshots(spark, sf) -> DataFrame:
    """One row per user and snapshot, the one loaded last."""
    u = table(spark, sf, "users").filter(F.col("user_id").isNotNull() & F.col("snapshot_date").isNotNull())
    return star.latest_states(u).select("user_id", F.col("snapshot_date").alias("snapshot"), "country", "plan")


_SNAPS = """n AS (SELECT user_id, snapshot_date AS snapshot, country, plan FROM users WHERE user_id IS NOT NULL AND snapshot_date IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY user_id, snapshot_date ORDER BY ingestion_timestamp DESC NULLS LAST, row_id DESC) = 1),
d AS (SELECT snapshot AS was, lead(snapshot) OVER (ORDER BY snapshot) AS snapshot FROM (SELECT DISTINCT snapshot FROM n)), o AS (SELECT user_id, d.snapshot, country, plan FROM n JOIN d ON n.snapshot = d.was WHERE d.snapshot IS NOT NULL)"""
_DIFF = "(o.country IS DISTINCT FROM n.country OR o.plan IS DISTINCT FROM n.plan)"


def _cdc(kind: str, spark, sf) -> DataFrame:
    """Changes of one kind at every snapshot: each user's row beside that of the snapshot before, moved to this one's date."""
    new = _snapshots(spark, sf)
    dates = new.select("snapshot").distinct().select(F.col("snapshot").alias("was"), F.lead("snapshot").over(W.orderBy("snapshot")).alias("next"))  # a row per snapshot
    old = new.join(dates, F.col("snapshot") == F.col("was")).filter(F.col("next").isNotNull()).select("user_id", F.col("next").alias("snapshot"), "country", "plan")
    return upsert.changes_by_kind(old, new, ["user_id", "snapshot"], ["country", "plan"])[kind]


for _kind, _cols, _from in (
    ("inserts", "n", "n LEFT JOIN o ON n.user_id = o.user_id AND n.snapshot = o.snapshot WHERE o.user_id IS NULL"),
    ("updates", "n", f"n JOIN o ON n.user_id = o.user_id AND n.snapshot = o.snapshot WHERE {_DIFF}"),
    ("deletes", "o", "o LEFT JOIN n ON n.user_id = o.user_id AND n.snapshot = o.snapshot WHERE n.user_id IS NULL"),
):
    QUERIES[f"cdc_{_kind}"] = (lambda k: lambda spark, sf: plain(_cdc(k, spark, sf)))(_kind)
    SQL[f"cdc_{_kind}"] = f"WITH {_SNAPS} SELECT {_cols}.user_id, strftime({_cols}.snapshot, '%Y-%m-%d') AS snapshot, {_cols}.country, {_cols}.plan, '{_kind[:-1].upper()}' AS cdc_operation FROM {_from}"

_FIRST, _SECOND = "2024-08-31", "2024-09-01"


def _user_loads(spark, sf, before: bool) -> DataFrame:
    """Users as a load found them: of the rows delivered until the split or after it the newest of each."""
    early = F.coalesce(F.col("ingestion_timestamp") < F.lit(_SPLIT).cast("timestamp"), F.lit(False))
    u = table(spark, sf, "users").filter(F.col("user_id").isNotNull() & (early == F.lit(before)))
    order = [F.col("snapshot_date").desc_nulls_last(), F.col("ingestion_timestamp").desc_nulls_last(), F.col("row_id").desc()]
    return ranking.deduplicate(u, ["user_id"], order).select("user_id", "country", "plan")


def _user_loads_sql(name: str, cond: str) -> str:
    return f"""{name} AS (SELECT user_id, country, plan FROM users WHERE user_id IS NOT NULL AND {cond} coalesce((ingestion_timestamp AT TIME ZONE 'UTC') < TIMESTAMP '{_SPLIT}', false)
 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY snapshot_date DESC NULLS LAST, ingestion_timestamp DESC NULLS LAST, row_id DESC) = 1)"""


_USER_LOADS = f"{_user_loads_sql('o', '')}, {_user_loads_sql('n', 'NOT')}"


@query(f"""WITH {_USERS} SELECT user_id, country, plan, '{_FIRST} 00:00:00' AS scd_start_date, CAST(NULL AS VARCHAR) AS scd_end_date, true AS is_current FROM su""")
def scd2_first_load(spark, sf):
    return upsert.scd2_first_load(users(spark, sf).select("user_id", "country", "plan"), F.lit(_FIRST))


@query(f"""WITH {_USER_LOADS} SELECT o.user_id, o.country, o.plan, '{_FIRST} 00:00:00' AS scd_start_date, CASE WHEN n.user_id IS NOT NULL AND {_DIFF} THEN '{_SECOND} 00:00:00' END AS scd_end_date,
NOT (n.user_id IS NOT NULL AND {_DIFF}) AS is_current FROM o LEFT JOIN n ON o.user_id = n.user_id
UNION ALL SELECT n.user_id, n.country, n.plan, '{_SECOND} 00:00:00', CAST(NULL AS VARCHAR), true FROM n LEFT JOIN o ON o.user_id = n.user_id WHERE o.user_id IS NULL OR {_DIFF}""")
def scd2_second_load(spark, sf):
    first = upsert.scd2_first_load(_user_loads(spark, sf, True), F.lit(_FIRST))
    return upsert.apply_scd2(first, _user_loads(spark, sf, False), "user_id", ["country", "plan"], F.lit(_SECOND))


# --- incremental


@query(f"SELECT row_id, CAST(user_id AS BIGINT) AS user_id, CAST(movie_id AS BIGINT) AS movie_id FROM ratings WHERE (ingestion_timestamp AT TIME ZONE 'UTC') > TIMESTAMP '{_SPLIT}'")
def watermark_filter(spark, sf):
    return incremental.filter_since(table(spark, sf, "ratings"), "ingestion_timestamp", _SPLIT).select("row_id", "user_id", "movie_id")


@query("SELECT strftime(max(ingestion_timestamp AT TIME ZONE 'UTC'), '%Y-%m-%d %H:%M:%S') AS mark FROM ratings")
def watermark_max(spark, sf):
    return table(spark, sf, "ratings").agg(F.max("ingestion_timestamp").alias("mark"))


@query(f"""SELECT *, round((1 - CAST(incremental_rows AS DOUBLE) / full_rows) * 100, 1) AS saved_pct FROM (SELECT count(*) AS full_rows,
count(*) FILTER ((ingestion_timestamp AT TIME ZONE 'UTC') > TIMESTAMP '{_SPLIT}') AS incremental_rows FROM ratings)""")
def full_vs_incremental_counts(spark, sf):
    r = table(spark, sf, "ratings").select("ingestion_timestamp")
    return incremental.full_vs_incremental(r, r, "ingestion_timestamp", _SPLIT)


@query("""WITH d AS (SELECT *, (ingestion_timestamp AT TIME ZONE 'UTC') > TIMESTAMP '{0}' AS past FROM ratings)
SELECT 'all' AS mark, count(*) AS rows, 0 AS next_rows FROM d UNION ALL SELECT 'split', count(*) FILTER (past), 0 FROM d""".format(_SPLIT))
def incremental_rows(spark, sf):
    """Rows that an incremental run takes without a mark and from one, and what the next run finds: nothing."""
    r, marks, out = table(spark, sf, "ratings").select("ingestion_timestamp"), incremental.Watermarks(spark, scratch(spark, "marks")), []
    for name, start in (("all", None), ("split", _SPLIT)):
        if start:
            marks.set(name, start)
        out.append((name, marks.consume(name, r, "ingestion_timestamp"), marks.consume(name, r, "ingestion_timestamp")))
    return spark.createDataFrame(out, "mark string, rows bigint, next_rows bigint")


@query(f"""WITH {_RATINGS} SELECT row_id, user_id, movie_id, rating, {_DT.format('rated_at')} FROM sr""")
def append_then_dedupe(spark, sf):
    """The table of the first load and the rows that came since, together, one row per key."""
    r = table(spark, sf, "ratings").filter(F.col("user_id").isNotNull() & F.col("movie_id").isNotNull())
    cols = ["row_id", "user_id", "movie_id", "rating", parsed_date(F.col("rated_at")).alias("rated_at")]
    # as it is merged, a row without a load time is part of the first load
    new = F.coalesce(F.col("ingestion_timestamp") >= F.lit(_SPLIT).cast("timestamp"), F.lit(False))
    order = [F.col("rated_at").desc_nulls_last(), F.col("row_id").desc()]
    return incremental.append_then_dedupe(star.clean_ratings(r.filter(~new)).select(*cols[:4], "rated_at"), r.filter(new).select(*cols), ["user_id", "movie_id"], order)


@query("""SELECT row_id, CAST(user_id AS BIGINT) AS user_id, CAST(movie_id AS BIGINT) AS movie_id,
CAST(CASE WHEN rating < 1.0 OR rating > 5.0 THEN least(greatest(rating, 1.0), 5.0) ELSE rating END AS DOUBLE) AS rating FROM ratings""")
def conditional_rewrite(spark, sf):
    r = table(spark, sf, "ratings").select("row_id", "user_id", "movie_id", "rating")
    within = F.least(F.greatest(F.col("rating"), F.lit(1.0)), F.lit(5.0))
    return upsert.rewrite(r, (F.col("rating") < 1.0) | (F.col("rating") > 5.0), {"rating": within})


# --- rule outcomes, records and logs

_OUTCOMES = rules.compile_rules(
    {"not_null": ["user_id", "rating", "no_such_column"], "range": [{"column": "rating", "min": 1.0, "max": 5.0}, {"column": "no_such_column", "min": 0, "max": 1}], "unique": [["row_id"]], "thresholds": {"min_row_count": 100, "max_null_pct": 50.0}},
    thresholds=True,
) + [rules.Rule("column_exists", ("rated_at",)), rules.Rule("column_exists", ("no_such_column",)), rules.Rule("in_set", ("feed_id",), values=("web", "none"))]
_OUTCOMES_SQL = """c AS (SELECT count(*) AS n, count(*) FILTER (user_id IS NULL) AS u, count(*) FILTER (rating IS NULL) AS r, count(*) FILTER (rating < 1.0 OR rating > 5.0) AS o,
count(row_id) - count(DISTINCT row_id) AS d, count(*) FILTER (feed_id NOT IN ('web', 'none')) AS f FROM ratings),
x AS (SELECT unnest([
{'rule': 'not_null(user_id)', 'bad': u, 'most': 0}, {'rule': 'not_null(rating)', 'bad': r, 'most': 0}, {'rule': 'not_null(no_such_column)', 'bad': 1, 'most': 0},
{'rule': 'between(rating)', 'bad': o, 'most': 0}, {'rule': 'between(no_such_column)', 'bad': 0, 'most': -1}, {'rule': 'unique(row_id)', 'bad': d, 'most': 0},
{'rule': 'row_count()', 'bad': CAST(n < 100 AS INT), 'most': 0}, {'rule': 'max_null_pct(user_id)', 'bad': u, 'most': n * 0.5}, {'rule': 'max_null_pct(rating)', 'bad': r, 'most': n * 0.5},
{'rule': 'max_null_pct(no_such_column)', 'bad': 0, 'most': -1}, {'rule': 'column_exists(rated_at)', 'bad': 0, 'most': 0},
{'rule': 'column_exists(no_such_column)', 'bad': 1, 'most': 0}, {'rule': 'in_set(feed_id)', 'bad': f, 'most': 0}]) AS s FROM c),
o AS (SELECT s.rule AS rule, CASE WHEN s.most < 0 THEN 'skipped' WHEN s.bad <= s.most THEN 'passed' ELSE 'failed' END AS status, CAST(s.bad AS BIGINT) AS failed_count FROM x WHERE s.bad >= 0)"""


@query(f"WITH {_OUTCOMES_SQL} SELECT * FROM o")
def suite_outcomes(spark, sf):
    """Every rule of a suite with its status, those about columns that do not exist included."""
    return rules.outcomes(table(spark, sf, "ratings"), _OUTCOMES).select("rule", "status", "failed_count")


@query(f"""WITH {_OUTCOMES_SQL} SELECT count(*) FILTER (status = 'passed') AS passed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped,
round(CAST(count(*) FILTER (status = 'passed') AS DOUBLE) / count(*) FILTER (status <> 'skipped') * 100, 1) AS success_pct FROM o""")
def suite_success(spark, sf):
    return rules.success(rules.outcomes(table(spark, sf, "ratings"), _OUTCOMES))


_RECORD_SQL = """SELECT 'ratings' AS table_name, n AS total_rows, b AS null_count, o AS range_count, m AS reference_count, d AS duplicate_count, b + o + m + d AS total_failed, b + o + m + d = 0 AS passed FROM (
SELECT count(*) AS n, count(*) FILTER (user_id IS NULL) + count(*) FILTER (movie_id IS NULL) AS b, count(*) FILTER (rating < 1.0 OR rating > 5.0) AS o,
(SELECT count(*) FROM ratings r WHERE NOT EXISTS (SELECT 1 FROM movies x WHERE x.movie_id = r.movie_id)) + (SELECT count(*) FROM ratings r WHERE NOT EXISTS (SELECT 1 FROM users x WHERE x.user_id = r.user_id)) AS m,
(SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) FROM (SELECT count(*) AS c FROM ratings GROUP BY user_id, movie_id)) AS d FROM ratings)"""


@query(_RECORD_SQL)
def quality_record(spark, sf):
    parents = [("movie_id", table(spark, sf, "movies"), "movie_id"), ("user_id", table(spark, sf, "users"), "user_id")]
    return rules.quality_record(table(spark, sf, "ratings"), "ratings", ["user_id", "movie_id"], [("rating", 1.0, 5.0)], parents, ["user_id", "movie_id"])


@query(f"SELECT table_name, '2024-01-0' || CAST(i AS VARCHAR) AS check_date, total_rows, duplicate_count, total_failed, passed FROM ({_RECORD_SQL}), range(1, 3) t(i)")
def metrics_log(spark, sf):
    """The log of quality records after two checks."""
    log, record = reports.MetricsLog(spark, scratch(spark, "metrics")), quality_record(spark, sf)
    for day in (1, 2):
        log.add(record, date(2024, 1, day))
    return log.read()


@query("""SELECT 'count' AS stage, 'done' AS status, 1 AS runs, (SELECT count(*) FROM ratings) AS result UNION ALL SELECT 'fail once', 'done', 2, (SELECT count(*) FROM movies)
UNION ALL SELECT 'sum', 'done', 1, (SELECT count(*) FROM ratings) + (SELECT count(*) FROM movies)""")
def checkpoint_stages(spark, sf):
    """Stages of a run that fails and is taken up again: those done before are not run twice."""
    folder, ran = scratch(spark, "checkpoints"), Counter()
    rows = lambda t: table(spark, sf, t).agg(F.count(F.lit(1))).first()[0]

    def fails_once(_: dict) -> int:
        if ran["fail once"] == 1:
            raise RuntimeError("the first time")
        return rows("movies")

    stages = [("count", lambda _: rows("ratings")), ("fail once", fails_once), ("sum", lambda x: x["count"] + x["fail once"])]
    counted = [(n, lambda x, n=n, f=f: (ran.update([n]), f(x))[1]) for n, f in stages]
    for _ in range(2):
        try:
            incremental.run_stages(c := incremental.Checkpoint(spark, folder, "run"), counted)
        except RuntimeError:
            continue
    out = [(r["stage"], r["status"], ran[r["stage"]], c.result(r["stage"])) for r in c.as_dataframe().collect()]
    return spark.createDataFrame(out, "stage string, status string, runs bigint, result bigint")


@query("""SELECT * FROM (VALUES ('analytics', 'skipped', 0, CAST(NULL AS BIGINT)), ('clean', 'success', 2, (SELECT count(*) FROM ratings)), ('incremental', 'skipped', 0, NULL), ('ingest_movies', 'success', 1, (SELECT count(*) FROM movies)),
('ingest_ratings', 'success', 1, (SELECT count(*) FROM ratings)), ('ingest_users', 'success', 1, (SELECT count(*) FROM users)), ('monitoring', 'success', 1, 0), ('quality', 'failed', 1, NULL)) t(task, status, attempts, rows)""")
def run_log(spark, sf):
    """The log of a run: a step that fails once is tried again, a quality gate that fails stops what follows but the monitoring."""
    rows, tried = lambda t: table(spark, sf, t).agg(F.count(F.lit(1))).first()[0], Counter()

    def clean(c: dict) -> int:
        tried["clean"] += 1
        if tried["clean"] == 1:
            raise RuntimeError("the first time")
        return c["ingest_ratings"]

    def gate(_: dict) -> None:
        flow.quality_gate({"ratings": rules.run_suite(table(spark, sf, "ratings"), [rules.Rule("column_exists", ("no_such_column",))], "ratings")})

    steps = {f"ingest_{t}": (lambda t: lambda _: rows(t))(t) for t in ("ratings", "movies", "users")}
    steps |= {"clean": clean, "quality": gate, "analytics": lambda _: 1, "incremental": lambda _: 1, "monitoring": lambda _: 0}
    log = flow.RunLog(spark, scratch(spark, "runs"))
    log.add(flow.standard_flow(steps, retry=flow.Retry(1, 0.0)).execute())
    return log.as_dataframe().select("task", "status", "attempts", "rows")


# --- sources and streams


@query("""SELECT CAST(movie_id AS BIGINT) AS movie_id, title, genres, CAST(year AS BIGINT) AS year, language, country, true AS stamped, 'run-1' AS job_run_id FROM movies""")
def landed_movies(spark, sf):
    path = f"{sf}/movies.parquet"
    good, _ = files.split_corrupt(files.read_source(spark, path, files.MOVIES))
    x = files.add_audit_columns(good, path, "run-1")
    return x.select(*files.MOVIES.fieldNames(), (F.col("ingestion_timestamp").isNotNull() & (F.col("source_file_path") == path)).alias("stamped"), "job_run_id")


@query("""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n, round(avg(value), 4) AS avg_value FROM events GROUP BY 1""")
def stream_tumbling_daily(spark, sf):
    """Daily windows of the event stream, all that is there in micro-batches; the last state is the result."""
    path = f"{sf}/events.parquet"
    batch = spark.read.parquet(path)
    # as a glob the source may be one file as well as a folder
    stream = spark.readStream.schema(batch.schema).parquet(path[:-1] + "[t]").withColumn("ts", F.col("ts").cast("timestamp"))
    out = scratch(spark, "stream")
    q = (
        windows.tumbling(stream, "ts", "value").writeStream.outputMode("update").option("checkpointLocation", f"{out}/state").trigger(availableNow=True)
        .foreachBatch(lambda b, i: b.withColumn("batch", F.lit(i)).write.mode("append").parquet(f"{out}/updates")).start()
    )
    q.awaitTermination()
    return windows.latest_windows(spark.read.parquet(f"{out}/updates")).select("window_start", "n", F.round("avg_value", 4).alias("avg_value"))


def _dropped(spark: SparkSession, sf: str) -> dict[str, str]:
    """The tables written as files of the three formats, as a source would drop them; ratings without a value are broken lines."""
    base = scratch(spark, "drop")
    r = table(spark, sf, "ratings").select("user_id", "movie_id", F.coalesce(F.col("rating").cast("string"), F.lit("none")).alias("rating"), "rated_at")
    r.write.options(header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(f"{base}/ratings")
    table(spark, sf, "movies").select(*files.MOVIES.fieldNames()).write.option("ignoreNullFields", False).json(f"{base}/movies")
    table(spark, sf, "users").select(*files.USERS.fieldNames()).write.parquet(f"{base}/users")
    return {t: f"{base}/{t}" for t in ("ratings", "movies", "users")}


_KINDS = {"ratings": files.RATINGS, "movies": files.MOVIES, "users": files.USERS}


def _landed(spark: SparkSession, sf: str) -> tuple[files.Landing, dict[str, str]]:
    base = scratch(spark, "landed")
    landing = files.Landing(spark, f"{base}/raw", files.Registry(spark, f"{base}/registry"), files.Quarantine(spark, f"{base}/quarantine"))
    folders = _dropped(spark, sf)
    for t, folder in folders.items():
        landing.ingest_directory(folder, "files", t, _KINDS[t])
    return landing, folders


@query("""SELECT 'ratings' AS entity, count(rating) AS rows, count(*) - count(rating) AS bad, 0 AS again FROM ratings
UNION ALL SELECT 'movies', count(*), 0, 0 FROM movies UNION ALL SELECT 'users', count(*), 0, 0 FROM users""")
def file_ingest_roundtrip(spark, sf):
    """Whole tables landed from CSV, JSON and Parquet files: rows landed and set aside, and folders written when the same files come again."""
    landing, folders = _landed(spark, sf)
    again = {t: len(landing.ingest_directory(folder, "files", t, _KINDS[t])) for t, folder in folders.items()}
    entity = F.regexp_extract("out", "/files/([a-z]+)/", 1)
    x = landing.registry.as_dataframe().groupBy(entity.alias("entity")).agg(F.sum("rows").alias("rows"), F.sum("bad").alias("bad"))
    return x.join(spark.createDataFrame(list(again.items()), "entity string, again bigint"), "entity")


@query("SELECT CAST(user_id AS BIGINT) AS user_id, CAST(movie_id AS BIGINT) AS movie_id, CAST(rating AS DOUBLE) AS rating, nullif(rated_at, '') AS rated_at FROM ratings WHERE rating IS NOT NULL")
def landed_ratings_csv(spark, sf):
    x = files.read_landed(spark, _landed(spark, sf)[0].base, "files", "ratings")
    return x.select("user_id", "movie_id", "rating", F.nullif(F.col("rated_at"), F.lit("")).alias("rated_at"))


@query("SELECT CAST(movie_id AS BIGINT) AS movie_id, title, genres, CAST(year AS BIGINT) AS year, language, country FROM movies")
def landed_movies_json(spark, sf):
    return files.read_landed(spark, _landed(spark, sf)[0].base, "files", "movies").select(*files.MOVIES.fieldNames())


@query("SELECT user_id, signup_date, country, plan FROM users")
def landed_users_parquet(spark, sf):
    return files.read_landed(spark, _landed(spark, sf)[0].base, "files", "users").select(*files.USERS.fieldNames())


@query("SELECT CAST(count(*) AS BIGINT) AS records FROM ratings WHERE rating IS NULL")
def quarantined_records(spark, sf):
    """Broken records kept beside the landed ones."""
    landing = _landed(spark, sf)[0]
    x = spark.read.option("recursiveFileLookup", True).parquet(landing.quarantine.records)
    return x.filter(F.col(files.CORRUPT).contains('"none"')).agg(F.count(F.lit(1)).alias("records"))


@query("SELECT 'empty.csv' AS file, 'no row could be read' AS reason UNION ALL SELECT 'words.csv', 'no row could be read'")
def quarantined_files(spark, sf):
    """Files that cannot be landed, with the reason; the table's own file beside them lands."""
    base = scratch(spark, "bad-files")
    for name, text in (("empty.csv", ""), ("words.csv", "\n".join("x,y,z" for _ in range(3)) + "\n")):
        store.write_text(spark, f"{base}/in/{name}", "user_id,movie_id,rating,rated_at\n" + text)
    landing = files.Landing(spark, f"{base}/raw", files.Registry(spark, f"{base}/registry"), files.Quarantine(spark, f"{base}/quarantine"))
    landing.ingest_directory(f"{base}/in", "files", "ratings", files.RATINGS)
    return landing.quarantine.as_dataframe().select(F.regexp_extract("file", "([^/]+)$", 1).alias("file"), "reason")
