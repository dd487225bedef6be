"""Queries of the training-data problems 1 to 7, and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import asof, bad_rows, history, instants, lateness, orphans, packed_values
from millrace.plans.instants_sql import instants as instants_in_sql
from millrace.util import blank_to_null, spread, table

Query = Callable[[SparkSession, str], DataFrame]


def _or_blank(*names: str) -> list[Column]:
    return [F.coalesce(F.col(n), F.lit("")).alias(n) for n in names]


def clean_users(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    """``users`` with ``plan`` in lower case and ``country`` as its iso2 code; blank is null."""
    codes = table(spark, sf, "country_codes").select(F.lower(F.trim("alias")).alias("_alias"), F.col("iso2").alias("_iso2"))
    u = table(spark, sf, "users").select(*cols, F.lower(blank_to_null(F.col("country"))).alias("_country"), F.lower(blank_to_null(F.col("plan"))).alias("plan"))
    return u.join(codes, u["_country"] == codes["_alias"], "left").select(*cols, F.col("_iso2").alias("country"), "plan")


def ratings_instants(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    return instants.with_instants(spread(table(spark, sf, "ratings")), table(spark, sf, "feeds"), "rated_at", keep=list(cols))


# --- 1


def orphan_ratings(spark: SparkSession, sf: str) -> DataFrame:
    ratings = table(spark, sf, "ratings")
    movies = orphans.parents_with_deletion(table(spark, sf, "movies"), "movie_id", "ingestion_timestamp", "deleted_at")
    users = orphans.parents_from_snapshots(table(spark, sf, "users"), "user_id", "snapshot_date", "ingestion_timestamp")
    return orphans.orphan_rows(ratings, "ingestion_timestamp", "row_id", {"movies": ("movie_id", movies), "users": ("user_id", users)})


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return orphan_ratings(spark, sf).select("ref_table", "period", "row_id", "state")


def p1_report(spark: SparkSession, sf: str) -> DataFrame:
    return orphans.orphan_report(orphan_ratings(spark, sf))


_P1 = """
WITH m AS (SELECT movie_id AS k, min(ingestion_timestamp) AS seen, min(deleted_at) AS gone FROM movies WHERE movie_id IS NOT NULL GROUP BY 1),
d AS (SELECT snapshot_date, lead(snapshot_date) OVER (ORDER BY snapshot_date) AS nxt FROM (SELECT DISTINCT snapshot_date FROM users)),
l AS (SELECT user_id AS k, min(ingestion_timestamp) AS seen, max(snapshot_date) AS last FROM users WHERE user_id IS NOT NULL GROUP BY 1),
u AS (SELECT k, seen, CAST(nxt AS TIMESTAMP) AS gone FROM l LEFT JOIN d ON last = snapshot_date),
r AS (
  SELECT 'movies' AS ref_table, r.ingestion_timestamp AS t, row_id, movie_id AS k, CASE WHEN m.k IS NULL THEN 'missing' WHEN seen > r.ingestion_timestamp THEN 'late'
    WHEN gone <= r.ingestion_timestamp THEN 'deleted' END AS state FROM ratings r LEFT JOIN m ON r.movie_id = m.k WHERE r.movie_id IS NOT NULL
  UNION ALL
  SELECT 'users', r.ingestion_timestamp, row_id, user_id, CASE WHEN u.k IS NULL THEN 'missing' WHEN seen > r.ingestion_timestamp THEN 'late'
    WHEN gone <= CAST(r.ingestion_timestamp AT TIME ZONE 'UTC' AS TIMESTAMP) THEN 'deleted' END FROM ratings r LEFT JOIN u ON r.user_id = u.k WHERE r.user_id IS NOT NULL)
"""
_P1_PERIOD = "coalesce(strftime(t AT TIME ZONE 'UTC', '%Y-%m'), '') AS period"
SQL_P1_FOUND = f"{_P1} SELECT ref_table, {_P1_PERIOD}, row_id, state FROM r WHERE state IS NOT NULL"
SQL_P1_REPORT = f"""{_P1} SELECT ref_table, {_P1_PERIOD}, state, count(*) AS orphan_rows, count(DISTINCT k) AS orphan_keys FROM r WHERE state IS NOT NULL GROUP BY ALL"""

# --- 2


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return packed_values.split_packed(table(spark, sf, "movies"), "genres", "pos", "genre", keep=["row_id"])


def p2_genre_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How often each genre stands at each position."""
    return p2_found(spark, sf).groupBy("genre", "pos").agg(F.count(F.lit(1)).alias("movies"))


def _p2_sql() -> str:
    """Values by one pattern per piece: quoted to a mark that a delimiter or the end follows, else up to the next delimiter."""
    d = packed_values.DELIMITERS.replace("\t", r"\t").replace("\n", r"\n").replace("\r", r"\r")
    blank = r"[ \x{a0}\x{3000}]*"
    quoted = "|".join(rf"{a}(?:\\[{b}\\]|{b}{b}|.)*?{b}{blank}" for a, b in packed_values.QUOTES.items())
    piece = rf"(?s){blank}({quoted}|[^{d}]*)(?:[{d}]|$)".replace("'", "''")
    value = "trim(x)"
    for a, b in packed_values.QUOTES.items():
        a, b = a.replace("'", "''"), b.replace("'", "''")
        inner = f"replace(replace(replace(trim(x)[2:-2], '\\{b}', '{b}'), '\\\\', '\\'), '{b}{b}', '{b}')"
        value = rf"CASE WHEN regexp_full_match(trim(x), '(?s){a}(\\[{b}\\]|{b}{b}|[^{b}])*{b}') THEN trim({inner}) ELSE {value} END"
    field = r"regexp_replace(genres, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')"
    return f"""WITH f AS (SELECT row_id, CASE WHEN g LIKE '[%]' THEN g[2:-2] ELSE g END AS g FROM (SELECT row_id, {field} AS g FROM movies)),
v AS (SELECT row_id, list_filter(list_transform(regexp_extract_all(g, '{piece}', 1), lambda x: {value}), lambda y: y <> '') AS v FROM f),
p AS (SELECT row_id, unnest(v) AS genre, generate_subscripts(v, 1) AS pos FROM v)"""


SQL_P2_FOUND = f"{_p2_sql()} SELECT row_id, CAST(pos AS INT) AS pos, genre FROM p"
SQL_P2_COUNTS = f"{_p2_sql()} SELECT genre, CAST(pos AS INT) AS pos, count(*) AS movies FROM p GROUP BY ALL"

# --- 3


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return bad_rows.rejected(table(spark, sf, "ratings_raw"), "raw_line").select("line_id", "reason")


def p3_loaded(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "ratings_raw").select("line_id", "raw_line")
    return bad_rows.loaded(raw, "raw_line").select("line_id", "user_id", "movie_id", "rating", "rated_at")


def p3_report(spark: SparkSession, sf: str) -> DataFrame:
    """Lines per reason; the field is told of invalid values only (``p3_broken_at`` tells it of all)."""
    field = F.when(F.col("reason") == "invalid_value", F.col("broken_field")).otherwise("")
    x = bad_rows.rejected(table(spark, sf, "ratings_raw"), "raw_line").withColumn("broken_field", field)
    return x.groupBy("source_file_path", "reason", "broken_field").agg(F.count(F.lit(1)).alias("lines"))


def p3_broken_at(spark: SparkSession, sf: str) -> DataFrame:
    """Every line set aside with its reason and the place and name of its first broken field."""
    return bad_rows.rejected(table(spark, sf, "ratings_raw"), "raw_line").select("line_id", "reason", "broken_at", *_or_blank("broken_field"))


_P3 = r"""
WITH b AS (SELECT line_id, source_file_path, regexp_replace(raw_line, '(\r\n|\r|\n)$', '') AS s FROM ratings_raw),
q AS (SELECT *, regexp_full_match(s, '("([^"]|"")*"|[^",]?|[^",][^",]*)(,("([^"]|"")*"|[^",]?|[^",][^",]*))*', 's') AS ok,
  regexp_extract_all(s, '(?s)(?:^|,)("(?:[^"]|"")*"|[^",]*)', 1) AS f FROM b),
v AS (SELECT *, list_transform(f, lambda x: trim(CASE WHEN x LIKE '"%' THEN replace(x[2:-2], '""', '"') ELSE x END, chr(32) || chr(9))) AS g FROM q),
c AS (SELECT line_id, source_file_path, g, f, CASE WHEN s IS NULL THEN 'column_count' WHEN NOT ok THEN 'broken_quoting' WHEN len(f) <> 4 THEN 'column_count'
  WHEN NOT (regexp_full_match(g[1], '[0-9]+') AND coalesce(TRY_CAST(g[1] AS HUGEINT), 0) BETWEEN 1 AND 2147483647) THEN 'user_id'
  WHEN NOT (regexp_full_match(g[2], '[0-9]+') AND coalesce(TRY_CAST(g[2] AS HUGEINT), 0) BETWEEN 1 AND 2147483647) THEN 'movie_id'
  WHEN NOT (regexp_full_match(g[3], '[0-9]+([.][0-9]+)?') AND coalesce(TRY_CAST(g[3] AS DECIMAL(38, 15)), 0) BETWEEN 1 AND 5) THEN 'rating' END AS bad FROM v)
"""
_P3_REASON = "CASE WHEN bad IN ('user_id', 'movie_id', 'rating') THEN 'invalid_value' ELSE bad END"
SQL_P3_FOUND = f"{_P3} SELECT line_id, {_P3_REASON} AS reason FROM c WHERE bad IS NOT NULL"
SQL_P3_REPORT = f"""{_P3} SELECT source_file_path, {_P3_REASON} AS reason, CASE WHEN bad IN ('user_id', 'movie_id', 'rating') THEN bad ELSE '' END AS broken_field, count(*) AS lines
FROM c WHERE bad IS NOT NULL GROUP BY ALL"""
SQL_P3_LOADED = f"""{_P3} SELECT line_id, CAST(g[1] AS INT) AS user_id, CAST(g[2] AS INT) AS movie_id, CAST(g[3] AS DOUBLE) AS rating,
CASE WHEN f[4] LIKE '"%' THEN replace(f[4][2:-2], '""', '"') ELSE f[4] END AS rated_at FROM c WHERE bad IS NULL"""

# --- 4

_DATE = "yyyy-MM-dd"


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    u = clean_users(spark, sf, "user_id", "snapshot_date", "ingestion_timestamp", "row_id")
    h = history.snapshot_history(u, "user_id", "snapshot_date", "ingestion_timestamp", ["country", "plan"], "row_id")
    return h.select(F.col("key").alias("user_id"), F.date_format("valid_from", _DATE).alias("valid_from"), F.date_format("valid_to", _DATE).alias("valid_to"), *_or_blank("country", "plan"))


def p4_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Change events per snapshot and kind."""
    u = clean_users(spark, sf, "user_id", "snapshot_date", "ingestion_timestamp", "row_id")
    states = history.latest_per_snapshot(u, "user_id", "snapshot_date", "ingestion_timestamp", ["country", "plan"], "row_id")
    return history.changes(states, ["country", "plan"]).groupBy(F.date_format("at", _DATE).alias("at"), "op").agg(F.count(F.lit(1)).alias("users"))


_USERS = """
cu AS (SELECT u.row_id, user_id, snapshot_date, ingestion_timestamp, coalesce(iso2, '') AS country, coalesce(nullif(lower(trim(plan)), ''), '') AS plan
  FROM users u LEFT JOIN country_codes ON lower(trim(country)) = lower(trim(alias)))
"""
_P4 = f"""
WITH {_USERS},
s AS (SELECT * FROM cu WHERE user_id IS NOT NULL AND snapshot_date IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY user_id, snapshot_date ORDER BY ingestion_timestamp DESC, row_id DESC) = 1),
d AS (SELECT snapshot_date, row_number() OVER (ORDER BY snapshot_date) AS i, lead(snapshot_date) OVER (ORDER BY snapshot_date) AS nxt
  FROM (SELECT DISTINCT snapshot_date FROM users WHERE user_id IS NOT NULL)),
x AS (SELECT s.*, i, nxt, lag(i) OVER w AS pi, lag(country) OVER w AS pc, lag(plan) OVER w AS pp FROM s JOIN d USING (snapshot_date)
  WINDOW w AS (PARTITION BY user_id ORDER BY snapshot_date))
"""
SQL_P4_FOUND = f"""{_P4}, g AS (SELECT *, sum(CASE WHEN pi = i - 1 AND pc = country AND pp = plan THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY snapshot_date) AS run FROM x),
h AS (SELECT user_id, min(snapshot_date) AS f, max(i) AS li, country, plan FROM g GROUP BY user_id, run, country, plan)
SELECT user_id, strftime(f, '%Y-%m-%d') AS valid_from, coalesce(strftime(d.nxt, '%Y-%m-%d'), '9999-12-31') AS valid_to, country, plan FROM h JOIN d ON li = d.i"""
SQL_P4_CHANGES = f"""{_P4}
SELECT strftime(snapshot_date, '%Y-%m-%d') AS at, CASE WHEN pi = i - 1 THEN 'changed' ELSE 'inserted' END AS op, count(*) AS users FROM x
WHERE NOT coalesce(pi = i - 1 AND pc = country AND pp = plan, false) GROUP BY ALL
UNION ALL SELECT strftime(nxt, '%Y-%m-%d'), 'deleted', count(*) FROM (SELECT *, lead(i) OVER (PARTITION BY user_id ORDER BY snapshot_date) AS ni FROM x)
WHERE nxt IS NOT NULL AND coalesce(ni <> i + 1, true) GROUP BY ALL"""

# --- 5


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    r = ratings_instants(spark, sf, "row_id", "user_id").select("row_id", F.col("user_id").alias("key"), F.col("utc_us").alias("at_us"))
    u = clean_users(spark, sf, "user_id", "snapshot_date", "ingestion_timestamp", "row_id")
    known = u.select(F.col("user_id").alias("key"), F.unix_micros(F.col("ingestion_timestamp").cast("timestamp")).alias("rec_us"), F.unix_date("snapshot_date").alias("valid"), F.col("row_id").alias("tie"), "plan", "country")
    keys = table(spark, sf, "ratings").select(F.col("user_id").alias("key"))
    return asof.as_known(r, known, ["plan", "country"], event_keys=keys).select("row_id", *_or_blank("plan", "country"))


# --- 6


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    feeds = table(spark, sf, "feeds")
    parts = [("ratings", "rated_at", False), ("users", "signup_date", True)]
    x = [instants.with_instants(spread(table(spark, sf, t)), feeds, c, dates, keep=["row_id"]).select(F.lit(t).alias("table_name"), "row_id", "utc_us") for t, c, dates in parts]
    return x[0].unionByName(x[1]).filter(F.col("utc_us").isNotNull())


def p6_readings(spark: SparkSession, sf: str) -> DataFrame:
    """Rows per feed and reading, unreadable and unresolved ones included."""
    x = instants.with_instants(spread(table(spark, sf, "ratings")), table(spark, sf, "feeds"), "rated_at", keep=["feed_id"])
    return x.groupBy("feed_id", F.coalesce("reading", F.lit("none")).alias("reading")).agg(F.count(F.lit(1)).alias("rows"), F.count("utc_us").alias("values"))


# --- 7


def arrived_ratings(spark: SparkSession, sf: str) -> DataFrame:
    r = ratings_instants(spark, sf, "row_id", "rating", "ingestion_timestamp")
    return lateness.arrivals(r, F.col("utc_us"), F.unix_micros(F.col("ingestion_timestamp").cast("timestamp")), "row_id", "rating")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    x = lateness.reordered(arrived_ratings(spark, sf))
    return x.filter(F.col("verdict") != lateness.ON_TIME).select("row_id", "event_day", "verdict")


def p7_daily(spark: SparkSession, sf: str) -> DataFrame:
    return lateness.ordered_daily(arrived_ratings(spark, sf)).withColumn("avg_value", F.round("avg_value", 6))


def p7_revisions(spark: SparkSession, sf: str) -> DataFrame:
    return lateness.revisions(arrived_ratings(spark, sf)).withColumn("avg_value", F.round("avg_value", 6))


# --- 5 to 7 in SQL

_RATED = instants_in_sql("ratings", "row_id", "rated_at", "inst")
SQL_P5_FOUND = f"""WITH {_RATED}, {_USERS},
known AS (SELECT user_id, epoch_us(ingestion_timestamp) AS rec, snapshot_date, row_id AS tie, plan, country FROM cu WHERE user_id IS NOT NULL AND ingestion_timestamp IS NOT NULL AND snapshot_date IS NOT NULL)
SELECT r.row_id, known.plan, known.country FROM ratings r JOIN inst ON k = r.row_id JOIN known ON r.user_id = known.user_id AND rec <= us
QUALIFY row_number() OVER (PARTITION BY r.row_id ORDER BY snapshot_date DESC, rec DESC, tie DESC) = 1"""
SQL_P6_FOUND = f"""WITH {_RATED}, {instants_in_sql("users", "row_id", "signup_date", "signed", True)}
SELECT 'ratings' AS table_name, k AS row_id, us AS utc_us FROM inst UNION ALL SELECT 'users', k, us FROM signed"""
SQL_P6_READINGS = f"""WITH {_RATED}, x AS (SELECT r.feed_id, i.us, CASE WHEN i.k IS NULL THEN 'none' WHEN regexp_full_match(s, '[0-9]{{8,19}}') THEN CASE WHEN l.k IS NULL THEN 'epoch' ELSE 'packed' END
WHEN regexp_matches(s, '^[0-9]{{1,4}}/') THEN t.date_order ELSE 'plain' END AS reading FROM ratings r JOIN inst_s t ON t.k = r.row_id LEFT JOIN inst i ON i.k = r.row_id LEFT JOIN inst_l l ON l.k = r.row_id)
SELECT feed_id, reading, count(*) AS rows, count(us) AS values FROM x GROUP BY ALL"""
_ARRIVED = f"""{_RATED}, a AS (SELECT row_id, us, epoch_us(ingestion_timestamp) - us AS lag, CAST(rating AS DOUBLE) AS v, strftime(make_timestamp(us), '%Y-%m-%d') AS event_day
FROM ratings JOIN inst ON k = row_id WHERE ingestion_timestamp IS NOT NULL)"""
SQL_P7_FOUND = f"""WITH {_ARRIVED} SELECT row_id, event_day, CASE WHEN lag > {lateness.K_US} THEN 'too_late' ELSE 'late' END AS verdict FROM a WHERE lag > {lateness.ON_TIME_US}"""
SQL_P7_DAILY = f"""WITH {_ARRIVED}, i AS (SELECT * FROM a WHERE lag <= {lateness.K_US}),
v AS (SELECT *, CAST(v > lag(v) OVER (PARTITION BY event_day ORDER BY us, row_id) AS INT) AS up FROM i WHERE v IS NOT NULL),
w AS (SELECT event_day, round(avg(v), 6) AS avg_value, first(v ORDER BY us, row_id) AS first_value, last(v ORDER BY us, row_id) AS last_value, CAST(coalesce(sum(up), 0) AS BIGINT) AS ups FROM v GROUP BY 1)
SELECT event_day, n, avg_value, first_value, last_value, coalesce(ups, 0) AS ups FROM (SELECT event_day, count(*) AS n FROM i GROUP BY 1) LEFT JOIN w USING (event_day)"""
SQL_P7_REVISIONS = f"""WITH {_ARRIVED}, g AS (SELECT event_day, CAST(greatest(0, ceil(CAST(lag AS DOUBLE) / {lateness.DAY_US}) - 1) AS INT) AS lag_day, count(*) AS n, sum(v) AS total, count(v) AS rated FROM a WHERE lag <= {lateness.K_US} GROUP BY ALL)
SELECT event_day, lag_day, CAST(sum(n) OVER w AS BIGINT) AS n, round(sum(total) OVER w / nullif(sum(rated) OVER w, 0), 6) AS avg_value, lead(lag_day) OVER (PARTITION BY event_day ORDER BY lag_day) IS NULL OR lag_day >= {lateness.K_US // lateness.DAY_US - 1} AS final
FROM g WINDOW w AS (PARTITION BY event_day ORDER BY lag_day)"""


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        p1_found, p1_report, p2_found, p2_genre_counts, p3_found, p3_loaded, p3_report, p3_broken_at, p4_found, p4_changes, p5_found,
        p6_found, p6_readings, p7_found, p7_daily, p7_revisions,
    )
}
SQL = {
    "p2_found": SQL_P2_FOUND, "p2_genre_counts": SQL_P2_COUNTS,
    "p1_found": SQL_P1_FOUND, "p1_report": SQL_P1_REPORT, "p3_found": SQL_P3_FOUND, "p3_report": SQL_P3_REPORT, "p3_loaded": SQL_P3_LOADED,
    "p4_found": SQL_P4_FOUND, "p4_changes": SQL_P4_CHANGES, "p5_found": SQL_P5_FOUND, "p6_found": SQL_P6_FOUND, "p6_readings": SQL_P6_READINGS, "p7_found": SQL_P7_FOUND, "p7_daily": SQL_P7_DAILY,
    "p7_revisions": SQL_P7_REVISIONS,
}
