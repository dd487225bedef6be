"""Instants in SQL, for comparison: what texts of the feeds mean, by the rules alone, without a fitted model.

The ways of writing are those of ``timeparse``; everything after them, validity, zones, hours
that occur twice or never, is said again in SQL.
"""

from __future__ import annotations

from millrace.functions import timeparse as tp

_PARTS = ("y", "m", "d", "hh", "mi", "ss", "frac", "half", "zone", "region")


def _branch(pattern: str, rows: str) -> str:
    """Rows written in one way, with their parts as text."""
    names = [x.split(">")[0] for x in pattern.split("(?P<")[1:]]
    quoted = ", ".join(f"'{n}'" for n in names)
    part = {n: f"g.{n}" for n in names}
    if "name" in part:
        months = ", ".join(f"'{m}'" for m in tp.MONTHS)
        part["m"] = f"CAST(list_position([{months}], lower(g.name[1:3])) AS VARCHAR)"
    if "s1" in part:
        part["y"] = "CASE date_order WHEN 'YMD' THEN g.s1 ELSE g.s3 END"
        part["m"] = "CASE date_order WHEN 'MDY' THEN g.s1 ELSE g.s2 END"
        part["d"] = "CASE date_order WHEN 'MDY' THEN g.s2 WHEN 'DMY' THEN g.s1 ELSE g.s3 END"
    cols = ", ".join(f"{part.get(p, 'NULL')} AS {p}" for p in _PARTS)
    text = pattern.replace("'", "''")
    return f"SELECT k, z, {cols} FROM (SELECT k, z, date_order, regexp_extract(s, '{text}', [{quoted}]) AS g FROM {rows} WHERE regexp_matches(s, '{text}'))"


def instants(table: str, key: str, text: str, name: str, dates: bool = False) -> str:
    """CTEs that end in ``name (k, us)``: per readable row of ``table`` its key and UTC microseconds."""
    n = name
    abbreviations = ", ".join(f"('{k}', {v})" for k, v in tp.ABBREVIATIONS.items())
    written = "\n UNION ALL ".join(_branch(p, f"{n}_s") for p in tp._WRITTEN)
    at_day = "wall IS NOT NULL AND dated" if dates else "false"
    us = "epoch_us(utc)" if not dates else f"CASE WHEN {at_day} THEN epoch_us(date_trunc('day', wall)) ELSE epoch_us(date_trunc('day', utc)) END"
    return f"""{n}_s AS (SELECT {key} AS k, coalesce(time_zone, 'UTC') AS z, date_order, regexp_replace({text}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS s FROM {table} LEFT JOIN feeds USING (feed_id)),
{n}_b AS (SELECT k, z, s, length(s) AS n FROM {n}_s WHERE regexp_full_match(s, '[0-9]{{8,19}}')),
{n}_o (ab, minutes) AS (VALUES {abbreviations}),
{n}_w AS ({written}),
{n}_p AS (SELECT k, z, nullif(zone, '') AS zone, nullif(region, '') AS region, coalesce(hh, '') = '' AS dated, upper(coalesce(half, '')) AS half, TRY_CAST(nullif(hh, '') AS INT) AS h,
 TRY_CAST(printf('%s-%s-%s', CASE length(y) WHEN 4 THEN y WHEN 2 THEN '20' || y END, CASE WHEN length(m) <= 2 THEN lpad(m, 2, '0') END, CASE WHEN length(d) <= 2 THEN lpad(d, 2, '0') END) AS DATE) AS day,
 coalesce(TRY_CAST(nullif(mi, '') AS INT), 0) AS mi, coalesce(TRY_CAST(nullif(ss, '') AS INT), 0) AS ss, CAST(rpad(coalesce(frac, ''), 6, '0')[1:6] AS INT) AS us FROM {n}_w),
{n}_h AS (SELECT *, CASE WHEN half = '' THEN coalesce(h, 0) WHEN h BETWEEN 1 AND 12 THEN h % 12 + CASE half WHEN 'P' THEN 12 ELSE 0 END END AS hour FROM {n}_p),
{n}_l AS (SELECT k, z, dated, region, CAST(day AS TIMESTAMP) + to_hours(hour) + to_minutes(mi) + to_seconds(ss) + to_microseconds(us) AS wall, zone IS NOT NULL AS zoned,
 CASE WHEN zone IS NULL THEN NULL WHEN zone[1] IN ('+', '-') THEN CASE WHEN hm <= 18 AND mm < 60 THEN CASE zone[1] WHEN '-' THEN -1 ELSE 1 END * (hm * 60 + mm) END ELSE minutes END AS off
 FROM (SELECT *, replace(zone[2:], ':', '') AS zd, CAST(CASE WHEN length(zd) <= 2 THEN zd ELSE zd[1:-3] END AS VARCHAR) AS hs, TRY_CAST(hs AS INT) AS hm, CASE WHEN length(zd) <= 2 THEN 0 ELSE TRY_CAST(zd[-2:] AS INT) END AS mm FROM {n}_h)
 LEFT JOIN {n}_o ON upper(zone) = ab WHERE day IS NOT NULL AND hour < 24 AND mi < 60 AND ss < 60
 UNION ALL SELECT k, z, n = 8, NULL, t, false, NULL FROM (SELECT *, try_strptime(rpad(s, 17, '0'), '%Y%m%d%H%M%S%g') AS t FROM {n}_b WHERE n IN (8, 12, 14, 17)) WHERE t IS NOT NULL AND year(t) BETWEEN 1990 AND 2099),
{n}_u AS (SELECT k, dated, wall, off, CASE WHEN region IS NULL THEN z WHEN region IN (SELECT name FROM pg_timezone_names()) THEN region END AS z FROM {n}_l WHERE NOT (zoned AND off IS NULL)),
{n}_c AS (SELECT *, timezone(coalesce(z, 'UTC'), wall) AS c FROM {n}_u),
{n}_d AS (SELECT *, timezone(z, c) AS back, timezone(z, c - INTERVAL 1 HOUR) AS twice, timezone(z, c - INTERVAL 1 DAY) - timezone('UTC', c - INTERVAL 1 DAY) AS before FROM {n}_c),
{n}_a AS (SELECT k, dated, wall, CASE WHEN off IS NOT NULL THEN wall - to_minutes(off) WHEN z IS NULL THEN NULL WHEN back <> wall THEN wall - before WHEN twice = wall THEN timezone('UTC', c - INTERVAL 1 HOUR)
 ELSE timezone('UTC', c) END AS utc FROM {n}_d
 UNION ALL SELECT k, false, NULL, make_timestamp(CASE WHEN n <= 10 THEN v * 1000000 WHEN n <= 13 THEN v * 1000 WHEN n <= 16 THEN v ELSE v // 1000 END)
 FROM (SELECT *, CAST(s AS BIGINT) AS v FROM {n}_b) WHERE n IN (9, 10, 12, 13, 15, 16, 18, 19) AND k NOT IN (SELECT k FROM {n}_l)),
{n} AS (SELECT k, {us} AS us FROM {n}_a WHERE utc IS NOT NULL)"""
