"""Problems 1 to 7: operators against brute force, and the odd inputs each must bear."""

import csv
import datetime as dt
import io
import random
import re
from zoneinfo import ZoneInfo

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import timeparse as tp
from millrace.operators import asof, bad_rows, history, instants, lateness, orphans, packed_values
from millrace.util import range_key, spread

DAY = 86_400_000_000
UTC = dt.timezone.utc


def us(text):
    return int(dt.datetime.fromisoformat(text).replace(tzinfo=UTC).timestamp() * 1_000_000)


def ts(text):
    return dt.datetime.fromisoformat(text).replace(tzinfo=UTC) if text else None


# --- ranges


def test_range_key_is_monotone_and_complete(spark):
    df = spark.range(0, 1000).withColumn("g", range_key(F.col("id"), [9, 99, 500]))
    got = {r["g"]: (r["a"], r["b"]) for r in df.groupBy("g").agg(F.min("id").alias("a"), F.max("id").alias("b")).collect()}
    assert got == {0: (0, 9), 1: (10, 99), 2: (100, 500), 3: (501, 999)}


# --- 1


def test_small_tables_are_spread_and_large_ones_left(spark, tmp_path):
    spark.range(1000).withColumn("x", F.col("id")).coalesce(1).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange RoundRobin" in plan(spread(t)) and spread(t).count() == 1000
    assert "ReadSchema: struct<x:bigint>" in plan(spread(t).select("x")).replace("\n", " ")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1b")
        assert "Exchange" not in plan(spread(t))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def _orphans(spark, refs, parents, **kw):
    r = spark.createDataFrame(refs, "row_id bigint, k bigint, at timestamp, g int, state string")
    p = spark.createDataFrame(parents, "key bigint, seen_us bigint, gone_us bigint")
    return sorted((x["row_id"], x["period"], x["state"]) for x in orphans.orphan_rows(r, "at", "row_id", {"t": ("k", p)}, **kw).collect())


def test_orphan_states_in_order(spark):
    at = ts("2024-03-05T00:00:00")
    parents = [(1, us("2024-01-01"), None), (2, us("2024-03-05T00:00:01"), None), (3, us("2024-01-01"), us("2024-03-05")), (4, us("2024-04-01"), us("2024-02-01")), (5, None, None)]
    refs = [(10, 1, at, 0, "x"), (11, 2, at, 0, "x"), (12, 3, at, 0, "x"), (13, 4, at, 0, None), (14, 9, at, 0, "x"), (15, None, at, 0, "x"), (16, 9, None, 0, "x"), (17, 2, None, 0, "x"), (14, 9, at, 0, "x")]
    want = [(11, "2024-03", "late"), (12, "2024-03", "deleted"), (13, "2024-03", "late"), (14, "2024-03", "missing"), (14, "2024-03", "missing"), (16, "", "missing")]
    assert [x for x in _orphans(spark, refs, parents) if x[0] != 5] == want
    assert _orphans(spark, refs[:1], []) == [(10, "2024-03", "missing")]
    assert _orphans(spark, [], parents) == []


def test_orphans_with_a_hot_key_match_brute_force(spark):
    rnd = random.Random(3)
    parents = [(k, us("2024-01-01") + rnd.randrange(0, 300) * DAY, rnd.choice([None, us("2024-06-01") + rnd.randrange(0, 200) * DAY])) for k in range(0, 400, 2)]
    refs = [(i, 8 if i % 3 == 0 else rnd.randrange(0, 420), dt.datetime(2024, 1, 1, tzinfo=UTC) + dt.timedelta(days=rnd.randrange(0, 400)), 0, "") for i in range(3000)]
    known = {k: (s, g) for k, s, g in parents}
    want = []
    for i, k, at, *_ in refs:
        t = int(at.timestamp() * 1_000_000)
        s, g = known.get(k, (None, None))
        state = "missing" if k not in known else "late" if s > t else "deleted" if g is not None and g <= t else None
        if state:
            want.append((i, f"{at:%Y-%m}", state))
    assert _orphans(spark, refs, parents, parents_per_range=20, rows_per_group=100) == sorted(want)


def test_parents_from_snapshots(spark):
    d = dt.date
    rows = [(1, d(2024, 1, 1), ts("2024-01-02")), (1, d(2024, 3, 1), ts("2024-03-02")), (2, d(2024, 1, 1), ts("2024-01-05")), (None, d(2024, 2, 1), ts("2024-02-02")), (3, None, ts("2024-02-02"))]
    x = orphans.parents_from_snapshots(spark.createDataFrame(rows, "u bigint, s date, t timestamp"), "u", "s", "t")
    assert {r["key"]: (r["seen_us"], r["gone_us"]) for r in x.collect()} == {1: (us("2024-01-02"), None), 2: (us("2024-01-05"), us("2024-02-01")), 3: (us("2024-02-02"), None)}


# --- 2

CASES = {
    "Drama": ["Drama"], '["The \\"B\\" Reel", "Spy"]': ['The "B" Reel', "Spy"], '"""Cozy"" Mystery"': ['"Cozy" Mystery'], "Children's|Satire": ["Children's", "Satire"],
    ", ,": [], "'Sports; Team'|Space Opera": ["Sports; Team", "Space Opera"], "“Children's”;R&B": ["Children's", "R&B"], "A | B, C": ["A", "B", "C"], "": [], "  ": [], "|": [],
    "['Western', 'Rock Musical']": ["Western", "Rock Musical"], '"unclosed | a': ['"unclosed', "a"], "A｜B、C；D": ["A", "B", "C", "D"], "(Drama)": ["Drama"], "[]": [],
    '["Rural, Slice of Life"]': ["Rural, Slice of Life"], "'Rock ''n'' Roll'": ["Rock 'n' Roll"], "A||B|": ["A", "B"], "Stop-Motion": ["Stop-Motion"],
}


def test_tokenizer_cases():
    assert dict(zip(CASES, packed_values.tokenize(list(CASES)), strict=True)) == CASES
    assert packed_values.tokenize(["A (B|C)|D"], nested=True) == [["A (B|C)", "D"]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab c-&|,;\"'“”\\", min_size=1, max_size=8), min_size=1, max_size=5))
def test_quoted_values_round_trip(values):
    values = [v for v in values if v.strip()]
    packed = "|".join('"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"' for v in values)
    assert packed_values.tokenize([packed])[0] == [v.strip() for v in values]


def test_brackets_within_a_value_hold_it_together():
    cases = {
        "Action (a|b)|Drama": ["Action (a|b)", "Drama"], "x (a|b": ["x (a", "b"], "a)|b": ["a)", "b"], "(a|b]|c)|d": ["(a|b]|c)", "d"], "[a|(b|c)]": ["a", "(b|c)"],
        "((a|b)|c": ["((a|b)", "c"], '"(a"|b)|c': ["(a", "b)", "c"], "a (b [c|d) e]|f": ["a (b [c|d) e]", "f"], "(a, b), c": ["(a, b)", "c"],
    }
    assert packed_values.tokenize(list(cases)) == list(cases.values())
    assert packed_values.tokenize(["Action (a|b)|Drama"], nested=False) == [["Action (a", "b)", "Drama"]]


def test_split_packed_odd_inputs(spark):
    df = spark.createDataFrame([(1, "a|b", "x"), (2, None, "x"), (3, "", None), (1, "a|b", "x"), (4, "|".join(["w"] * 3000), "x")], "row_id bigint, genres string, genre_note string")
    out = packed_values.split_packed(df, "genres", "pos", "genre", keep=["row_id"]).groupBy("row_id").count().collect()
    assert {r["row_id"]: r["count"] for r in out} == {1: 4, 4: 3000}
    assert packed_values.split_packed(df.limit(0), "genres").count() == 0
    clash = packed_values.split_packed(df.withColumnRenamed("genre_note", "POS"), "genres", "pos", "genre")
    assert clash.columns == ["row_id", "pos", "genre"] and {r["pos"] for r in clash.filter("row_id = 1").collect()} == {1, 2}


# --- 3


def _reason(line):
    """Field by field, as the rules say."""
    if line is None:
        return "column_count"
    line = re.sub(r"(\r\n|\r|\n)\Z", "", line)
    fields, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            j = i + 1
            while True:
                j = line.find('"', j)
                if j < 0:
                    return "broken_quoting"
                if line[j + 1 : j + 2] == '"':
                    j += 2
                    continue
                break
            fields.append(line[i + 1 : j].replace('""', '"'))
            i = j + 1
            if i < len(line) and line[i] != ",":
                return "broken_quoting"
        else:
            j = line.find(",", i)
            j = len(line) if j < 0 else j
            if '"' in line[i:j]:
                return "broken_quoting"
            fields.append(line[i:j])
            i = j
        if i >= len(line):
            break
        i += 1
    if len(fields) != 4:
        return "column_count"
    a, b, c = (f.strip(" \t") for f in fields[:3])
    ok = all(re.fullmatch("[0-9]+", x) and 1 <= int(x) <= 2147483647 for x in (a, b)) and re.fullmatch(r"[0-9]+(\.[0-9]+)?", c) and 1 <= float(c) <= 5
    return None if ok else "invalid_value"


LINES = [
    "1,2,3.5,x", '"1","2","3","a, b"', '1,2,5,"a ""q"" b"', '1,2,3,"a\nb"', "1,2,3,x\r", " 1 ,\t2,4.0 ,", "1,2,3", "1,2,3,4,5", "", None, ",,,", "0,2,3,x", "2147483647,1,1,x", "2147483648,1,1,x",
    "007,1,5.000,x", "1,2,5.01,x", "1,2,0.99,x", "1,2,+4,x", "1,2,1e0,x", "1,2,4.,x", "١,2,3,x", "1 ,2,3,x", '1,"2,3,x', '1,2",3,x', '"1"2,2,3,x', ' "1",2,3,x', '1,2,3,"x" ', '"",1,2,x', "a" * 20000,
]


def test_bad_rows_match_a_field_by_field_parser(spark):
    rnd = random.Random(5)
    lines = LINES + ["".join(rnd.choice('1209,,,"" .\r\nx') for _ in range(rnd.randrange(1, 14))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(lines)), "line_id bigint, raw_line string")
    got = {r["line_id"]: r["reason"] for r in bad_rows.classify(df, "raw_line").collect()}
    assert [(lines[i], got[i]) for i in got if got[i] != _reason(lines[i])] == []


def test_loaded_values_and_first_broken_field(spark):
    df = spark.createDataFrame([(1, '"1", 2 ,"4.5","a ""b"", c"', "n"), (2, "1,x,9,z", None), (3, "1,2,3,x\r\n", "n")], "line_id bigint, raw_line string, note string")
    rows = {r["line_id"]: (r["user_id"], r["movie_id"], r["rating"], r["rated_at"]) for r in bad_rows.loaded(df, "raw_line").collect()}
    assert rows == {1: (1, 2, 4.5, 'a "b", c'), 3: (1, 2, 3.0, "x")}
    assert next(csv.reader(io.StringIO('"1", 2 ,"4.5","a ""b"", c"')))[3] == rows[1][3]
    assert [(r["line_id"], r["broken_field"], r["note"]) for r in bad_rows.rejected(df, "raw_line").collect()] == [(2, "movie_id", None)]
    assert bad_rows.classify(df.limit(0), "raw_line").count() == 0
    clash = df.withColumn("reason", F.lit("")).withColumn("user_id", F.lit("?"))
    assert bad_rows.rejected(clash, "raw_line").first()["reason"] == "invalid_value"
    assert {r["user_id"] for r in bad_rows.loaded(clash, "raw_line").collect()} == {1}


# --- 4


def _history(rows):
    """Snapshot by snapshot, as the rule says."""
    best = {}
    for row_id, snap, user, loaded, c, p in rows:
        if user is not None and snap is not None:
            best[user, snap] = max(best.get((user, snap), (dt.datetime.min.replace(tzinfo=UTC), -1)), (loaded, row_id, c, p), key=lambda x: x[:2])
    dates = sorted({s for _, s in best})
    out = []
    for user in {u for u, _ in best}:
        run = None
        for i, d in enumerate([*dates, None]):
            state = best.get((user, d))
            value = state[2:] if state else None
            if run and (value != run[1] or d is None):
                out.append((user, run[0].isoformat(), d.isoformat() if d else "9999-12-31", *run[1]))
                run = None
            if value and not run:
                run = (d, value)
    return sorted(out, key=str)


def test_history_matches_brute_force(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(1200):
        snap = dt.date(2024, rnd.randrange(1, 8), 1) if rnd.random() > 0.02 else None
        user = 1 if i % 3 == 0 else rnd.choice([None, *range(2, 40)])
        rows.append((i, snap, user, ts("2024-09-01") + dt.timedelta(hours=rnd.randrange(0, 40)), rnd.choice(["US", "GB", None]), rnd.choice(["lite", None])))
    df = spark.createDataFrame(rows, "row_id bigint, snap date, user bigint, loaded timestamp, country string, plan string").withColumn("key", F.lit("clash"))
    h = history.snapshot_history(df, "user", "snap", "loaded", ["country", "plan"], "row_id")
    got = sorted([(r["key"], r["valid_from"].isoformat(), r["valid_to"].isoformat(), r["country"], r["plan"]) for r in h.collect()], key=str)
    assert got == _history(rows)
    assert history.snapshot_history(df.limit(0), "user", "snap", "loaded", ["country", "plan"], "row_id").count() == 0


def test_change_events(spark):
    d = dt.date
    rows = [(1, d(2024, 1, 1), "a"), (1, d(2024, 2, 1), "b"), (2, d(2024, 1, 1), None), (2, d(2024, 3, 1), None)]
    df = spark.createDataFrame(rows, "key bigint, snap date, v string")
    got = sorted((r["key"], str(r["at"]), r["op"]) for r in history.changes(df, ["v"]).collect())
    assert got == [(1, "2024-01-01", "inserted"), (1, "2024-02-01", "changed"), (1, "2024-03-01", "deleted"), (2, "2024-01-01", "inserted"), (2, "2024-02-01", "deleted"), (2, "2024-03-01", "inserted")]


# --- 5


def test_as_known_matches_brute_force_with_hot_keys(spark):
    rnd = random.Random(11)
    known = [(rnd.choice([None, 1, *range(1, 30)]), rnd.choice([None, *range(100)]), rnd.randrange(0, 6), i, rnd.choice(["x", "y", None]), f"c{i}") for i in range(400)]
    events = [(i, 1 if i % 3 == 0 else rnd.choice([None, *range(1, 35)]), rnd.choice([None, *range(-5, 110)])) for i in range(2000)]
    want = []
    for i, k, t in events:
        c = [(v, r, n, p, q) for kk, r, v, n, p, q in known if k is not None and t is not None and kk == k and r is not None and r <= t]
        if c:
            want.append((i, *max(c, key=lambda x: x[:3])[3:]))
    e = spark.createDataFrame(events, "row_id bigint, key bigint, at_us bigint").withColumn("plan", F.lit("clash"))
    k = spark.createDataFrame(known, "key bigint, rec_us bigint, valid int, tie bigint, plan string, country string")
    got = sorted((r["row_id"], r["plan"], r["country"]) for r in asof.as_known(e, k, ["plan", "country"], rows_per_bucket=200).collect())
    assert got == sorted(want)
    assert asof.as_known(e.limit(0), k, ["plan", "country"]).count() == 0
    assert asof.as_known(e, k.limit(0), ["plan", "country"]).count() == 0


# --- 6


def _local(y, m, d, h=0, mi=0, s=0, micro=0, zone="UTC"):
    """The rule for clocks, by Python's own zones."""
    z = ZoneInfo(zone)
    wall = dt.datetime(y, m, d, h, mi, s, micro)
    return int((wall.replace(tzinfo=z, fold=0) - dt.datetime(1970, 1, 1, tzinfo=UTC)) / dt.timedelta(microseconds=1))


INSTANTS = [  # text, zone, order, expected
    ("2024-01-03 19:07:45", "America/New_York", "MDY", _local(2024, 1, 3, 19, 7, 45, zone="America/New_York")),
    ("2024-01-04T03:50:44Z", "Asia/Tokyo", "YMD", us("2024-01-04T03:50:44")),
    ("2024-01-04T10:21:08+01:00", "Asia/Tokyo", "YMD", us("2024-01-04T09:21:08")),
    ("2024-01-04 13:13:25.484633+0530", "UTC", "DMY", us("2024-01-04T07:43:25.484633")),
    ("01/03/2024 23:28:52", "UTC", "MDY", us("2024-01-03T23:28:52")), ("01/03/2024 23:28:52", "UTC", "DMY", us("2024-03-01T23:28:52")),
    ("2024/1/12 9:09 PM", "UTC", "YMD", us("2024-01-12T21:09:00")), ("12/1/2024 12:05 AM", "UTC", "DMY", us("2024-01-12T00:05:00")), ("25/05/12", "UTC", "YMD", us("2025-05-12")),
    ("04.01.2024 06:57", "Europe/Berlin", "MDY", _local(2024, 1, 4, 6, 57, zone="Europe/Berlin")), ("Thu, 04 Jan 2024 19:22:14 -0800", "UTC", "DMY", us("2024-01-05T03:22:14")),
    ("10 Jan 2024 03:00:31 UTC", "Asia/Tokyo", "DMY", us("2024-01-10T03:00:31")), ("10 Mar 2024 03:17:01 EDT", "UTC", "DMY", us("2024-03-10T07:17:01")), ("24 Apr 2025 17:25:19 PDT", "UTC", "DMY", us("2025-04-25T00:25:19")),
    ("Jan 10, 2024 7:19:48 pm", "UTC", "DMY", us("2024-01-10T19:19:48")), ("2024-01-06T01:11:04[Europe/Berlin]", "UTC", "DMY", us("2024-01-06T00:11:04")), ("2024-01-06T01:11:04[No/Where]", "UTC", "DMY", None),
    ("20240104020115", "America/New_York", "DMY", _local(2024, 1, 4, 2, 1, 15, zone="America/New_York")), ("20240104T022137Z", "Asia/Tokyo", "DMY", us("2024-01-04T02:21:37")), ("20230427", "UTC", "DMY", us("2023-04-27")),
    ("1704353437", "Asia/Tokyo", "DMY", 1704353437_000000), ("1704354320130", "UTC", "DMY", 1704354320130_000), ("1704475879613621", "UTC", "DMY", 1704475879613621), ("1704475879613621123", "UTC", "DMY", 1704475879613621),
    ("  2024-01-05 ", "Asia/Kolkata", "DMY", us("2024-01-04T18:30:00")), ("12-JUL-2023", "UTC", "DMY", us("2023-07-12")), ("2024-01-05T07:20:14.552", "UTC", "DMY", us("2024-01-05T07:20:14.552")),
    ("2024-02-30", "UTC", "DMY", None), ("2024-07-09 27:61:00", "UTC", "DMY", None), ("31/31/2024 08:00", "UTC", "DMY", None), ("13/13/2024", "UTC", "MDY", None), ("25/12/2024", "UTC", "MDY", None),
    ("yesterday", "UTC", "DMY", None), ("", "UTC", "DMY", None), (None, "UTC", "DMY", None), ("0000-00-00", "UTC", "DMY", None), ("x" * 30000, "UTC", "DMY", None), ("20241332", "UTC", "DMY", None),
    ("2024-11-03 01:29:45", "America/New_York", "MDY", us("2024-11-03T05:29:45")),  # twice: the earlier
    ("2024-03-10 02:30:00", "America/New_York", "MDY", us("2024-03-10T07:30:00")),  # skipped: the offset before
]


def _read(spark, cases, date_only=False, **kw):
    df = spark.createDataFrame([(i, t, f"{z}/{o}") for i, (t, z, o, *_) in enumerate(cases)], "row_id bigint, txt string, feed_id string")
    feeds = spark.createDataFrame(sorted({(f"{z}/{o}", z, o) for _, z, o, *_ in cases}), "feed_id string, time_zone string, date_order string")
    return {r["row_id"]: (r["utc_us"], r["reading"]) for r in instants.with_instants(df, feeds, "txt", date_only, keep=["row_id"], **kw).collect()}


def test_instants(spark):
    got = _read(spark, INSTANTS)
    assert [(c, got[i][0]) for i, c in enumerate(INSTANTS) if got[i][0] != c[3]] == []


def test_dates_only(spark):
    cases = [("2023-11-05", "Asia/Tokyo", "MDY", "2023-11-05"), ("2023-08-20T04:15:56+09:00", "UTC", "MDY", "2023-08-19"), ("20230427", "Asia/Tokyo", "MDY", "2023-04-27"), ("1697384956", "Asia/Tokyo", "MDY", "2023-10-15"),
             ("2022-10-10 02:04:09", "Asia/Tokyo", "MDY", "2022-10-09"), ("05/01/23", "UTC", "MDY", "2023-05-01"), ("Apr 18, 2022", "America/New_York", "MDY", "2022-04-18")]
    got = _read(spark, cases, date_only=True)
    assert [got[i][0] for i in range(len(cases))] == [us(c[3]) for c in cases]


def test_undeclared_order_is_fitted_and_doubt_is_marked(spark):
    feeds = spark.createDataFrame([("us", "UTC", None), ("eu", "UTC", None), ("??", "UTC", None)], "feed_id string, time_zone string, date_order string")
    rows = [(i, f"{m:02d}/{d:02d}/2024", "us") for i, (m, d) in enumerate([(3, 25), (4, 30), (5, 6), (12, 31), (1, 2)] * 9)]
    rows += [(100 + i, f"{d:02d}/{m:02d}/2024", "eu") for i, (m, d) in enumerate([(3, 25), (4, 30), (5, 6), (12, 31), (1, 2)] * 9)]
    rows += [(300, "01/02/2024", "??"), (301, "01/02/2024", None)]
    df = spark.createDataFrame(rows, "row_id bigint, txt string, feed_id string")
    got = {r["row_id"]: (r["utc_us"], r["reading"]) for r in instants.with_instants(df, feeds, "txt", keep=["row_id"]).collect()}
    assert got[2] == (us("2024-05-06"), "MDY") and got[102] == (us("2024-05-06"), "DMY")
    assert got[300] == (None, "ambiguous") and got[301] == (None, "ambiguous")
    assert instants.with_instants(df.limit(0), feeds, "txt", keep=["row_id"]).count() == 0


def test_instants_of_tables_with_clashing_names(spark):
    feeds = spark.createDataFrame([("f", "UTC", "DMY")], "feed_id string, time_zone string, date_order string")
    df = spark.createDataFrame([(1, "2024-01-05", "f", 7, "x", "z")], "row_id bigint, reading string, feed_id string, utc_us int, time_zone string, _t string")
    r = instants.with_instants(df, feeds, "reading").first()
    assert (r["utc_us"], r["reading"], r["time_zone"], r["_t"], r["row_id"]) == (us("2024-01-05"), "plain", "x", "z", 1)


def test_parser_keeps_length_on_odd_batches():
    for texts in ([], [None], [None, "", "2024-01-01"], ["x"]):
        assert len(tp.parse(pa.array(texts, pa.string()))) == len(texts)


# --- 7


def test_admission_bounds(spark):
    rows = [(i, e, e + lag) for i, (e, lag) in enumerate([(0, 0), (0, DAY), (0, DAY + 1), (0, 7 * DAY), (0, 7 * DAY + 1), (5 * DAY, -1)])] + [(9, None, 5), (10, 5, None)]
    df = spark.createDataFrame(rows, "row_id bigint, e bigint, a bigint").withColumns({"verdict": F.lit("clash"), "v": F.lit(1), "event_us": F.lit(0)})
    got = {r["row_id"]: (r["event_day"], r["verdict"]) for r in lateness.reordered(lateness.arrivals(df, F.col("e"), F.col("a"), "row_id", "v")).collect()}
    day = "1970-01-01"
    assert got == {0: (day, "on_time"), 1: (day, "on_time"), 2: (day, "late"), 3: (day, "late"), 4: (day, "too_late"), 5: ("1970-01-06", "on_time")}


def test_ordered_daily_and_revisions_match_brute_force(spark):
    rnd = random.Random(2)
    rows = [(i, (0 if i % 3 == 0 else rnd.randrange(0, 5)) * DAY + rnd.randrange(0, 50), rnd.choice([None, 1.0, 2.0, 3.0, 4.5]), rnd.randrange(0, 9) * DAY) for i in range(900)]
    df = spark.createDataFrame(rows, "row_id bigint, e bigint, rating double, lag bigint")
    a = lateness.arrivals(df, F.col("e"), F.col("e") + F.col("lag"), "row_id", "rating")
    got = {r["event_day"]: r for r in lateness.ordered_daily(a).collect()}
    for d in range(5):
        x = sorted((e, i, v) for i, e, v, lag in rows if e // DAY == d and lag <= 7 * DAY)
        v = [z for *_, z in x if z is not None]
        r = got[f"1970-01-0{d + 1}"]
        assert (r["n"], r["first_value"], r["last_value"], r["ups"]) == (len(x), v[0], v[-1], sum(q > p for p, q in zip(v, v[1:], strict=False)))
        assert r["avg_value"] == pytest.approx(sum(v) / len(v))
    rev = lateness.revisions(a).collect()
    for r in rev:
        d = int(r["event_day"][-2:]) - 1
        assert r["n"] == sum(e // DAY == d and max(0, -(-lag // DAY) - 1) <= r["lag_day"] and lag <= 7 * DAY for i, e, v, lag in rows)
    assert {r["event_day"]: r["n"] for r in rev if r["final"]} == {d: r["n"] for d, r in got.items()}
    late = lateness.reordered(a).groupBy("verdict").count().collect()
    assert {r["verdict"]: r["count"] for r in late} == {k: sum(lo < lag <= hi for *_, lag in rows) for k, lo, hi in (("on_time", -1, DAY), ("late", DAY, 7 * DAY), ("too_late", 7 * DAY, 99 * DAY))}
    none = lateness.arrivals(df.limit(0), F.col("e"), F.col("e"), "row_id", "rating")
    assert [x.count() for x in (lateness.ordered_daily(none), lateness.revisions(none), lateness.reordered(none))] == [0, 0, 0]


def test_the_buffer_releases_in_order_whatever_the_batches():
    rnd = np.random.default_rng(5)
    for size in (1, 7, 1000):
        e = rnd.integers(0, 60 * DAY, 1000)
        a = np.sort(e + rnd.integers(-DAY, 9 * DAY, 1000))
        e = rnd.permutation(e)
        rows = {"event_us": e, "row_id": np.arange(1000), "arrival_us": a, "value": rnd.random(1000)}
        buffer, out, refused, most = lateness.SlackBuffer(7 * DAY), [], 0, 0
        for i in range(0, 1000, size):
            released, no = buffer.push({c: v[i : i + size] for c, v in rows.items()})
            out += released["event_us"].tolist()
            refused, most = refused + len(no["row_id"]), max(most, len(buffer.held()["row_id"]))
            assert (buffer.held()["event_us"] + 7 * DAY >= buffer.clock).all()
        out += buffer.flush()["event_us"].tolist()
        assert out == sorted(e[a - e <= 7 * DAY].tolist()) and refused == (a - e > 7 * DAY).sum() and not len(buffer.held()["row_id"])



def test_the_broken_field_is_told_for_every_reason(spark):
    lines = ['1,2,3.5,x', '1,"2,3.5,x', '1,2,3.5,a"b', "1,2", "1,2,3.5,x,y", '1,2,3.5,x,"y', "1,z,3.5,x", None]
    df = spark.createDataFrame(list(enumerate(lines)), "line_id int, raw_line string")
    got = {r["line_id"]: (r["reason"], r["broken_at"], r["broken_field"]) for r in bad_rows.rejected(df, "raw_line").collect()}
    assert got == {
        1: ("broken_quoting", 2, "movie_id"), 2: ("broken_quoting", 4, "rated_at"), 3: ("column_count", 3, "rating"), 4: ("column_count", 5, None),
        5: ("broken_quoting", 5, None), 6: ("invalid_value", 2, "movie_id"), 7: ("column_count", 1, "user_id"),
    }
