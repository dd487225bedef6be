"""Cleaning, ranking, star schema, metrics, upserts, quality and incremental state."""

import datetime as dt
import os
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from millrace import incremental
from millrace.functions import standard
from millrace.operators import ranking, upsert
from millrace.plans import catalogue, metrics, star
from millrace.quality import profile, reports, rules
from millrace.streaming import windows

SF = "/root/testdata/sf0.001"


# --- standardisation


def test_dates_in_three_formats(spark):
    df = spark.createDataFrame([("2024-01-15 10:30:00",), ("2024-03-20",), ("12/31/2024",), ("31/12/2024",), ("",), (None,)], "d string")
    got = [r["d"] for r in standard.standardize_dates(df, ["d", "absent"]).collect()]
    assert got == [dt.datetime(2024, 1, 15, 10, 30), dt.datetime(2024, 3, 20), dt.datetime(2024, 12, 31), None, None, None]


def test_countries(spark):
    df = spark.createDataFrame([("USA",), ("uk",), ("FR",), ("ger",), (" us",), (None,)], "c string")
    assert [r["c"] for r in standard.standardize_country_codes(df, "c").collect()] == ["US", "GB", "FR", "DE", " US", None]
    assert standard.standardize_country_codes(df, "absent") is df


# --- ranking


def test_deduplicate_is_deterministic(spark):
    df = spark.createDataFrame([(1, 10, 1, 3.0), (1, 10, 2, 5.0), (1, 10, 2, 4.0), (None, 1, 1, 1.0), (None, 1, 2, 2.0)], "u int, m int, t int, r double")
    got = sorted((r["u"] or 0, r["r"]) for r in ranking.deduplicate(df, ["u", "m"], [F.col("t").desc(), F.col("r").desc()]).collect())
    assert got == [(0, 2.0), (1, 5.0)]


@pytest.mark.parametrize("n", [0, 1, 4, 7, 500])
@pytest.mark.parametrize("hot", [False, True])
def test_global_ntile_equals_the_window_function(spark, n, hot):
    rnd = random.Random(n)
    rows = [(i, 5 if hot and i % 3 else rnd.choice([None, *range(20)])) for i in range(n)]
    df = spark.createDataFrame(rows, "id bigint, k bigint")
    got = {r["id"]: r["t"] for r in ranking.global_ntile(df, "k", "id", 5, "t", rows_per_range=40).collect()}
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    small, extra = divmod(n, 5)
    want = {}
    for p, (i, _) in enumerate(order):
        head = extra * (small + 1)
        want[i] = p // (small + 1) + 1 if p < head else extra + (p - head) // small + 1
    assert got == want


def test_results_do_not_depend_on_partitions(spark):
    f = catalogue.fact(spark, SF)
    first = sorted(map(str, metrics.rfm_segmentation(f).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert sorted(map(str, metrics.rfm_segmentation(f).collect())) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


# --- star and metrics


def test_facts_read_no_movies_and_metrics_no_users(spark):
    r = spark.createDataFrame([(1, 1, 10, 4.0, dt.datetime(2024, 1, 1))], "row_id long, user_id int, movie_id int, rating double, rated_at timestamp")
    u = spark.createDataFrame([(1, "free", "US", dt.date(2023, 1, 1))], "user_id long, plan string, country string, signup_date date")
    fact = star.fact_ratings(r, u)
    assert fact.columns == list(star.FACT) and fact.first()["days_since_signup"] == 365
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(fact).count("Join") == 1 and "Join" not in plan(metrics.daily_engagement(star.keyed_facts(r)))
    assert plan(metrics.daily_kpis(star.keyed_facts(r))).count("Join") == 1  # of the days with their newcomers


def test_the_latest_row_is_taken_before_the_shuffle(spark):
    r = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    plan = ranking.deduplicate(r, ["k"], [F.col("id").desc()])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.rindex("WindowGroupLimit") > plan.index("Exchange")


def test_genres(spark):
    df = spark.createDataFrame([(1, "Action|Comedy"), (2, "Drama"), (2, "Drama|"), (3, None), (4, "")], "movie_id int, genres string")
    assert star.movie_genres(df).count() == 3


def test_daily_and_monthly_totals_agree(spark):
    f = catalogue.fact(spark, SF).filter(F.col("rating_date").isNotNull()).cache()
    n = f.filter(F.col("rating").isNotNull()).count()
    for d in (metrics.daily_engagement(f), metrics.daily_kpis(f), metrics.weekly_kpis(f), metrics.weekly_kpis(f, True), metrics.monthly_kpis(f)):
        assert d.agg(F.sum("total_ratings")).first()[0] == n
    assert metrics.daily_kpis(f).agg(F.sum("new_raters")).first()[0] == f.select("user_id").distinct().count()
    f.unpersist()


def test_day_of_null_ratings_has_no_share(spark):
    f = spark.createDataFrame([(1, 1, dt.date(2024, 1, 1), None, None)], "user_id int, movie_id int, rating_date date, rating float, is_high_rating boolean")
    r = metrics.daily_engagement(f).first()
    assert r["total_ratings"] == 0 and r["high_rating_pct"] is None and r["low_ratings"] == 0


def test_top_movies_and_empty_tables(spark):
    f, m = catalogue.fact(spark, SF), catalogue.movies(spark, SF)
    top = metrics.top_movies_overall(f, m, 5).orderBy("rank").collect()
    assert [r["rank"] for r in top] == [1, 2, 3, 4, 5] and top[0]["total_ratings"] >= top[4]["total_ratings"]
    none = f.limit(0)
    for d in (metrics.top_movies_overall(none, m), metrics.rfm_segmentation(none), metrics.retention_cohorts(none, catalogue.users(spark, SF)), metrics.daily_engagement(none)):
        assert d.count() == 0


def test_recency_direction(spark):
    f = catalogue.fact(spark, SF).filter(F.col("rating_date").isNotNull())
    code, intent = metrics.rfm_segmentation(f), metrics.rfm_segmentation(f, True)
    least = lambda d: d.filter("r_score = 1").agg(F.max("recency_days")).first()[0]
    most = lambda d: d.filter("r_score = 5").agg(F.min("recency_days")).first()[0]
    assert least(code) <= most(code) and intent.filter("r_score = 1").agg(F.min("recency_days")).first()[0] >= intent.filter("r_score = 5").agg(F.max("recency_days")).first()[0]


# --- upserts


def _model_merge(target, source, newer):
    out = {r[0]: r for r in target if r[0] is not None}
    for k, v, t in source:
        if k is None:
            continue
        if k not in out:
            out[k] = (k, v, t)
        elif not newer or (t is not None and out[k][2] is not None and t >= out[k][2]):
            out[k] = (k, v, t)
    return sorted([*out.values(), *[r for r in target if r[0] is None]], key=str)


@pytest.mark.parametrize("seed", range(3))
def test_merge_matches_a_model(spark, seed):
    rnd = random.Random(seed)
    make = lambda: [(k, rnd.choice(["a", "b", None]), rnd.choice([None, 1, 2, 3])) for k in rnd.sample(range(20), 10)] + [(None, "n", 1)]
    t, s = make(), make()
    schema = "k int, v string, rated_at int"
    dt_, ds = spark.createDataFrame(t, schema), spark.createDataFrame(s, schema)
    for cols in (["v", "rated_at"], ["v"]):
        got = sorted([tuple(r) for r in upsert.merge(dt_, ds, ["k"], cols).collect()], key=str)
        want = _model_merge(t, s, "rated_at" in cols)
        if cols == ["v"]:
            old = {r[0]: r[2] for r in t if r[0] is not None}
            want = sorted([(k, v, old[k] if k in old else x) for k, v, x in want], key=str)
        assert got == want


def test_merge_with_deletes(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    s = spark.createDataFrame([(1, "x", True), (2, "y", False), (3, "z", None), (4, "new", True), (None, "n", False)], "k int, v string, gone boolean")
    got = sorted(tuple(r) for r in upsert.merge_with_deletes(t, s, ["k"], "gone", with_action=True).collect())
    assert got == [(2, "y", "update"), (3, "z", "update"), (4, "new", "insert")]
    assert tuple(upsert.action_counts(t, s, ["k"], "gone").first()) == (1, 2, 1)


def test_changes_are_null_safe(spark):
    o = spark.createDataFrame([(1, None, "x"), (2, "a", "x"), (3, "a", "x"), (None, "a", "x")], "k int, v string, w string")
    n = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (4, "b", "x"), (None, "b", "x")], "k int, v string, w string")
    got = sorted((r["k"], r["v"], r["cdc_operation"]) for r in upsert.detect_changes(o, n, ["k"], ["v", "w"]).collect())
    assert got == [(1, "a", "UPDATE"), (3, "a", "DELETE"), (4, "b", "INSERT")]
    assert {r["cdc_operation"] for r in upsert.detect_changes(o, n, ["k"], ["v", "w"], null_safe=False).collect()} == {"DELETE", "INSERT"}
    assert upsert.detect_changes(o, o, ["k"], ["v"]).count() == 0
    assert upsert.changes_by_kind(o, n, ["k"], [])["updates"].count() == 0


def test_scd2_keeps_unchanged_and_closes_changed(spark):
    schema = "user_id int, plan string, country string"
    load = lambda rows: spark.createDataFrame(rows, schema)
    day = lambda d: F.lit(f"2024-01-0{d}")
    h = upsert.scd2_first_load(load([(1, "a", "x"), (2, None, "x"), (3, "a", "x")]), day(1))
    h = upsert.apply_scd2(h, load([(1, "b", "x"), (2, "a", "x"), (4, "n", "x")]), "user_id", ["plan"], day(2))
    h = upsert.apply_scd2(h, load([(1, "b", "x"), (2, "a", "y"), (4, "n", "x")]), "user_id", ["plan"], day(3))
    got = sorted((r["user_id"], r["plan"] or "", str(r["scd_start_date"])[:10], str(r["scd_end_date"])[:10], r["is_current"]) for r in h.collect())
    assert got == [(1, "a", "2024-01-01", "2024-01-02", False), (1, "b", "2024-01-02", "None", True), (2, "", "2024-01-01", "2024-01-02", False), (2, "a", "2024-01-02", "None", True), (3, "a", "2024-01-01", "None", True), (4, "n", "2024-01-02", "None", True)]


# --- quality

ROWS = [(1, 10, 4.0, "a"), (1, 10, 0.5, "b"), (None, 11, 6.0, None), (2, 12, None, "c")]


def _table(spark):
    return spark.createDataFrame(ROWS, "user_id int, movie_id int, rating float, kind string")


def test_suite_statuses(spark):
    suite = [
        rules.Rule("not_null", ("user_id",)), rules.Rule("not_null", ("absent",)), rules.Rule("between", ("rating",), 1.0, 5.0), rules.Rule("between", ("absent",), 1, 2),
        rules.Rule("unique", ("user_id", "movie_id")), rules.Rule("unique", ("absent",)), rules.Rule("row_count", (), 1, 10), rules.Rule("row_count", (), 5), rules.Rule("column_exists", ("rating",)),
        rules.Rule("column_exists", ("absent",)), rules.Rule("in_set", ("kind",), values=("a", "b")), rules.Rule("in_set", ("absent",), values=("a",)), rules.Rule("max_null_pct", ("user_id",), high=30), rules.Rule("max_duplicate_pct", ("user_id", "movie_id"), high=10),
    ]
    r = rules.run_suite(_table(spark), suite, "t")
    assert [(o.status, o.failed_count) for o in r.outcomes] == [("failed", 1), ("failed", 1), ("failed", 2), ("skipped", 0), ("failed", 1), ("skipped", 0), ("passed", 0), ("failed", 1), ("passed", 0), ("failed", 1), ("failed", 1), ("skipped", 0), ("passed", 1), ("failed", 1)]
    assert r.success_pct == round(3 / 11 * 100, 1) and not r.ok
    assert rules.run_suite(_table(spark), []).success_pct == 100.0
    assert rules.run_suite(_table(spark).limit(0), suite[:3]).ok is False


def test_row_rules_share_one_scan(spark):
    suite = rules.compile_rules({"not_null": ["user_id", "movie_id", "rating"], "range": [{"column": "rating", "min": 1.0, "max": 5.0}], "thresholds": {"min_row_count": 1, "max_null_pct": 50}}, thresholds=True)
    plan = rules.measure(catalogue.table(spark, SF, "ratings"), suite)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and len(suite) == 8


def test_duplicates_two_ways(spark):
    t = spark.createDataFrame([(1,), (1,), (1,), (2,), (2,), (3,), (None,), (None,)], "k int")
    assert rules.duplicate_excess(t, ["k"]).first()[0] == 4 and rules.duplicate_groups(t, ["k"]).first()[0] == 3
    assert rules.duplicate_excess(t.limit(0), ["k"]).first()[0] == 0


def test_orphans_and_nulls(spark):
    a = spark.createDataFrame([(1,), (2,), (99,), (None,)], "k int")
    assert sorted(r["k"] or 0 for r in rules.orphan_keys(a, "k", a.filter("k < 3"), "k").collect()) == [0, 99]
    assert rules.null_counts(_table(spark), ["user_id", "movie_id", "absent"]).first().asDict() == {"user_id": 1, "movie_id": 0}


def test_rule_file_and_registry(spark, tmp_path):
    p = tmp_path / "rules.yaml"
    p.write_text("tables:\n  t:\n    not_null: [user_id]\n    unique: [[user_id, movie_id]]\n    thresholds: {min_row_count: 2}\n  other:\n    not_null: [x]\n")
    out = rules.run_all({"t": _table(spark)}, rules.load_rules(str(p)))
    assert list(out) == ["t"] and [o.status for o in out["t"].outcomes] == ["failed", "failed", "passed"]


def test_profile(spark):
    p = {r["column"]: r for r in profile.column_profile(_table(spark)).collect()}
    assert (p["user_id"]["nulls"], p["user_id"]["null_pct"], p["user_id"]["distinct_values"]) == (1, 25.0, 3)
    assert p["rating"]["mean"] == 3.5 and p["kind"]["mean"] is None
    top = profile.top_values(_table(spark), 1).filter("column = 'movie_id'").first()
    assert (top["value"], top["n"]) == ("10", 2)
    assert {r["distinct_values"] for r in profile.column_profile(_table(spark).limit(0)).collect()} == {0}


def test_reports_metrics_and_alerts(spark, tmp_path):
    bad = rules.run_suite(_table(spark), [rules.Rule("not_null", ("user_id",))], "t")
    good = rules.run_suite(_table(spark), [rules.Rule("not_null", ("movie_id",))], "g")
    reports.save_report(spark, bad, tmp_path)
    page = reports.quality_dashboard({"t": bad, "<g>": good}, reports.history(spark, tmp_path))
    assert "FAIL" in page and "&lt;g&gt;" in page and page.count("class='card'") == 5
    assert "user_id" in reports.profile_report("t", profile.column_profile(_table(spark)), profile.top_values(_table(spark)))
    log = reports.MetricsLog(spark, tmp_path / "m")
    assert log.read().count() == 0
    log.add(rules.quality_record(_table(spark), "t", ["user_id"], [("rating", 1.0, 5.0)], [("movie_id", _table(spark).limit(0), "movie_id")], ["user_id", "movie_id"]))
    log.add(rules.quality_record(_table(spark).limit(0), "g", ["user_id"], keys=["user_id"]), dt.date(2024, 1, 1))
    assert sorted(tuple(r)[2:] for r in log.read().collect()) == [(0, 0, 0, True), (4, 1, 8, False)]  # 1 null, 2 out of range, 4 orphans, 1 repeated
    sent = []
    env = {"ALERT_WEBHOOK_URL": "http://x", "ALERT_SMTP_HOST": "h", "ALERT_EMAIL_TO": "a@b"}
    assert reports.notify({"t": bad}, env, lambda *a: sent.append(a), lambda *a: sent.append(a)) == ["webhook", "mail"] and len(sent) == 2
    assert sent[1][1] == 25 and sent[1][-1] is False
    assert reports.notify({"t": bad}, env | {"ALERT_EMAIL_PASSWORD": "p", "ALERT_EMAIL_FROM": "me@b"}, lambda *a: None, lambda *a: sent.append(a)) == ["webhook", "mail"]
    assert sent[-1][:3] == ("h", 587, "me@b") and sent[-1][-3:] == ("me@b", "p", True)
    with pytest.raises(ValueError):
        reports.send_mail("h", 25, "a", "b", "s", "t", "me", "p")
    assert reports.notify({"t": bad}, {}) == [] and reports.notify({"g": good}, env) == []


# --- incremental


def test_watermark_is_strict_and_pushed_down(spark, tmp_path):
    t = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02"), (3, None)], "id int, d string").withColumn("t", F.col("d").cast("timestamp"))
    assert [r["id"] for r in incremental.filter_since(t, "t", "2024-01-01 00:00:00").collect()] == [2]
    assert incremental.filter_since(t, "t", None).count() == 3
    assert [r["id"] for r in incremental.filter_since(t, "d", "2024-01-01").collect()] == [2]
    w = incremental.Watermarks(spark, tmp_path)
    assert w.get("x") is None and w.advance("x", t, "t") == "2024-01-02 00:00:00"
    assert w.advance("x", t.limit(0), "t") == "2024-01-02 00:00:00"
    plan = incremental.filter_since(catalogue.table(spark, SF, "ratings"), "ingestion_timestamp", "2024-09-01 00:00:00")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(ingestion_timestamp" in plan


def test_stages_resume_with_the_same_bounds(spark, tmp_path):
    calls, fail = [], [True]

    def bounds(_):
        calls.append("bounds")
        return {"from": "a", "to": "b"}

    def load(results):
        calls.append(("load", results["bounds"]["to"]))
        if fail.pop() if fail else False:
            raise RuntimeError("broken")
        return 3

    stages = [("bounds", bounds), ("load", load)]
    with pytest.raises(RuntimeError):
        incremental.run_stages(incremental.Checkpoint(spark, tmp_path, "r1"), stages)
    assert incremental.Checkpoint(spark, tmp_path, "r1").status()["stages"]["load"]["status"] == "failed"
    again = incremental.Checkpoint(spark, tmp_path, "r1")
    assert incremental.run_stages(again, stages) == {"bounds": {"from": "a", "to": "b"}, "load": 3}
    assert calls == ["bounds", ("load", "b"), ("load", "b")] and again.status()["status"] == "complete"


def test_benchmark_compares_cost_and_result(spark, tmp_path):
    kept = incremental.StateFile(spark, tmp_path)
    r = incremental.benchmark(lambda: (10, 8), lambda: (1, 8), kept, "nightly")
    assert r.saved_pct == 90.0 and r.full_rows == 10 and r.accurate and kept.get("nightly")["saved_pct"] == 90.0
    assert not incremental.benchmark(lambda: (0, 1), lambda: (0, 2)).accurate


def test_appended_rows_are_deduplicated(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, at int")
    d = spark.createDataFrame([(1, 2), (3, 1)], "k int, at int")
    got = incremental.append_then_dedupe(t, d, ["k"], [F.col("at").desc()])
    assert sorted(got.collect()) == [(1, None, 2), (2, "b", 1), (3, None, 1)]


def test_rows_that_meet_a_condition_are_rewritten(spark):
    t = spark.createDataFrame([(1, 2.0), (2, None)], "k int, v float")
    assert sorted(upsert.rewrite(t, F.col("v") < 3, {"v": F.col("v") + 0.5}).collect()) == [(1, 2.5), (2, None)]


def test_results_are_shown_in_order(spark):
    t = spark.createDataFrame([(2, 5), (1, 5), (3, 9)], "user_id int, rfm_score int")
    assert [r["user_id"] for r in metrics.presented("rfm_segmentation", t).collect()] == [3, 1, 2] and metrics.presented("other", t) is t


def test_intermediates_are_removed_and_a_cluster_needs_a_shared_folder(spark):
    from millrace import session

    with session.intermediates():
        path = session.written(spark.range(3), "t").inputFiles()[0]
        assert os.path.exists(path.removeprefix("file://"))
    assert not os.path.exists(path.removeprefix("file://"))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        elsewhere = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master))
        with pytest.raises(session.NoSharedFolder):
            session.shared_dir(elsewhere)


# --- streaming


def test_tumbling_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    q = windows.tumbling(stream, "ts", "value").writeStream.outputMode("update").trigger(availableNow=True).foreachBatch(lambda b, i: b.withColumn("batch", F.lit(i)).write.mode("append").parquet(out)).start()
    q.awaitTermination(60)
    got = {r["window_start"]: r["n"] for r in windows.latest_windows(spark.read.parquet(out)).collect()}
    assert got == {r["window_start"]: r["n"] for r in windows.tumbling(events, "ts", "value").collect()} and sum(got.values()) == events.count()


def test_kslack_releases_in_order_and_marks_the_late(spark, tmp_path):
    from millrace.operators.lateness import DAY_US
    from millrace.streaming import kslack

    rows = [(1, 1.0, 5, 10), (2, 2.0, 3, 20), (3, 3.0, 4, 4 + 8 * DAY_US), (4, 1.0, 7, 9 * DAY_US)]
    df = spark.createDataFrame(rows, "row_id bigint, value double, event_us bigint, arrival_us bigint")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = kslack.reorder(stream, slices=1).writeStream.outputMode("update").format("memory").queryName("kslack").trigger(availableNow=True).start()
    q.awaitTermination(60)
    out = [(r["kind"], r["row_id"]) for r in spark.table("kslack").collect()]
    assert [i for k, i in out if k == "released"] == [2, 1] and {i for k, i in out if k == "too_late"} == {3, 4}


def test_kslack_releases_by_the_clock_of_all_arrivals(spark, tmp_path):
    from millrace.operators.lateness import DAY_US
    from millrace.streaming import kslack

    schema = "row_id bigint, value double, event_us bigint, arrival_us bigint"
    batches = [
        [(1, 1.0, 5, 10), (2, None, 6, 20), (3, 2.0, DAY_US, DAY_US + 1)],
        [(4, 4.0, 20 * DAY_US, 20 * DAY_US + 1)],  # another day moves the clock past rows 1 to 3
        [(5, None, 19 * DAY_US, 19 * DAY_US + 1), (6, 6.0, 2 * DAY_US, 3 * DAY_US)],  # behind the clock, but within K of their time
        [(7, 9.0, None, 27 * DAY_US)],  # no event time, still an arrival
    ]
    q, src, cp = None, tmp_path / "in", str(tmp_path / "state")
    src.mkdir()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(src / f"b{i}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(src))
        q = kslack.reorder(stream, slices=2).writeStream.outputMode("update").option("checkpointLocation", cp).trigger(availableNow=True).foreachBatch(lambda b, _: b.write.mode("append").parquet(str(tmp_path / "out"))).start()
        assert q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    released = {r["row_id"]: r["value"] for r in out.filter("kind = 'released'").collect()}
    assert released == {1: 1.0, 2: None, 3: 2.0, 5: None, 6: 6.0} and not out.filter("kind = 'too_late'").count()
    assert out.filter("kind = 'provisional' AND n > rated").count() > 0
    left = kslack.flush(spark, cp)
    assert [(r["row_id"], r["value"], r["kind"]) for r in left.collect()] == [(4, 4.0, "released")] and left.columns == out.columns


def test_the_stream_agrees_with_the_batch(spark, tmp_path):
    from millrace.operators import lateness
    from millrace.operators.lateness import DAY_US
    from millrace.streaming import kslack

    rnd, rows = random.Random(8), []
    for i in range(600):
        e = i * DAY_US // 10 + rnd.randrange(DAY_US // 10)
        rows.append((i, rnd.choice([None, 1.0, 2.5]), e, e + rnd.choice([0, DAY_US // 2, 3 * DAY_US, 9 * DAY_US])))
    rows.sort(key=lambda r: r[3])
    schema = "row_id bigint, value double, event_us bigint, arrival_us bigint"
    src, cp = tmp_path / "in", str(tmp_path / "state")
    src.mkdir()
    for n, part in enumerate((rows[:300], rows[300:500], rows[500:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(src / f"b{n}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(src))
        q = kslack.reorder(stream, slices=2).writeStream.outputMode("update").option("checkpointLocation", cp).trigger(availableNow=True).foreachBatch(lambda b, _: b.write.mode("append").parquet(str(tmp_path / "out"))).start()
        assert q.awaitTermination(180)
    out, left = spark.read.parquet(str(tmp_path / "out")), kslack.flush(spark, cp)
    clock = max(r[3] for r in rows)
    # of sixty ordinary days only the last K wait, and no state is kept of the others
    assert {r["row_id"] for r in left.collect()} == {i for i, _, e, a in rows if a - e <= 7 * DAY_US and e + 7 * DAY_US >= clock}
    arrived = lateness.arrivals(spark.createDataFrame(rows, schema), F.col("event_us"), F.col("arrival_us"), "row_id", "value")
    daily = {r["event_day"]: (r["n"], r["avg_value"]) for r in lateness.ordered_daily(arrived).collect()}
    stream_daily = out.filter("kind = 'released'").select("event_us", "value").unionByName(left.select("event_us", "value"))
    got = {r["d"]: (r["n"], r["a"]) for r in stream_daily.groupBy(lateness.day_text(F.col("event_us")).alias("d")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("a")).collect()}
    assert got == {d: (n, pytest.approx(a)) for d, (n, a) in daily.items()}
    assert got == {r["event_day"]: (r["n"], pytest.approx(r["avg_value"])) for r in lateness.revisions(arrived).filter("final").collect()}
    refused = {r["row_id"] for r in lateness.reordered(arrived).filter("verdict = 'too_late'").collect()}
    assert {r["row_id"] for r in out.filter("kind = 'too_late'").collect()} == refused
