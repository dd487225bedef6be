"""Landing, snapshots and the flow runner."""

import hashlib
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from millrace import flow
from millrace.quality import reports, rules
from millrace.sources import files, snapshots
from millrace.streaming.windows import upsert_batches


@pytest.fixture
def landing(spark, tmp_path):
    return files.Landing(spark, str(tmp_path / "landed"), files.Registry(spark, tmp_path / "registry"), files.Quarantine(spark, tmp_path / "quarantine"))


def test_every_format_lands_once(landing, spark, tmp_path):
    s = files.write_samples(spark, str(tmp_path / "in"))
    assert landing.ingest(s["ratings"], "web", "ratings", files.RATINGS) and landing.ingest(s["ratings"], "web", "ratings", files.RATINGS) is None
    assert landing.ingest(s["movies"], "web", "movies", files.MOVIES) and landing.ingest(s["users"], "web", "users", files.USERS)
    r = files.read_landed(spark, landing.base, "web", "ratings")
    assert r.count() == 200 and set(files.AUDIT) <= set(r.columns)
    assert files.read_landed(spark, landing.base, "web", "movies").count() == 30
    assert files.read_landed(spark, landing.base, "web", "users").count() == 50
    assert landing.registry.as_dataframe().agg(F.sum("rows")).first()[0] == 280
    lines = tmp_path / "lines.json"
    lines.write_text('{"movie_id": 1, "title": "a"}\n{"movie_id": "x"}\n{"movie_id": 2}\n')
    assert not files.is_json_document(spark, str(lines)) and files.is_json_document(spark, s["movies"])
    assert spark.read.parquet(landing.ingest(str(lines), "web", "movies", files.MOVIES)).count() == 2


def test_bad_files_and_records_are_set_aside(landing, spark, tmp_path):
    p = tmp_path / "half.csv"
    p.write_text("user_id,movie_id,rating,rated_at\n1,2,3.5,2024-01-01\nx,2,3.5,2024-01-01\n")
    assert landing.ingest(str(p), "web", "ratings", files.RATINGS)
    assert files.read_landed(spark, landing.base, "web", "ratings").count() == 1
    assert spark.read.option("recursiveFileLookup", True).parquet(landing.quarantine.records).count() == 1
    e = tmp_path / "empty.csv"
    e.write_text("user_id,movie_id,rating,rated_at\n")
    bad = files.write_samples(spark, str(tmp_path / "s"))["ratings_bad"]
    assert landing.ingest(str(e), "web", "ratings", files.RATINGS) is None and landing.ingest(bad, "web", "ratings", files.RATINGS) is None
    assert landing.ingest(str(tmp_path / "none.csv"), "web", "ratings", files.RATINGS) is None
    assert len(landing.quarantine.errors()) == 2 and e.exists() and all(x["reason"] for x in landing.quarantine.errors())
    with pytest.raises(ValueError):
        files.file_format("x.xlsx")


def test_directory_shares_a_run(landing, spark, tmp_path):
    for i in range(3):
        (tmp_path / f"d{i}.csv").write_text(f"user_id,movie_id,rating,rated_at\n{i},2,3.5,x\n")
    (tmp_path / "copy of d0 +1.csv").write_text((tmp_path / "d0.csv").read_text())
    (tmp_path / "broken.parquet").write_text("no table")
    assert len(landing.ingest_directory(str(tmp_path), "web", "ratings", files.RATINGS)) == 1
    landed = files.read_landed(spark, landing.base, "web", "ratings")
    assert landed.count() == 3 and landed.select("job_run_id").distinct().count() == 1  # the copy's content is known
    assert {r["source_file_path"].rpartition("/")[2] for r in landed.collect()} == {"copy of d0 +1.csv", "d1.csv", "d2.csv"}
    assert [e["file"].rpartition("/")[2] for e in landing.quarantine.errors()] == ["broken.parquet"]
    digest = hashlib.md5((tmp_path / "d1.csv").read_bytes()).hexdigest()
    assert landing.registry.has(digest) and files.content_hashes(spark, [str(tmp_path / "d1.csv")]).first()["hash"] == digest


def test_a_failure_of_the_cluster_is_no_bad_file(landing, spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text("user_id,movie_id,rating,rated_at\n1,2,3.5,x\n")
    monkeypatch.setattr(files, "add_audit_columns", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        landing.ingest(str(tmp_path / "a.csv"), "web", "ratings", files.RATINGS)
    assert landing.quarantine.errors() == []


def test_parquet_without_a_column_is_refused(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "u.parquet"))
    with pytest.raises(ValueError, match="lacks"):
        files.read_source(spark, str(tmp_path / "u.parquet"), files.USERS)


def test_snapshots_can_be_computed_from_themselves(spark, tmp_path):
    t = snapshots.SnapshotTable(spark, tmp_path / "t")
    assert not t.exists
    t.write(spark.range(3))
    t.write(t.read().withColumn("id", F.col("id") + 10))
    assert t.version == 2 and sorted(r["id"] for r in t.read().collect()) == [10, 11, 12] and t.read(1).count() == 3
    t.append(spark.range(1))
    assert snapshots.read_table(spark, str(tmp_path / "t")).count() == 4
    with pytest.raises(FileNotFoundError):
        snapshots.SnapshotTable(spark, tmp_path / "none").read()


def test_writers_of_a_table_do_not_lose_each_others_rows(spark, tmp_path):
    t, other = snapshots.SnapshotTable(spark, tmp_path / "t"), snapshots.SnapshotTable(spark, tmp_path / "t")
    t.append(spark.range(3))
    since = other.version
    t.append(spark.range(3, 5))
    with pytest.raises(snapshots.Conflict):
        other.write(other.read(since), since=since)
    assert t.read().count() == 5 and t.version == 2
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: snapshots.SnapshotTable(spark, tmp_path / "t").append(spark.range(10 * i, 10 * i + 2), keep=20), range(1, 5)))
    assert t.version == 6 and t.read().count() == 13 and t.read(2).count() == 5
    t.write(spark.range(1), keep=1)
    assert t.versions() == [7] and t.read().count() == 1 and len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("v-")]) == 1


def test_batches_merge_into_a_snapshot_table(spark, tmp_path):
    t = snapshots.SnapshotTable(spark, tmp_path / "t")
    run = upsert_batches(t, ["k"], ["v", "rated_at"], "rated_at")
    schema = "k int, v string, rated_at int"
    run(spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "x", 1)], schema), 0)
    run(spark.createDataFrame([(1, "old", 1), (2, "y", 3), (3, "z", 1)], schema), 1)
    assert sorted((r["k"], r["v"]) for r in t.read().collect()) == [(1, "b"), (2, "y"), (3, "z")]


# --- flow


def test_order_parallel_branches_and_results():
    seen = []
    f = flow.Flow([flow.Task("c", lambda c: c["a"] + c["b"], ("a", "b")), flow.Task("a", lambda c: seen.append("a") or 1), flow.Task("b", lambda c: seen.append("b") or 2)])
    runs = f.execute(ctx := {})
    assert [r.task for r in runs] == ["a", "b", "c"] and ctx["c"] == 3 and all(r.status == "success" for r in runs)
    with pytest.raises(ValueError):
        flow.Flow([flow.Task("a", print, ("b",)), flow.Task("b", print, ("a",))])
    with pytest.raises(ValueError):
        flow.Flow([flow.Task("a", print, ("none",))])


def test_retries_back_off_then_fail_and_skip():
    pauses, tries = [], []

    def broken(_):
        tries.append(1)
        raise RuntimeError("no")

    f = flow.Flow([flow.Task("a", broken), flow.Task("b", lambda c: 1, ("a",)), flow.Task("m", lambda c: 1, ("a",), always=True)], flow.Retry(3, 300, 1000), sleep=pauses.append)
    runs = {r.task: r for r in f.execute()}
    assert len(tries) == 4 and pauses == [300, 600, 1000] and runs["a"].status == "failed" and "no" in runs["a"].error
    assert runs["b"].status == "skipped" and runs["m"].status == "success"


def test_gate_and_deadlines(spark):
    missed = []
    bad = rules.run_suite(spark.createDataFrame([(None,)], "a int"), [rules.Rule("not_null", ("a",))], "t")
    f = flow.Flow([flow.Task("q", lambda c: flow.quality_gate({"t": bad}), deadline_s=-1)], sleep=lambda s: pytest.fail("a gate is not retried"), on_miss=missed.append)
    runs = f.execute()
    assert runs[0].status == "failed" and runs[0].attempts == 1 and [m.task for m in missed] == ["q"]


def test_standard_flow_and_log(spark, tmp_path):
    steps = dict.fromkeys(["ingest_ratings", "ingest_movies", "ingest_users", "clean", "quality", "analytics", "incremental", "monitoring"], lambda c: 100)
    f = flow.standard_flow(steps)
    assert f.tasks["clean"].after == ("ingest_ratings", "ingest_movies", "ingest_users") and f.tasks["analytics"].deadline_s == 7 * 3600
    log = flow.RunLog(spark, tmp_path)
    log.add(f.execute())
    page = reports.monitoring_dashboard(log.read())
    assert "800" in page and log.as_dataframe().filter("status = 'success'").count() == 8


def test_the_whole_run(spark, tmp_path):
    from millrace.plans.pipeline import Pipeline

    sf = "/root/testdata/sf0.001"
    p = Pipeline(spark, tmp_path, lambda name: spark.read.parquet(f"{sf}/{name}.parquet"), top_n=5)
    runs = {r.task: r for r in p.run(flow.Retry(0))}
    assert {r.status for r in runs.values()} == {"success"}, runs
    assert p.read("top_movies_overall").count() == 5 and p.read("fact_ratings").count() == runs["clean"].rows
    before = p.read("ratings").count()
    p.clean()
    assert p.read("ratings").count() == before and p.table("ratings").version == 2
    assert p.incremental() == 0
    assert (tmp_path / "quality" / "dashboard.html").exists() and (tmp_path / "reports" / "monitoring.html").exists()


def test_the_incremental_step_counts_what_came_since_the_last(spark, tmp_path):
    from millrace.plans.pipeline import Pipeline

    sf, until = "/root/testdata/sf0.001", {"t": "2024-09-01"}

    def inputs(name):
        t = spark.read.parquet(f"{sf}/{name}.parquet")
        return t.filter(F.col("ingestion_timestamp") < F.lit(until["t"]).cast("timestamp")) if name == "ratings" else t

    p = Pipeline(spark, tmp_path, inputs)
    p.clean()
    first = inputs("ratings").count()
    assert 0 < first == p.incremental() and p.incremental() == 0
    until["t"] = "2100-01-01"
    p.clean()
    assert p.incremental() == inputs("ratings").count() - first > 0 and p.incremental() == 0


def test_the_run_keeps_the_history_of_users(spark, tmp_path):
    from millrace.operators import upsert
    from millrace.plans import star
    from millrace.plans.pipeline import Pipeline

    sf, days = "/root/testdata/sf0.001", ["2024-01-01", "2024-02-01", "2024-03-01", "2024-04-01"]
    users, now = spark.read.parquet(f"{sf}/users.parquet"), {"days": days[:3]}
    p = Pipeline(spark, tmp_path, lambda name: users.filter(F.col("snapshot_date").cast("string").isin(now["days"])) if name == "users" else spark.read.parquet(f"{sf}/{name}.parquet"))
    p.clean()
    now["days"] = days[3:]  # the next load holds the new snapshot only
    p.clean()
    snap = lambda d: star.current_users(users.filter(F.col("snapshot_date") == F.lit(d).cast("date"))).drop("snapshot_date")
    want = upsert.scd2_first_load(snap(days[0]), F.lit(days[0]))
    for d in days[1:]:
        want = upsert.apply_scd2(want, snap(d), "user_id", ["plan", "country"], F.lit(d))
    got = p.read("users_scd2")
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(map(tuple, df.select(*sorted(want.columns)).collect()), key=str)
    assert rows(got) == rows(want)
    assert got.filter("NOT is_current").count() > 0 and not got.filter("is_current").groupBy("user_id").count().filter("count > 1").count()


def test_the_run_lands_files_and_reports_orphans(landing, spark, tmp_path):
    from millrace.plans.pipeline import Pipeline

    folder = tmp_path / "drop"
    folder.mkdir()
    (folder / "a.csv").write_text("user_id,movie_id,rating,rated_at\n1,2,3.5,2024-01-01\n9,2,3.5,2024-01-01\n")
    (folder / "broken.csv").write_text("user_id,movie_id,rating,rated_at\nx,y,z\n")
    movies = spark.createDataFrame([(1, 2, "m", "Drama", 2000, "en", "US", "2024-01-01")], "row_id bigint, movie_id int, title string, genres string, year int, language string, country string, ingestion_timestamp string")
    users = spark.createDataFrame([(1, "2024-01-01", 1, "2024-01-01", "US", "lite", "2024-01-01")], "row_id bigint, snapshot_date string, user_id bigint, signup_date string, country string, plan string, ingestion_timestamp string")
    tables = {"movies": movies.withColumn("ingestion_timestamp", F.to_timestamp("ingestion_timestamp")), "users": users.withColumns({"snapshot_date": F.to_date("snapshot_date"), "ingestion_timestamp": F.to_timestamp("ingestion_timestamp")})}

    def inputs(name):
        return files.read_landed(spark, landing.base, "files", name).withColumn("row_id", F.col("user_id").cast("bigint")) if name == "ratings" else tables[name]

    p = Pipeline(spark, tmp_path / "base", inputs, landing=landing, folders={"ratings": str(folder)})
    runs = {r.task: r for r in p.run(flow.Retry(0))}
    assert {r.status for r in runs.values()} == {"success"}, runs
    assert runs["ingest_ratings"].rows == 2 and len(landing.quarantine.errors()) == 1 and p.ingest("ratings") == 0
    assert [(o.rule.columns, o.failed_count) for o in p.references().outcomes] == [(("user_id",), 1), (("movie_id",), 0)]
    assert not p.landed().ok and "broken.csv" in p.landed().outcomes[0].details
    assert "ratings_references" in (tmp_path / "base" / "quality" / "dashboard.html").read_text() and (tmp_path / "base" / "reports" / "enriched_ratings.html").exists()
