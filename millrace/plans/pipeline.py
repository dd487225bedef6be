"""The whole run: clean tables, quality gate, analytics, monitoring, as one flow over snapshot tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import flow, incremental
from millrace.operators import upsert
from millrace.plans import metrics, star
from millrace.quality import profile, reports, rules
from millrace.session import intermediates
from millrace.sources import files, store
from millrace.sources.snapshots import SnapshotTable

Inputs = Callable[[str], DataFrame]  # the landed rows of ratings, movies or users

SUITES: dict[str, list[rules.Rule]] = {
    "ratings": rules.compile_rules({"not_null": ["user_id", "movie_id"], "unique": [["user_id", "movie_id"]], "thresholds": {"min_row_count": 1}}),
    "movies": rules.compile_rules({"not_null": ["movie_id"], "unique": [["movie_id"]], "thresholds": {"min_row_count": 1}}),
    "users": rules.compile_rules({"not_null": ["user_id"], "unique": [["user_id"]], "thresholds": {"min_row_count": 1}}),
    "fact_ratings": rules.compile_rules({"not_null": ["user_id", "movie_id"], "thresholds": {"min_row_count": 1}}),
}

SCHEMAS = {"ratings": files.RATINGS, "movies": files.MOVIES, "users": files.USERS}
KEYS = {"ratings": ["user_id", "movie_id"], "movies": ["movie_id"], "users": ["user_id"]}
REFERENCES = {"user_id": "users", "movie_id": "movies"}  # of ratings


class Pipeline:
    """Steps over tables below ``base``; each reads what the ones before wrote.

    With ``landing`` the ingest steps land the files of ``folders``, by table, under
    ``source``; ``inputs`` then reads what was landed.
    """

    def __init__(
        self, spark: SparkSession, base: str, inputs: Inputs, top_n: int = 100, landing: files.Landing | None = None, folders: Mapping[str, str] | None = None, source: str = "files"
    ) -> None:
        self.spark, self.base, self.inputs, self.top_n = spark, str(base), inputs, top_n
        self.landing, self.folders, self.source = landing, dict(folders or {}) if landing else {}, source
        self.marks = incremental.Watermarks(spark, self.at("state", "marks"))

    def at(self, *parts: str) -> str:
        return store.join(self.base, *parts)

    def table(self, name: str) -> SnapshotTable:
        return SnapshotTable(self.spark, self.at(name))

    def read(self, name: str) -> DataFrame:
        return self.table(name).read()

    def _write(self, name: str, df: DataFrame) -> int:
        self.table(name).write(df)
        return self.read(name).count()  # of Parquet footers

    def ingest(self, name: str) -> int:
        """Rows landed from the table's folder by this run; without a folder, rows of its input."""
        if name not in self.folders:
            return self.inputs(name).agg(F.count(F.lit(1))).first()[0]
        out = self.landing.ingest_directory(self.folders[name], self.source, name, SCHEMAS[name])
        return self.spark.read.parquet(*out).count() if out else 0

    def clean(self, _: Mapping | None = None) -> int:
        """Ratings past the mark are merged into those kept; movies and users are replaced; genres and enriched ratings follow.

        The mark itself is moved by ``incremental``, after all that depends on the ratings.

        ``users_snapshots`` keeps every snapshot's row of a user, and ``users_scd2`` the
        history of plan and country over all of them, so that a load that holds new
        snapshots only, or corrects an old one, finds its place.
        """
        t = self.table("ratings")
        landed = incremental.filter_since(self.inputs("ratings"), "ingestion_timestamp", self.marks.get("ratings") if t.exists else None)
        fresh = star.clean_ratings(landed)
        merged = upsert.merge(t.read(), fresh, ["user_id", "movie_id"], ["rating", "rated_at", "row_id", "ingestion_timestamp"], newer="rated_at") if t.exists else fresh
        n = self._write("ratings", merged)
        self._write("movies", star.clean_movies(self.inputs("movies")))
        self._write("users", star.current_users(self.inputs("users")))
        states, kept = star.user_states(self.inputs("users")), self.table("users_snapshots")
        self._write("users_snapshots", star.latest_states(kept.read().unionByName(states)) if kept.exists else states)
        self._write("users_scd2", upsert.scd2_from_snapshots(self.read("users_snapshots"), "user_id", "snapshot_date", ["plan", "country"]))
        self._write("genres", star.movie_genres(self.read("movies")))
        self._write("enriched_ratings", star.enriched_ratings(self.read("ratings"), self.read("movies"), self.read("users")))
        self._write("fact_ratings", star.fact_ratings(self.read("ratings"), self.read("users")))
        return n

    def quality(self, _: Mapping | None = None, notify: bool = True) -> int:
        """All suites; reports and dashboard are written, channels told, and a failure of a suite stops the flow.

        Ratings without their user or movie, and files that could not be landed, are reported alike but stop nothing.
        """
        suites = rules.run_all({n: self.read(n) for n in SUITES}, SUITES)
        found = suites | {"ratings_references": self.references()} | ({"landing": self.landed()} if self.landing else {})
        log = reports.MetricsLog(self.spark, self.at("quality", "metrics"))
        for r in found.values():
            reports.save_report(self.spark, r, self.at("quality"))
        log.add(reduce(DataFrame.unionByName, [self.record(n) for n in KEYS]))
        page = reports.quality_dashboard(found, reports.history(self.spark, self.at("quality")))
        store.write_text(self.spark, self.at("quality", "dashboard.html"), page)
        if notify:
            reports.notify(found)
        flow.quality_gate(suites)
        return len(suites)

    def record(self, name: str) -> DataFrame:
        """What is wrong with a clean table, as a row of the metrics log."""
        parents = [(k, self.read(p), k) for k, p in REFERENCES.items()] if name == "ratings" else []
        spans = [("rating", 1.0, 5.0)] if name == "ratings" else []
        return rules.quality_record(self.read(name), name, KEYS[name], spans, parents, KEYS[name])

    def references(self) -> rules.Report:
        """Ratings whose user or movie is not among the clean ones."""
        out = []
        for key, parent in REFERENCES.items():
            n = rules.orphan_keys(self.read("ratings"), key, self.read(parent), key).count()
            out.append(rules.Outcome(rules.Rule("references", (key,)), rules.FAILED if n else rules.PASSED, n, f"not in {parent}" if n else ""))
        return rules.Report("ratings_references", out)

    def landed(self) -> rules.Report:
        """Files in quarantine, by name and reason."""
        bad = self.landing.quarantine.errors()
        return rules.Report("landing", [rules.Outcome(rules.Rule("readable_files"), rules.FAILED if bad else rules.PASSED, len(bad), "; ".join(f"{e['file']}: {e['reason']}" for e in bad))])

    def analytics(self, _: Mapping | None = None) -> int:
        """Dimensions and every metric table; their number."""
        fact, movies, users, genres = (self.read(n) for n in ("fact_ratings", "movies", "users", "genres"))
        out = {
            "dim_dates": star.dim_dates(fact, "rating_date"), "dim_users": star.dim_users(users), "dim_movies": star.dim_movies(movies), "daily_engagement": metrics.daily_engagement(fact),
            "top_movies_overall": metrics.top_movies_overall(fact, movies, self.top_n), "top_movies_by_genre": metrics.top_movies_by_genre(fact, movies, genres, self.top_n),
            "top_movies_by_month": metrics.top_movies_by_month(fact, movies, self.top_n), "rfm_segmentation": metrics.rfm_segmentation(fact), "retention_cohorts": metrics.retention_cohorts(fact, users),
            "daily_kpis": metrics.daily_kpis(fact), "weekly_kpis": metrics.weekly_kpis(fact), "monthly_kpis": metrics.monthly_kpis(fact),
        }
        for name, df in out.items():
            self.table(name).write(metrics.presented(name, df))
        return len(out)

    def incremental(self, _: Mapping | None = None) -> int:
        """Landed ratings newer than the mark, all without one; the mark moves past them."""
        return self.marks.consume("ratings", self.inputs("ratings"), "ingestion_timestamp")

    def monitoring(self, _: Mapping | None = None) -> int:
        """Profiles of the clean tables as pages."""
        for name in ("ratings", "movies", "users", "enriched_ratings"):
            if self.table(name).exists:
                t = self.read(name)
                store.write_text(self.spark, self.at("reports", f"{name}.html"), reports.profile_report(name, profile.column_profile(t), profile.top_values(t)))
        return 0

    def run(self, retry: flow.Retry | None = None) -> list[flow.TaskRun]:
        """The whole flow; its records go to the log and the monitoring page."""
        ingest = lambda name: lambda _: self.ingest(name)
        steps = {f"ingest_{n}": ingest(n) for n in SCHEMAS}
        steps |= {n: getattr(self, n) for n in ("clean", "quality", "analytics", "incremental", "monitoring")}
        with intermediates():
            runs = flow.standard_flow(steps, retry=retry).execute()
        log = flow.RunLog(self.spark, self.at("state", "runs"))
        log.add(runs)
        store.write_text(self.spark, self.at("reports", "monitoring.html"), reports.monitoring_dashboard(log.read()))
        return runs
