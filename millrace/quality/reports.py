"""Reports as JSON and HTML, the log of metrics, and notifications."""

from __future__ import annotations

import html
import json
import os
import smtplib
import ssl
import time
import urllib.request
from collections.abc import Callable, Iterable, Mapping, Sequence
from datetime import UTC, date, datetime
from email.message import EmailMessage

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.quality.rules import Report
from millrace.sources import store


def save_report(spark: SparkSession, report: Report, folder: str) -> str:
    """The suite's latest report as JSON, and one more file in its history."""
    text = json.dumps(report.as_dict(), default=str)
    store.write_text(spark, store.join(folder, "history", f"{time.time_ns()}-{report.table}.json"), text)
    store.write_text(spark, out := store.join(folder, f"{report.table}.json"), text)
    return out


def history(spark: SparkSession, folder: str, last: int = 20) -> list[dict]:
    names = store.children(spark, store.join(folder, "history"))[-last:]
    return [json.loads(store.read_text(spark, store.join(folder, "history", n))) for n in names]


def html_table(rows: Sequence[Mapping], columns: Sequence[str]) -> str:
    cell = lambda v: f"<td>{html.escape('' if v is None else str(v))}</td>"
    head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
    return f"<table><tr>{head}</tr>{''.join('<tr>' + ''.join(cell(r.get(c)) for c in columns) + '</tr>' for r in rows)}</table>"


def _page(title: str, body: Iterable[str]) -> str:
    style = "body{font-family:sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #999;padding:.3em .6em}.card{display:inline-block;border:1px solid #999;padding:1em;margin:.3em}"
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title><style>{style}</style></head><body><h1>{html.escape(title)}</h1>{''.join(body)}</body></html>"


def _cards(facts: Mapping[str, object]) -> str:
    return "".join(f"<div class='card'><b>{html.escape(str(v))}</b><br>{html.escape(k)}</div>" for k, v in facts.items())


def quality_dashboard(reports: Mapping[str, Report], past: Sequence[dict] = ()) -> str:
    """Totals, the trend of the last 20 reports, a line per suite and one per rule."""
    n, ok = sum(r.passed + r.failed for r in reports.values()), sum(r.passed for r in reports.values())
    facts = {"suites": len(reports), "checks": n, "passed": ok, "failed": n - ok, "success %": round(ok / n * 100, 1) if n else 100.0}
    summary = [{"suite": k, "passed": r.passed, "failed": r.failed, "success %": r.success_pct, "result": "pass" if r.ok else "FAIL"} for k, r in reports.items()]
    details = [{"suite": k, "rule": o.rule.name, "status": o.status, "failed rows": o.failed_count} for k, r in reports.items() for o in r.outcomes]
    trend = [{"at": p["checked_at"], "suite": p["table"], "success %": p["success_pct"]} for p in list(past)[-20:]]
    return _page("Data quality", [_cards(facts), "<h2>Trend</h2>", html_table(trend, ["at", "suite", "success %"]), "<h2>Suites</h2>", html_table(summary, ["suite", "passed", "failed", "success %", "result"]), "<h2>Checks</h2>", html_table(details, ["suite", "rule", "status", "failed rows"])])


def monitoring_dashboard(runs: Sequence[dict]) -> str:
    """Totals and the last 50 task records."""
    runs = list(runs)[-50:]
    mean = round(sum(r["elapsed_s"] for r in runs) / len(runs), 2) if runs else 0.0
    facts = {"tasks": len(runs), "succeeded": sum(r["status"] == "success" for r in runs), "failed": sum(r["status"] == "failed" for r in runs), "rows": sum(r["rows"] or 0 for r in runs), "mean seconds": mean}
    return _page("Runs", [_cards(facts), html_table(runs, ["at", "task", "status", "attempts", "rows", "elapsed_s", "error"])])


def profile_report(name: str, profile: DataFrame, top: DataFrame | None = None) -> str:
    rows = [r.asDict() for r in profile.collect()]  # a row per column
    body = [html_table(rows, profile.columns)]
    if top is not None:
        body += ["<h2>Top values</h2>", html_table([r.asDict() for r in top.orderBy("column", "rank").collect()], top.columns)]
    return _page(f"Profile of {name}", body)


_METRICS = "table_name string, check_date string, total_rows bigint, duplicate_count bigint, total_failed bigint, passed boolean"


class MetricsLog:
    """Quality metrics, appended as Parquet."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, str(path)

    def add(self, records: DataFrame, day: date | None = None) -> None:
        """Append rows of ``rules.quality_record`` under a day, by default today."""
        x = records.withColumn("check_date", F.lit((day or datetime.now(UTC).date()).isoformat()))
        cols = [c.split() for c in _METRICS.split(", ")]
        x.select(*[F.col(c).cast(t).alias(c) for c, t in cols]).coalesce(1).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        """All metrics; an empty table of the same columns before the first."""
        if not store.children(self.spark, self.path):
            return self.spark.createDataFrame([], _METRICS)
        return self.spark.read.schema(_METRICS).parquet(self.path)


def post_json(url: str, payload: dict) -> None:
    req = urllib.request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(req, timeout=10):
        pass


def send_mail(host: str, port: int, sender: str, to: str, subject: str, text: str, user: str = "", password: str = "", tls: bool = False) -> None:
    """Plain or, with ``tls``, encrypted before anything is said; with a user it logs in, which needs ``tls``."""
    if user and not tls:
        raise ValueError("a password is sent over TLS only")
    m = EmailMessage()
    m["From"], m["To"], m["Subject"] = sender, to, subject
    m.set_content(text)
    with smtplib.SMTP(host, port, timeout=10) as s:
        if tls:
            s.starttls(context=ssl.create_default_context())
        if user:
            s.login(user, password)
        s.send_message(m)


def notify(reports: Mapping[str, Report], env: Mapping[str, str] = os.environ, post: Callable = post_json, mail: Callable = send_mail) -> list[str]:
    """Tell the configured channels about failed suites; the channels that were told.

    Nothing is sent if all pass, or to channels that are not configured.  A channel that
    fails does not keep the others from being told.
    """
    bad = {k: r for k, r in reports.items() if not r.ok}
    if not bad:
        return []
    text = "\n".join(f"{k}: {r.failed} of {r.passed + r.failed} checks failed" for k, r in bad.items())
    told = []
    if url := env.get("ALERT_WEBHOOK_URL"):
        try:
            post(url, {"text": text})
            told.append("webhook")
        except OSError:
            pass
    if (host := env.get("ALERT_SMTP_HOST")) and (to := env.get("ALERT_EMAIL_TO")):
        try:
            # with a password the sender logs in, over TLS
            sender, password = env.get("ALERT_EMAIL_FROM", "alerts@localhost"), env.get("ALERT_EMAIL_PASSWORD", "")
            port = int(env.get("ALERT_SMTP_PORT", "587" if password else "25"))
            mail(host, port, sender, to, "Data quality", text, sender if password else "", password, bool(password))
            told.append("mail")
        except (OSError, ValueError, smtplib.SMTPException):
            pass
    return told
