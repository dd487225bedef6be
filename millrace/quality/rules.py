"""Data-quality rules compiled into one aggregate per table.

Every rule that looks at single rows becomes a conditional count of one aggregate, so that
a suite of any number of rules scans the table once.  Uniqueness needs a shuffle on its
columns, one per set of columns; each is a scalar subquery of the same plan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASSED, FAILED, SKIPPED = "passed", "failed", "skipped"
MAX_ROWS = 10_000_000


@dataclass(frozen=True)
class Rule:
    """``kind``: not_null, between, in_set, unique, row_count, column_exists, max_null_pct or max_duplicate_pct.  Others are measured by their caller."""

    kind: str
    columns: tuple[str, ...] = ()
    low: float | None = None
    high: float | None = None
    values: tuple = ()

    @property
    def name(self) -> str:
        return f"{self.kind}({','.join(self.columns)})"


@dataclass
class Outcome:
    rule: Rule
    status: str
    failed_count: float
    details: str = ""


@dataclass
class Report:
    table: str
    outcomes: list[Outcome]
    checked_at: str = field(default_factory=lambda: datetime.now(UTC).isoformat())

    @property
    def passed(self) -> int:
        return sum(o.status == PASSED for o in self.outcomes)

    @property
    def failed(self) -> int:
        return sum(o.status == FAILED for o in self.outcomes)

    @property
    def success_pct(self) -> float:
        n = self.passed + self.failed
        return round(self.passed / n * 100, 1) if n else 100.0

    @property
    def ok(self) -> bool:
        return not self.failed

    def as_dict(self) -> dict:
        return {
            "table": self.table, "checked_at": self.checked_at, "passed": self.passed, "failed": self.failed, "success_pct": self.success_pct, "ok": self.ok,
            "results": [{"rule": o.rule.name, "status": o.status, "failed_count": o.failed_count, "details": o.details} for o in self.outcomes],
        }


def null_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: null values of each column that exists."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols if c in df.columns])


def out_of_range(col: str, low: float, high: float) -> Column:
    """A count of values outside [low, high]; null is not outside."""
    return F.count_if((F.col(col) < low) | (F.col(col) > high))


def not_in_set(col: str, values: Sequence) -> Column:
    return F.count_if(~F.col(col).isin(*values))


def duplicate_excess(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows beyond the first of each key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("excess_rows"))


def duplicate_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("duplicated_keys"))


def orphan_keys(df: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Rows of ``df`` whose key has no parent; a null key has none."""
    p = parent.select(F.col(pk).alias("_pk")).filter(F.col("_pk").isNotNull()).distinct()
    return df.join(p, df[fk] == p["_pk"], "left_anti")


def _expected(rule: Rule, cols: set[str]) -> str | None:
    """Why a rule can't be evaluated by counting rows: its status then; None if it can."""
    missing = [c for c in rule.columns if c not in cols]
    if rule.kind == "column_exists":
        return FAILED if missing else PASSED
    if rule.kind == "not_null":
        return FAILED if missing else None
    if rule.kind == "unique":
        return SKIPPED if len(missing) == len(rule.columns) else None
    return SKIPPED if missing else None


def measure(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row of all counts the rules need: ``rows`` and ``r0, r1, ...`` by the rules' places."""
    cols = set(df.columns)
    aggs, wide = [F.count(F.lit(1)).alias("rows")], []
    for i, r in enumerate(rules):
        if _expected(r, cols) is not None:
            continue
        if r.kind in ("not_null", "max_null_pct"):
            aggs.append(reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in r.columns]).alias(f"r{i}"))
        elif r.kind == "between":
            aggs.append(out_of_range(r.columns[0], r.low, r.high).alias(f"r{i}"))
        elif r.kind == "in_set":
            aggs.append(not_in_set(r.columns[0], r.values).alias(f"r{i}"))
        elif r.kind == "unique":
            wide.append(duplicate_groups(df, [c for c in r.columns if c in cols]).scalar().alias(f"r{i}"))
        elif r.kind == "max_duplicate_pct":
            wide.append(duplicate_excess(df, list(r.columns)).scalar().alias(f"r{i}"))
    return df.agg(*aggs).select("*", *wide)


def _limit(rule: Rule) -> Column:
    """How many failures a rule bears."""
    return F.col("rows") * float(rule.high or 0) / 100 if rule.kind in ("max_null_pct", "max_duplicate_pct") else F.lit(0.0)


def outcomes(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """A row per rule: ``place, rule, status, failed_count, rows``, of one aggregate over the table.

    ``failed_count`` is the number of failing rows or keys; of rules about the table as a
    whole 1 if they fail.
    """
    cols, out = set(df.columns), []
    for i, r in enumerate(rules):
        status = _expected(r, cols)
        if status is not None:
            state, n = F.lit(status), F.lit(0 if status != FAILED else 1)
        elif r.kind == "row_count":
            ok = (F.col("rows") >= (r.low or 0)) & (F.col("rows") <= (MAX_ROWS if r.high is None else r.high))
            state, n = F.when(ok, PASSED).otherwise(FAILED), F.when(ok, 0).otherwise(1)
        else:
            n = F.coalesce(F.col(f"r{i}"), F.lit(0))
            state = F.when(n <= _limit(r), PASSED).otherwise(FAILED)
        out.append(F.struct(F.lit(i).alias("place"), F.lit(r.name).alias("rule"), state.alias("status"), n.cast("bigint").alias("failed_count"), F.col("rows").alias("rows")))
    empty = F.array().cast("array<struct<place:int,rule:string,status:string,failed_count:bigint,rows:bigint>>")
    return measure(df, rules).select(F.explode(F.array(*out) if out else empty).alias("o")).select("o.*")


def success(found: DataFrame) -> DataFrame:
    """One row: ``passed, failed, skipped, success_pct`` of outcomes; all passed if nothing could be checked."""
    n = F.count_if(F.col("status") == PASSED) + F.count_if(F.col("status") == FAILED)
    pct = F.coalesce(F.round(F.try_divide(F.count_if(F.col("status") == PASSED), n) * 100, 1), F.lit(100.0))
    return found.agg(*[F.count_if(F.col("status") == s).alias(s) for s in (PASSED, FAILED, SKIPPED)], pct.alias("success_pct"))


def run_suite(df: DataFrame, rules: Sequence[Rule], table: str = "") -> Report:
    rows = sorted(outcomes(df, rules).collect(), key=lambda o: o["place"])  # a row per rule
    why = lambda r, o: "missing column" if o["status"] in (FAILED, SKIPPED) and _expected(r, set(df.columns)) else f"{o['rows']} rows" if r.kind == "row_count" else ""
    return Report(table, [Outcome(rules[o["place"]], o["status"], o["failed_count"], why(rules[o["place"]], o)) for o in rows])


def quality_record(df: DataFrame, table: str, not_null: Sequence[str] = (), ranges: Sequence[tuple[str, float, float]] = (), references: Sequence[tuple[str, DataFrame, str]] = (), keys: Sequence[str] = ()) -> DataFrame:
    """One row of what is wrong with a table: ``table_name, total_rows, null_count, range_count, reference_count, duplicate_count, total_failed, passed``.

    Counts are of nulls in ``not_null``, values outside ``ranges``, rows whose reference has
    no parent and rows beyond the first of a key; ``total_failed`` is their sum.
    """
    add = lambda cols: reduce(lambda a, b: a + b, cols, F.lit(0).cast("bigint"))
    x = df.agg(
        F.count(F.lit(1)).alias("total_rows"), add([F.count_if(F.col(c).isNull()) for c in not_null]).alias("null_count"),
        add([out_of_range(c, lo, hi) for c, lo, hi in ranges]).alias("range_count"),
    )
    missing = [orphan_keys(df, fk, parent, pk).agg(F.count(F.lit(1)).alias("n")).scalar() for fk, parent, pk in references]
    x = x.withColumns({"reference_count": add(missing), "duplicate_count": duplicate_excess(df, list(keys)).scalar() if keys else F.lit(0).cast("bigint")})
    total = F.col("null_count") + F.col("range_count") + F.col("reference_count") + F.col("duplicate_count")
    return x.select(F.lit(table).alias("table_name"), *x.columns, total.alias("total_failed"), (total == 0).alias("passed"))


def compile_rules(spec: Mapping, thresholds: bool = False) -> list[Rule]:
    """Rules of one table of a rule file: not_null, range, unique and the least row count.

    With ``thresholds`` the shares of nulls and duplicates that are declared are rules too.
    """
    rules = [Rule("not_null", (c,)) for c in spec.get("not_null", [])]
    rules += [Rule("between", (r["column"],), r["min"], r["max"]) for r in spec.get("range", [])]
    rules += [Rule("unique", tuple(u)) for u in spec.get("unique", [])]
    t = spec.get("thresholds", {})
    if "min_row_count" in t:
        rules.append(Rule("row_count", (), t["min_row_count"]))
    if thresholds:
        rules += [Rule("max_null_pct", (c,), high=t["max_null_pct"]) for c in spec.get("not_null", []) if "max_null_pct" in t]
        rules += [Rule("max_duplicate_pct", tuple(u), high=t["max_duplicate_pct"]) for u in spec.get("unique", []) if "max_duplicate_pct" in t]
    return rules


def load_rules(path: str) -> dict[str, list[Rule]]:
    """Rules per table of a YAML file with ``tables: {name: {...}}``."""
    import yaml

    with open(path) as f:
        spec = yaml.safe_load(f) or {}
    return {name: compile_rules(t or {}) for name, t in spec.get("tables", {}).items()}


def run_all(tables: Mapping[str, DataFrame], rules: Mapping[str, Sequence[Rule]]) -> dict[str, Report]:
    """Suites of the tables that are registered under the rules' names."""
    return {name: run_suite(tables[name], r, name) for name, r in rules.items() if name in tables}
