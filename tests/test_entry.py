"""Every registered query runs, and gives the rows of its SQL where it has one."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tools_compare import norm

SF = "/root/testdata/sf0.001"
REPO = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


def _rows(rows):
    return sorted((tuple(norm(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_rows_equal_those_of_the_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert _rows(df.select(*cols).collect()) == _rows([tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()])


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_queries_without_sql_run(spark, name):
    df = entry.queries()[name](spark, SF)
    assert df.columns and df.count() >= 0


def test_found_queries_have_their_columns(spark):
    want = {
        "p1_found": "ref_table string, period string, row_id bigint, state string", "p2_found": "row_id bigint, pos int, genre string", "p3_found": "line_id bigint, reason string",
        "p4_found": "user_id bigint, valid_from string, valid_to string, country string, plan string", "p5_found": "row_id bigint, plan string, country string",
        "p6_found": "table_name string, row_id bigint, utc_us bigint", "p7_found": "row_id bigint, event_day string, verdict string",
    }
    for name, schema in want.items():
        df = entry.queries()[name](spark, SF)
        assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == schema


def test_flagship_query(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("gone", ["millrace.llm", "millrace.llm.queries", "xxhash", "tiktoken_or_other"])
def test_everything_but_the_text_operators_stands_without_them(gone):
    """Without the subpackage, or without something that it needs."""
    text = "not any(n.startswith(('p8_', 'p9_', 'p10_')) for n in q)" if gone != "tiktoken_or_other" else "True"
    code = f"import sys; sys.modules['{gone}'] = None\nimport __spark_entry__ as e\nq = e.queries()\nassert 'p1_found' in q and 'daily_kpis' in e.oracle_sql() and {text}"
    assert subprocess.run([sys.executable, "-c", code], cwd=REPO, check=False).returncode == 0


def test_nothing_imports_the_text_operators():
    others = [p for p in (REPO / "millrace").rglob("*.py") if "llm" not in p.parts]
    assert not [p for p in others if "millrace.llm" in p.read_text()]


@pytest.mark.parametrize("name", ["ratings", "movies", "users"])
def test_profiles_cover_every_column(spark, name):
    want = set(spark.read.parquet(f"{SF}/{name}.parquet").columns)
    for q in ("column_profile", "column_top5"):
        assert {r["column"] for r in entry.queries()[f"{q}_{name}"](spark, SF).collect()} == want
