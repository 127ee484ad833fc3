"""Every query with a SQL counterpart gives the same rows on DuckDB."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points
from conftest import SMALL, rows

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def check_plan(df):
    """No cross join, and no window that puts all rows into one task."""
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert not [line for line in text.splitlines() if "Window [" in line and "], []" in line]


@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_same_as_sql(spark, con, name):
    got = entry_points.queries()[name](spark, SMALL)
    check_plan(got)
    rel = con.execute(entry_points.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(got.columns)
    order = [names.index(c) for c in sorted(names)]
    want = [tuple(r[i] for i in order) for r in rel.fetchall()]
    key = lambda t: tuple((x is not None, str(x)) for x in t)
    assert rows(got, *sorted(names)) == sorted(want, key=key)


@pytest.mark.parametrize("name", sorted(set(entry_points.queries()) - set(entry_points.oracle_sql())))
def test_rows_only(spark, name):
    assert entry_points.queries()[name](spark, SMALL).count() > 0


def test_workers_find_the_package_from_any_folder(tmp_path):
    """Python workers get the package from the session, not from the current folder."""
    script = (
        "import sys; sys.path.insert(0, sys.argv[1])\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[4]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "import __spark_entry__ as e\n"
        "for name in ('chunk_recursive', 'stream_retract'):\n"
        "    assert e.queries()[name](spark, sys.argv[2]).count() > 0\n"
    )
    root = str(Path(__file__).resolve().parents[1])
    done = subprocess.run([sys.executable, "-c", script, root, SMALL], cwd=tmp_path, capture_output=True, timeout=300)
    assert done.returncode == 0, done.stderr.decode()[-2000:]


def test_entry(spark):
    out = entry_points.entry(spark)
    assert out.count() > 0
    assert set(out.columns) == {"query_id", "rank", "chunk_id", "score"}
