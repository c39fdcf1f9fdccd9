"""Every registered query with SQL gives the same rows in DuckDB; the library stands without the llm folders."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = Path(__file__).resolve().parent.parent


def canonical(frame):
    def one(v):
        if pd.isna(v):
            return "~"
        if isinstance(v, float):
            return f"{v:.6g}"
        s = str(v).replace(" 00:00:00", "")
        try:
            return f"{float(s):.6g}" if s.lower() not in ("nan", "inf") else s
        except ValueError:
            return s

    return sorted(tuple(one(v) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    got, want = entry.queries()[name](spark, sf).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def both(spark, name, sf):
    """A query's rows over a folder's events and those of its SQL."""
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{sf}/events.parquet/*.parquet')")
    got, want = entry.queries()[name](spark, sf).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    return canonical(got), canonical(want)


@pytest.mark.parametrize("name", ["stream_surges", "stream_surges_as_of"])
def test_a_month_without_surges_is_an_empty_table(spark, tmp_path, name):
    spark.sql(
        """select id as event_id, cast(timestamp'2024-01-01 00:30:00' + make_interval(0, 0, 0, 0, id) as timestamp_ntz) as ts, 0L as user_id,
        'view' as event_type, 50D as value, '{"k": 1}' as props from range(720)"""
    ).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert both(spark, name, str(tmp_path)) == ([], [])


@pytest.mark.parametrize("name", ["stream_surges", "stream_surges_as_of", "stream_daily_counts"])
def test_no_row_of_many_files_is_late(spark, sf, tmp_path, name):
    spark.read.parquet(f"{sf}/events.parquet").repartition(12, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")  # each file is a task, and so a file of every span
    try:
        got, want = both(spark, name, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == want and got


@pytest.mark.parametrize("name", ["stream_surges_as_of", "stream_theme_rollup"])
def test_spans_without_rows(spark, sf, tmp_path, name):
    events = spark.read.parquet(f"{sf}/events.parquet").where("ts not between '2024-01-08' and '2024-01-24'")
    events.write.parquet(f"{tmp_path}/events.parquet")
    got, want = both(spark, name, str(tmp_path))
    assert got == want and got


def test_surges_of_no_events(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/events.parquet").limit(0).write.parquet(f"{tmp_path}/events.parquet")
    assert both(spark, "stream_surges_as_of", str(tmp_path)) == ([], [])


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_without_llm(tmp_path):
    shutil.copytree(
        ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__")
    )
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(n.startswith('op') for n in q) and set(e.oracle_sql()) <= set(q); print(len(q))"
    run = subprocess.run(
        [sys.executable, "-c", code], cwd=tmp_path / "repo", env=os.environ | {"PYTHONPATH": str(tmp_path / "repo")},
        capture_output=True, text=True
    )
    assert run.returncode == 0, run.stderr
