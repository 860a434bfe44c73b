import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as e

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry_and_names(spark):
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["ag09_relative_performance_posts", "ag22_tier_mix", "cl10_latest_per_key", "fe16_trending_audio", "lb19_lb20_comment_topics", "rt03_search", "ts02_category_tests", "ml16_lift", "dq01_validate"])
def test_some_queries_against_sql(spark, name):
    got = e.queries()[name](spark, SF)
    db = duckdb.connect()
    db.execute("set timezone = 'UTC'")
    for t in TABLES:
        db.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = db.execute(e.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(repr, want.fetchall())) == sorted(map(repr, map(tuple, got.select(*[f"`{c}`" for c in columns]).collect())))


def test_queries_are_listed_without_a_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
