"""What queries leave on the disks while they run."""

import os
import time

import check
import duckdb
import pytest

import coincide.plans.text_queries  # noqa: F401  (registers its queries)
import oracle
import oracle_text  # noqa: F401  (registers its SQL)
from coincide.plans.queries import QUERIES
from coincide.session import durable


def shuffle_files(spark):
    """Shuffle files of this session by name, with their bytes."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    found = [f for f in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f]
    return {f: os.path.getsize(f) for f in found if os.path.exists(f)}


def left_over(spark, before, seconds=20):
    """Files that are new since ``before`` and stay; Spark deletes them in the background."""
    until = time.time() + seconds
    while (new := shuffle_files(spark).keys() - before.keys()) and time.time() < until:
        time.sleep(0.2)
    return new


def test_a_stage_table_replaces_its_shuffles(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    configured, before = spark.conf.get(key, None), shuffle_files(spark)
    rows = spark.range(20_000).selectExpr("id % 5000 AS k").groupBy("k").count()
    stage = durable(rows)
    assert not left_over(spark, before)
    assert stage.count() == 5000 and stage.filter("count <> 4").count() == 0
    assert rows.count() == 5000, "what was written can still be computed"
    assert spark.conf.get(key, None) == configured


def odd_events(folder):
    """Passes, errors and views with many equal times, in two groups a day apart."""
    con = duckdb.connect()
    con.execute(f"""COPY (
        SELECT i AS event_id, TIMESTAMP '2024-01-05 00:00:00' + to_seconds((i * 37 % 700) * 4 + (i % 2) * 86400) AS ts, i % 23 AS user_id,
          ['purchase', 'error', 'view', 'error', 'click'][1 + (i * i + i // 7) % 5] AS event_type, 1.0 AS value,
          '{{"k": ' || (i * 7 % 100) || '}}' AS props
        FROM range(1200) t(i)) TO '{folder}/events.parquet' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet')")
    return con


@pytest.mark.parametrize("name", ["jn10_match_table", "snk01_correlation"])
def test_matches_keep_no_shuffle_of_their_stages(spark, tmp_path, name):
    """Right rows, and nothing but stage tables on the disks when the last query starts."""
    con = odd_events(tmp_path)
    before = shuffle_files(spark)
    df = QUERIES[name](spark, str(tmp_path))
    assert not left_over(spark, before)
    want = con.sql(oracle.ORACLE[name])
    columns, rows = want.columns, want.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert check.rows_of(df.columns, [tuple(r) for r in df.collect()]) == check.rows_of(columns, rows)
    assert len(rows) > 100
