"""Queries against their SQL on rows that share a time, which the given tables hardly have."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from tramaline.plans import registry


def test_requests_at_one_time_count_those_before(spark, tmp_path):
    # 40 requests at 8 times, some of them of one account
    events = spark.range(40).select(F.col("id").alias("event_id"), F.expr("timestamp '2024-01-01' + make_dt_interval(0, 0, 0, id % 8 * 130)").alias("ts"), F.expr("id % 7").alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("").alias("props"))
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got = registry.queries()["rate_windows"](spark, str(tmp_path)).select("kind", "event_id", "n").collect()
    want = con.execute(f"select kind, event_id, n from ({registry.oracle_sql()['rate_windows']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
