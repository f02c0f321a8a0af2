"""Folds over pages and users: no pandas frame for each group, and pages that can't be cut end."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tramaline.operators.folds import apply_plans
from tramaline.operators.layout import page_order, reading_order, stacked_blocks


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("of", [reading_order, stacked_blocks])
def test_pages_are_streamed(spark, of):
    boxes = spark.range(1000).select((F.col("id") % 200).alias("page"), F.col("id").alias("seq"), F.lit(0).alias("x0"), (F.col("id") * 10).alias("y0"), F.lit(50).alias("x1"), (F.col("id") * 10 + 8).alias("y1"), F.lit(False).alias("bullet"))
    found = of(boxes, ["page"])
    assert "FlatMapGroups" not in plan_of(found)
    assert found.count() == 1000


def test_a_missing_edge_comes_last(spark):
    boxes = spark.createDataFrame([(1, 0, 0.0, None, 5.0, 1.0, False), (1, 1, 0.0, 0.0, 5.0, 1.0, False), (1, 2, 0.0, 1.1, 5.0, 2.1, False)], "page int, seq long, x0 double, y0 double, x1 double, y1 double, bullet boolean")
    assert {r.seq: r.block for r in stacked_blocks(boxes, ["page"]).collect()} == {1: 0, 2: 0, 0: 1}


def test_users_are_streamed(spark):
    paid = spark.createDataFrame([(7, 1, "pro", 1, 1990, "2024-01-31 10:00:00"), (7, 2, "pro", 12, 1990, "2024-02-01 10:00:00"), (8, 3, "pro", 1, 1990, None)], "user_id long, payment_id long, plan string, months int, price int, created_at string")
    out = apply_plans(paid.withColumn("created_at", F.col("created_at").cast("timestamp")), {"starter": 1, "pro": 2})
    assert "FlatMapGroups" not in plan_of(out)
    got = {r.payment_id: (r.kind, r.expires_at and str(r.expires_at)) for r in out.select("payment_id", "kind", F.col("expires_at").cast("string").alias("expires_at")).collect()}
    assert got == {1: ("subscription", "2024-02-29 10:00:00"), 2: ("renewal", "2025-02-28 10:00:00"), 3: ("subscription", None)}


def test_boxes_without_extent_end():
    # ten thousand boxes on a line, none of which parts the page
    boxes = np.array([[i % 7, i % 5, i % 7, i % 5 + i % 3] for i in range(10_000)], float)
    assert sorted(page_order(boxes)) == list(range(10_000))
