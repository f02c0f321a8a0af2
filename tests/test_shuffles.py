"""Queries that need no shuffle of words, and no set of parts for each document."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tramaline.operators.layout import column_gutters, line_gutters, ocr_lines
from tramaline.plans import registry

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_of_words_are_read_where_they_are(spark):
    assert "Exchange" not in plan_of(registry.queries()["ocr_lines"](spark, SF))


def test_only_folios_are_shuffled(spark):
    plan = plan_of(registry.queries()["trailing_folios"](spark, SF))
    assert plan.count("Exchange") == 1 and "Generate" in plan


@pytest.mark.parametrize("key", ["pages_done", "resume_discount"])
def test_parts_are_bits(spark, key):
    plan = plan_of(registry.queries()[key](spark, SF))
    assert "distinct" not in plan and "bit_or" in plan


def test_words_without_confidence(spark):
    words = spark.createDataFrame([(1, 1, "b", 9, 12, None), (1, 0, "a", 1, 4, 80), (2, 0, "c", 1, 2, None)], "line int, pos int, token string, x int, x1 int, conf int")
    assert [tuple(r) for r in ocr_lines(words, ["line"], "pos").collect()] == [(1, "a b", 1, 12, 80.0)]


def test_documents_with_refunds_and_odd_parts(spark, tmp_path):
    spark.createDataFrame([(1,), (2,)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    rows = [(1, 7, 3.0, "N"), (1, 57, 4.0, "R"), (1, -7, 5.0, "N"), (1, 49, 1.0, "N"), (2, None, 2.0, "R"), (2, 0, 9.0, None)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_quantity double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = lambda key: sorted(tuple(r) for r in registry.queries()[key](spark, str(tmp_path)).collect())
    assert got("pages_done") == [(1, 3)]
    assert got("resume_discount") == [(1, 3), (2, 1)]


def test_gutters_shuffle_no_word(spark, tmp_path):
    """Lines that have their words in a row send edges and blanks to the page's task, and give what words by themselves give."""
    rows = [("p", n, 12.0 * n, 12.0 * n + 10, [(float(40 * i + (7 * n * i) % 11), float(40 * i + 28), 5.0 + (i % 3)) for i in range(200 if n == 3 else 9)][::-1]) for n in range(12)]
    lines = spark.createDataFrame(rows, "page string, line int, top double, bottom double, words array<struct<x0: double, x1: double, glyph: double>>")
    made = line_gutters(lines, ["page"])
    plan = plan_of(made)
    assert plan.count("Exchange hashpartitioning") == 1
    words = lines.selectExpr("page", "line", "top", "bottom", "inline(words)")
    got = sorted(map(tuple, made.collect()))
    assert got and got == sorted(map(tuple, column_gutters(words, ["page"]).collect()))
    none = lines.selectExpr("page", "line", "top", "bottom", "slice(words, 1, 0) as words")
    assert line_gutters(none, ["page"]).collect() == []
