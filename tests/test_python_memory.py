"""What travels to Python and is held there: few pages' blocks, and only texts that may have accents."""

from __future__ import annotations

from tramaline.functions.text import nude_form
from tramaline.sources.html import html_segments


def test_blocks_of_few_pages_are_held(spark):
    pages = spark.range(0, 250, 1, 1).selectExpr("id as page_id", "if(id % 2 = 0, concat('<p>page ', id, '</p><p>end</p>'), null) as html")
    found = html_segments(pages)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 250 and found.where("seq = 1 and text = 'end'").count() == 125


def test_plain_texts_stay(spark):
    forms = spark.createDataFrame([(0, "A  b"), (1, "É  à"), (2, None), (3, "")], "i int, t string").select("i", nude_form("t").alias("f"))
    assert "CASE WHEN" in forms._jdf.queryExecution().optimizedPlan().toString()
    assert [r.f for r in forms.orderBy("i").collect()] == ["a b", "e a", None, ""]
