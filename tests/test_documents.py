"""A document's memory, its contexts and its admission, case by case."""

from __future__ import annotations

import pytest

from tramaline.operators.admission import admission
from tramaline.operators.memory import distinct_texts, document_memory, harmonised, neighbours


def test_distinct_texts_as_first_seen(spark):
    rows = [("d", 3, "b"), ("d", 1, "a"), ("d", 2, "42"), ("d", 4, "a"), ("e", 1, "b"), ("d", 5, None), ("d", 6, "c")]
    got = {(r.doc, r.seq): r.place for r in distinct_texts(spark.createDataFrame(rows, "doc string, seq int, text string"), ["doc"], ["seq"]).collect()}
    assert got == {("d", 1): 1, ("d", 2): None, ("d", 3): 2, ("d", 4): 1, ("d", 5): None, ("d", 6): 3, ("e", 1): 1}


def test_one_translation_per_text(spark):
    rows = [("d", 1, "x", "X1"), ("d", 2, "x", "X2"), ("d", 3, "x", "X2"), ("d", 4, "x", None), ("d", 5, "y", "Y"), ("d", 6, "y", "y"), ("d", 7, "z", "Z2"), ("d", 8, "z", "Z1"), ("d", 9, " ", "p"), ("d", 10, " ", "q"), ("e", 1, "x", "X1")]
    out = harmonised(spark.createDataFrame(rows[::-1], "doc string, seq int, text string, translation string"), ["doc"], ["seq"])
    assert out.columns == ["doc", "seq", "text", "translation"]
    got = {(r.doc, r.seq): r.translation for r in out.collect()}
    assert [got["d", k] for k in range(1, 11)] == ["X2", "X2", "X2", None, "y", "y", "Z2", "Z2", "p", "q"] and got["e", 1] == "X1"


def test_document_memory(spark):
    long = "w" * 121
    rows = [(1, "[[0]]A[[/0]]", "a1", False), (2, "A", "a2", False), (3, "[[0]]A[[/0]]", "a3", False), (4, "B", "b0", True), (5, "B", None, False), (6, "B", "b1", False), (7, "B", "b2", None), (8, long, "l1", False), (9, long, "l2", False), (10, "Tax :", "t1", False), (11, "Tax:", "t2", False), (12, "[[1]][[/1]]", "e", False), (13, "[[1]][[/1]]", "f", False), (14, "a", "low", False)]
    df = spark.createDataFrame([("d", *r) for r in rows], "doc string, seq int, tagged string, translation string, failed boolean")
    got = {r.seq: r.served for r in document_memory(df, ["doc"], ["seq"], failed="failed").collect()}
    assert {k: v for k, v in got.items() if v} == {3: "a1", 7: "b1", 11: "t1"}


def test_neighbours(spark):
    rows = [("d", k, t, k in (2, 4, 6)) for k, t in enumerate(["far", "one  before", "two", "mid", "four", "7", "six", "one before"])]
    df = spark.createDataFrame(rows, "doc string, seq int, text string, wanted boolean")
    assert [r.text for r in neighbours(df, ["doc"], ["seq"], "wanted").orderBy("place").collect()] == ["one before", "mid"]
    # the first that doesn't fit ends the list
    more = spark.createDataFrame([("d", k, t, True) for k, t in enumerate(["aa", "bbbb", "cc", "dd"])], "doc string, seq int, text string, wanted boolean")
    assert [r.text for r in neighbours(more, ["doc"], ["seq"], "wanted", most=6).orderBy("place").collect()] == ["bbbb", "aa"]
    assert [r.text for r in neighbours(more, ["doc"], ["seq"], "wanted", most=5).orderBy("place").collect()] == ["bbbb"]
    assert [r.text for r in neighbours(more, ["doc"], ["seq"], "wanted", each=3).orderBy("place").collect()] == ["bbb", "aa", "cc", "dd"]


ASKED = {"pages_asked": 10, "pages_paid": 0, "free": True, "plan_left": 4, "credits": 3, "verified": True, "resumes": False, "risk": None, "free_mode": False, "free_used": 0, "format": "docx", "covered_only": False}


@pytest.mark.parametrize("change, want", [
    ({}, ("refused", "need_credits", 0, 0, 0, 0, 3, False)),
    ({"pages_asked": 7}, ("full", None, 7, 0, 4, 3, 0, False)),
    ({"pages_asked": 3}, ("full", None, 3, 0, 3, 0, 0, False)),
    ({"plan_left": None}, ("full", None, 10, 0, 10, 0, 0, False)),
    ({"pages_paid": 4}, ("full", None, 6, 0, 4, 2, 0, False)),
    ({"format": "pdf"}, ("refused", "need_credits", 0, 0, 0, 0, 3, True)),
    ({"format": "pdf", "covered_only": True}, ("partial", None, 7, 0, 4, 3, 3, True)),
    ({"covered_only": True}, ("refused", "need_credits", 0, 0, 0, 0, 3, False)),
    ({"format": "pdf", "covered_only": True, "pages_paid": 1}, ("refused", "need_credits", 0, 0, 0, 0, 2, False)),
    ({"risk": "device"}, ("refused", "free_limit_device", 0, 0, 0, 0, 7, False)),
    ({"risk": "device", "free": False}, ("refused", "need_credits", 0, 0, 0, 0, 3, False)),
    ({"free_mode": True}, ("preview", None, 7, 3, 4, 3, 3, False)),
    ({"free_mode": True, "free_used": 17}, ("preview", None, 7, 3, 4, 3, 3, False)),
    ({"free_mode": True, "free_used": 18}, ("refused", "free_mode_limit", 0, 0, 0, 0, 3, False)),
    ({"free_mode": True, "resumes": True}, ("refused", "need_credits", 0, 0, 0, 0, 3, False)),
    ({"resumes": True, "verified": False, "credits": 0, "pages_asked": 2}, ("refused", "verify_email", 0, 0, 0, 0, 0, False)),
    ({"resumes": True, "verified": False, "credits": 1, "pages_asked": 2}, ("full", None, 2, 0, 2, 0, 0, False)),
    ({"credits": None, "plan_left": 10, "risk": None, "free_mode": None}, ("full", None, 10, 0, 10, 0, 0, False)),
])
def test_admission(spark, change, want):
    schema = "pages_asked int, pages_paid int, free boolean, plan_left int, credits int, verified boolean, resumes boolean, risk string, free_mode boolean, free_used int, format string, covered_only boolean"
    row = admission(spark.createDataFrame([tuple((ASKED | change).values())], schema)).first()
    assert tuple(row)[-8:] == want
