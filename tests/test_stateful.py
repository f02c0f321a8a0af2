"""Rules with state, case by case: budgets of pages, keyed tables, roots of the store, machines, tag trees."""

from __future__ import annotations

from pathlib import Path

import pytest
from hypothesis import given
from hypothesis import strategies as st

from pyspark.sql import functions as F

from tramaline.functions.tags import elements, same_tree
from tramaline.operators.machines import link_machines
from tramaline.operators.stores import orphan_roots
from tramaline.operators.tables import stored, upsert_latest
from tramaline.operators.usage import PLANS, page_limits

ASKED = "user string, n int, page string, day string, chars bigint, images bigint, plan string, back boolean"


def granted(spark, rows):
    df = spark.createDataFrame([(u, k, *r) for k, (u, *r) in enumerate(rows)], ASKED)
    out = page_limits(df, "user", "page", "day", ["n"], "chars", "images", "plan", returns="back").orderBy("n").collect()
    return [(r.chars_granted, r.images_granted, r.refused) for r in out]


def test_plans():
    assert PLANS["free"] == (30_000, 30, 30) and PLANS["starter"] == (100_000, 80, 150) and PLANS["pro"] == (None, None, 500)


def test_a_grant_is_partial_at_the_bound(spark):
    rows = [("u", "p", "d", 29_000, 2, "free", False), ("u", "p", "d", 2_000, 29, "free", None), ("u", "p", "d", 1, 1, "free", False), ("u", "q", "d", 40_000, None, "starter", False)]
    assert granted(spark, rows) == [(29_000, 2, None), (1_000, 28, "chars"), (0, 0, "chars"), (40_000, 0, None)]
    other = [("u", "p", "d", 10, 40, "free", False), ("v", "p", "d", 10**9, 10**6, "enterprise", False), ("w", None, "d", 30_001, 0, "new", False), ("w", "", "d", 1, 0, None, False)]
    assert granted(spark, other) == [(10, 30, "images"), (10**9, 10**6, None), (30_000, 0, "chars"), (0, 0, "chars")]


def test_pages_of_a_day(spark):
    begun = [("u", f"p{k}", "d1", 1, 0, "free", False) for k in range(30)]
    more = [("u", "new", "d1", 5, 0, "free", False), ("u", "p3", "d1", 5, 0, "free", False), ("u", "new", "d2", 5, 0, "free", False), ("u", "p4", "d2", 1, 0, "free", False), ("v", "new", "d1", 5, 0, "free", False)]
    assert granted(spark, begun + more)[30:] == [(0, 0, "pages"), (5, 0, None), (5, 0, None), (1, 0, None), (5, 0, None)]


def test_what_is_asked_for_nothing_begins_no_page(spark):
    rows = [("u", f"p{k}", "d", 0, 0, "free", False) for k in range(40)] + [("u", "x", "d", 1, 0, "free", False)]
    assert granted(spark, rows)[-1] == (1, 0, None)


def test_giving_all_back_frees_the_page(spark):
    rows = [("u", f"p{k}", "d", 7, 0, "free", False) for k in range(30)]
    back = [("u", "p0", "d", 3, 0, "free", True), ("u", "new", "d", 1, 0, "free", False), ("u", "p0", "d", 9, 5, "free", True), ("u", "new", "d", 1, 0, "free", False), ("u", "p0", "d", 1, 0, "free", False), ("u", "none", "d", 1, 0, "free", True)]
    assert granted(spark, rows + back)[30:] == [(0, 0, None), (0, 0, "pages"), (0, 0, None), (1, 0, None), (0, 0, "pages"), (0, 0, None)]


def test_no_requests(spark):
    assert page_limits(spark.createDataFrame([], ASKED), "user", "page", "day", ["n"], "chars", "images", "plan").count() == 0


def files(path):
    return {str(p) for p in Path(path).glob("part=*/*.parquet")}


def rows_of(spark, path):
    return {(r.k, r.day) for r in stored(spark, path).collect()}


def test_only_touched_parts_are_written(spark, tmp_path):
    path = f"{tmp_path}/t"
    put = lambda rows, batch, **kw: upsert_latest(spark.createDataFrame(rows, "k string, day int"), batch, path, ["k"], "day", parts=8, **kw)
    assert stored(spark, path) is None
    put([(f"k{i}", 1) for i in range(100)] + [(None, 2), (None, 1)], 0)
    first = files(path)
    assert len(first) == 8 and rows_of(spark, path) == {(f"k{i}", 1) for i in range(100)} | {(None, 2)}
    put([("k5", 3), ("k5", 2), ("k7", 0)], 1)
    second = files(path)
    assert rows_of(spark, path) == {(f"k{i}", 3 if i == 5 else 1) for i in range(100)} | {(None, 2)}
    assert 6 <= len(first & second) < 8
    put([("k5", 9), ("k7", 0)], 1)  # the same batch again: nothing changes, no file is written
    assert files(path) == second and ("k5", 3) in rows_of(spark, path)
    put([], 2)
    assert files(path) == second


def test_a_batch_that_was_stopped_half_way(spark, tmp_path):
    path, rows = f"{tmp_path}/t", [(f"k{i}", i) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, day int")
    upsert_latest(df.where("day < 3"), 0, path, ["k"], "day", parts=4)
    upsert_latest(df.where("k = 'k9'"), 1, path, ["k"], "day", parts=4)  # the part of k9 has batch 1, the others don't
    there = {r[0] for r in stored(spark, path).where("batch = 1").select("part").distinct().collect()}
    upsert_latest(df, 1, path, ["k"], "day", parts=4)
    got = rows_of(spark, path)
    assert ("k9", 9) in got and {r for r in got} <= set(rows) and stored(spark, path).where("batch < 1").count() == 0 and len(there) == 1


def test_old_rows_go(spark, tmp_path):
    path = f"{tmp_path}/t"
    df = spark.createDataFrame([("a", 1), ("b", 50)], "k string, day int")
    upsert_latest(df, 0, path, ["k"], "day", parts=1)
    upsert_latest(spark.createDataFrame([("c", 60)], "k string, day int"), 1, path, ["k"], "day", parts=1, keep=F.col("day") >= 30)
    assert rows_of(spark, path) == {("b", 50), ("c", 60)}


def test_roots(spark, capsys):
    roots = spark.createDataFrame([(r,) for r in ("/s/a", "/s/b", "/s/c/", "/s/d.e", "/s/f+", None, "/s")], "root string")
    paths = spark.createDataFrame([(p,) for p in ("/s/a", "/s/b/x/y.pdf", "/s/c/z", "/s/dxe/1", "/s/fff/1", "/s/ab", None)], "path string")
    out = orphan_roots(roots, paths)
    assert {r.root for r in out.collect()} == {"/s/d.e", "/s/f+", None}
    out.explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert orphan_roots(roots, paths.limit(0)).count() == 7


VISITS = "t int, cookie string, copy string, print string"


def machines(spark, rows):
    return {f"{r.kind}:{r.id}": r.machine for r in link_machines(spark.createDataFrame(rows, VISITS), ["t"]).collect()}


def test_strong_ones_join_and_the_oldest_names(spark):
    got = machines(spark, [(5, "z", "y", None), (1, None, "a", None), (7, "z", "a", None), (9, "q", None, None)])
    assert got == dict.fromkeys(("cookie:z", "copy:y", "copy:a"), "copy:a") | {"cookie:q": "cookie:q"}


def test_a_print_never_joins_machines(spark):
    got = machines(spark, [(1, "a", None, "p"), (2, "b", None, "q"), (3, "b", None, "p"), (4, "a", None, "q")])
    assert got == {"cookie:a": "cookie:a", "print:p": "cookie:a", "cookie:b": "cookie:b", "print:q": "cookie:b"}


def test_a_cleared_browser_is_known_by_its_print(spark):
    got = machines(spark, [(1, "a", "b", "p"), (2, "c", "d", "p"), (3, None, None, "p"), (4, None, None, "late"), (5, "e", None, "late")])
    assert set(got[k] for k in ("cookie:a", "copy:b", "cookie:c", "copy:d", "print:p")) == {"cookie:a"}
    assert got["print:late"] == got["cookie:e"] == "print:late"


@pytest.mark.parametrize("target, ok", [
    ("[[1]]x[[2]]y[[/2]][[/1]][[3]] [[/3]]", True), ("[[3]][[/3]][[1]][[2]][[/2]][[/1]]", True), ("[[1]][[/1]][[2]][[/2]][[3]][[/3]]", False),
    ("[[1]][[2]][[/1]][[/2]][[3]][[/3]]", False), ("[[1]][[2]][[/2]][[/1]][[3]]x[[/3]]", False), ("[[1]][[2]][[/2]][[/1]]", False), ("[[/1]]", False),
    ("[[1]][[2]][[/2]][[2]][[/2]][[/1]][[3]][[/3]]", False), ("[[1]][[2]][[/2]][[/1]][[3]]", False), ("", False), (None, False),
])
def test_trees(target, ok):
    assert same_tree(target, "[[1]]a[[2]]b[[/2]][[/1]] c[[3]][[/3]]", [3]) is ok


def test_a_void_holds_no_element():
    assert not same_tree("[[1]][[2]][[/2]][[/1]]", "[[1]][[2]][[/2]][[/1]]", [1]) and same_tree(None, "no tags", None)


@given(st.lists(st.integers(0, 8), max_size=40))
def test_written_trees_are_read(parents):
    """A tree of any shape, written out, gives its elements with their parents."""
    under = {n: (p % n if n else None) for n, p in enumerate(parents)}
    children = {n: [c for c, p in under.items() if p == n] for n in (None, *under)}
    written = lambda n: f"[[{n}]]{''.join(map(written, children[n]))}[[/{n}]]"
    assert {n: p for n, p, _ in elements("".join(map(written, children[None])))} == under


def test_very_deep_trees():
    n = 50_000
    text = "".join(f"[[{k}]]" for k in range(n)) + "".join(f"[[/{k}]]" for k in reversed(range(n)))
    assert same_tree(text, text, None)
