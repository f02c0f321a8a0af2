"""The filter audit against its SQL and against plain sets, galloping merges, and odd cases."""

from __future__ import annotations

import re
from itertools import permutations
from pathlib import Path

import duckdb
import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tests.llm.test_llm_operators import LONG, ODD, frame
from tests.test_sql_parity import rows
from tramaline.llm import filter_audit, queries

SF = "/root/testdata/sf0.001"
IDS = st.lists(st.integers(0, 300), max_size=200).map(lambda x: np.array(sorted(set(x)), np.int64))


@given(IDS, IDS)
def test_merges_gallop_right(a, b):
    assert filter_audit.places(a, b).tolist() == np.searchsorted(b, a).tolist()
    assert filter_audit.places(a, b, stride=3).tolist() == np.searchsorted(b, a).tolist()
    assert filter_audit.without(a, b).tolist() == sorted(set(a.tolist()) - set(b.tolist()))


@given(st.lists(IDS, max_size=5))
def test_unions(lists):
    assert filter_audit.union(lists).tolist() == sorted(set().union(*(x.tolist() for x in lists)))


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the given tables")
def test_same_rows_as_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    got = queries.QUERIES["op13_filter_audit"](spark, SF).toPandas()
    want = con.execute(queries.ORACLE_SQL["op13_filter_audit"]).df()
    assert list(got.columns) == list(want.columns) and rows(got) == rows(want)


def fails(docs):
    """Letters that each of the rows (doc_id, text, lang) fails, one by one."""
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, t, _ in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tests = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and first[t] < i}
        yield {k for k, v in tests.items() if v}


def brute(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, x in labels if x == 1} - {None}
    letters = list(fails(docs))
    out = {}
    for part in {p or "" for _, _, p in docs}:
        own = [(i, f) for (i, _, p), f in zip(docs, letters, strict=True) if (p or "") == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for s, x in enumerate(order, 1):
                gone = [r for r in left if x in r[1]]
                left = [r for r in left if x not in r[1]]
                total[x] += len(gone)
                failing = sum(x in f for _, f in own)
                out[part, order, s] = [len(left), len(gone), failing - len(gone), sum(f == {x} for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, s), v in out.items():
            if p == part:
                v.append(total[order[s - 1]])
    return out


def result(df):
    return {(r[0], r[1], r[2]): list(r)[3:] for r in df.collect()}


def test_odd_rows(spark):
    texts = [*ODD, (10, "ABC def " * 3), (11, "a | b"), (12, LONG * 3 + " #"), (13, LONG * 3 + " #"), (14, "word word\x1cx " * 250), (15, "É" * 30 + "E")]
    docs = [(i, t, (None, "", "en", "de")[k % 4]) for k, (i, t) in enumerate(texts)]
    labels = [(1, 1, 0), (4, 1, 1), (4, 0, 0), (5, None, 1), (None, 1, 1), (11, 1, None), (13, 1, 0)]
    df = spark.createDataFrame([(*r, "s", 1, 2) for r in docs], "doc_id bigint, text string, lang string, part string, A int, first int")
    got = filter_audit.audit_filters(df, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert result(got) == brute(docs, labels)


def test_ranges_end_within_parts(spark):
    rng = np.random.default_rng(4)
    flags = [(f"p{k % 3}", k // 2, *(bool(x) for x in rng.random(4) < 0.4)) for k in range(700)]
    df = spark.createDataFrame(flags, "part string, doc_id int, x boolean, y boolean, z boolean, m boolean")
    for span in (1, 50, 10_000):
        for r in filter_audit.difference_sizes(df, ["x", "y", "z"], ["m"], span=span).collect():
            own = [f[2:] for f in flags if f[0] == r.part]
            left = [f for f in own if f[r.filter] and not any(f[i] for i in range(3) if r.before >> i & 1)]
            assert (r.n, r.n_fail, r.n_removed, r.n_m) == (len(own), sum(f[r.filter] for f in own), len(left), sum(f[3] for f in left))


def test_empty_tables(spark):
    docs, labels = frame(spark, [(1, "a"), (2, "a")]), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit_filters(docs.limit(0), labels).count() == 0
    got = result(filter_audit.audit_filters(docs, labels))
    assert len(got) == 600 and got["en", "EABCD", 1] == [1, 1, 0, 0, 0, 0, 60] and got["en", "EABCD", 2] == [0, 1, 1, 1, 0, 0, 180]
