"""Windows of hot minimizers: decided without bringing equal ones together in one task."""

from __future__ import annotations

import pytest

from tests.llm.test_llm_operators import frame, prose, removed_brute
from tramaline.llm import suffix_repeats


def test_hot_windows_skip_suffix_arrays(spark, monkeypatch):
    passage = prose(5000, 60)
    docs = [(i, prose(5100 + i, 25) + " " + passage + " " + prose(5300 + i, 25)) for i in range(120)]
    strings = spark.sparkContext.accumulator(0)
    arrays = suffix_repeats._suffix_arrays

    def counted(length):
        run = arrays(length)

        def told(batches):
            def each():
                for b in batches:
                    strings.add(b.num_rows)
                    yield b

            yield from run(each())

        return told

    monkeypatch.setattr(suffix_repeats, "_suffix_arrays", counted)
    got = suffix_repeats.remove_repeats(frame(spark, docs), hot=1).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == removed_brute(docs, suffix_repeats.LENGTH)
    # before, each edge window of the passage went there once per document
    assert strings.value < len(docs)


def test_hot_windows_are_shuffled_once(spark):
    """Every window but the first of its kind is told, over one shuffle of (window, place)."""
    length, one = 100, (prose(77, 60) * 2)[:180]
    texts = [(k, (prose(900 + k, 20) + one)[-(190 + k) :].encode()) for k in range(40)]
    rows = [(k, t, [(5, (0 << 9) | ((len(t) - length + 1) << 1), True, True)]) for k, t in texts]
    runs = spark.createDataFrame(rows, "key long, text binary, runs array<struct<m: long, at: long, first: boolean, hot: boolean>>").repartition(5)
    seen, want = set(), []
    for k, t in texts:
        for i in range(len(t) - length + 1):
            if t[i : i + length] in seen:
                want.append((k, i, i + length))
            seen.add(t[i : i + length])
    made = suffix_repeats._hot_stretches(runs, length)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert len(want) > 1000 and sorted(map(tuple, made.collect())) == want


@pytest.mark.parametrize("twice", [False, True])
def test_texts_are_shuffled_once(spark, monkeypatch, twice):
    """Runs are made where the texts are read; strings, hot windows and what is kept share one shuffle of the texts."""
    passage = prose(6000, 60)
    docs = [(i, prose(6100 + i, 25) + " " + passage + " " + prose(6300 + i, 25)) for i in range(40)]
    plans, cut = [], suffix_repeats.cut
    plan_of = lambda df: df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]

    def told(df, name="cut"):
        plans.append(plan_of(df))
        return cut(df, name)

    monkeypatch.setattr(suffix_repeats, "cut", told)
    made = suffix_repeats.remove_repeats(frame(spark, docs + docs[:1] * twice), hot=1)
    got = made.collect()
    assert len(got) == len(docs) + twice
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == removed_brute(docs, suffix_repeats.LENGTH)
    lines = [x for p in [*plans, plan_of(made)] for x in p.splitlines() if "Exchange hashpartitioning(key#" in x and "REPARTITION_BY_NUM" in x]
    assert (sum("ReusedExchange" not in x for x in lines), sum("ReusedExchange" in x for x in lines)) == (1, 2)
