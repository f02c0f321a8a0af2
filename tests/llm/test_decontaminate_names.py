"""Columns of any name go through decontamination, on both paths."""

from __future__ import annotations

import pytest

from tramaline.llm import decontaminate


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_clashing_names(spark, most):
    names = ["_key", "_found_n_words", "_found_contaminated", "key", "KEY_", "found", "Foundn_words", "contaminated", "hits", "hash", "item"]
    leak = " ".join(f"word{k}" for k in range(12))
    rows = [(1, f"before {leak} after", *names), (2, "clean text", *names), (3, None, *names), (None, leak, *names)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"{c} string" for c in names))
    bench = spark.createDataFrame([("i", leak)], "item_id string, text string")
    kept = decontaminate.drop_contaminated(docs, bench, max_broadcast_bytes=most)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == [tuple(rows[1]), tuple(rows[2])]
