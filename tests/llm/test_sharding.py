"""Histogram sort: exact slots, near equal shards, texts kept together, frequent rows parted, odd cases."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm_operators import ODD, frame, prose
from tramaline.llm import queries, sharding

SF = "/root/testdata/sf0.01"


def shards_of(out):
    """{shard: rows}, after the slots have been looked at: 0, 1, 2, ... in each."""
    found = defaultdict(list)
    for r in out.collect():
        found[r.shard].append(r)
    for rows in found.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    return found


def near_equal(found, shards, tolerance=0.01):
    """Each shard's size departs from the mean by twice the tolerance or the largest row at most."""
    sizes = [sum(r.size for r in found.get(i, ())) for i in range(shards)]
    mean, largest = sum(sizes) / shards, max(r.size for rows in found.values() for r in rows)
    return max(abs(s - mean) for s in sizes) <= max(2 * tolerance * mean, largest)


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the given tables")
def test_whole_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = shards_of(queries.QUERIES["op11_sharding"](spark, SF))
    rows = [r for x in found.values() for r in x]
    assert sorted(r.doc_id for r in rows) == sorted(docs) and set(found) == set(range(40)) and near_equal(found, 40)
    for r in rows:
        b = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(b) + 16, zlib.crc32(b), "bytes", None)


def test_texts_stay_together_if_they_fit(spark):
    docs = frame(spark, [(i, prose(i // 5, 20)) for i in range(4000)])
    found = shards_of(sharding.shard(docs, shards=8))
    assert near_equal(found, 8)
    places = defaultdict(set)
    for s, rows in found.items():
        for r in rows:
            places[r.text].add(s)
    assert max(map(len, places.values())) == 1


def test_order_is_that_of_the_key(spark):
    """Across shards and slots rows ascend, whatever pieces a shard is sorted in."""
    docs = frame(spark, [(i % 90, prose(i % 70, 1 + i % 9)) for i in range(600)])
    keyed = sharding.shard(docs, shards=5, pieces=7)
    rows = keyed.select("shard", "slot", F.xxhash64("text").alias("h"), "doc_id").collect()
    rows.sort(key=lambda r: (r.shard, r.slot))
    assert [(r.h, r.doc_id) for r in rows] == sorted((r.h, r.doc_id) for r in rows)


@pytest.mark.parametrize("copies", ["ids", "rows"])
def test_a_text_of_a_third_of_all_rows(spark, copies):
    """Copies are spread, by doc_id or, where whole rows repeat, by their number; no row is lost."""
    rows = [(i if copies == "ids" else 7, "the same text") for i in range(10_000)] + [(i, prose(i, 3)) for i in range(20_000, 40_000)]
    found = shards_of(sharding.shard(frame(spark, rows), shards=30))
    assert near_equal(found, 30)
    assert Counter((r.doc_id, r.text) for x in found.values() for r in x) == Counter(rows)
    assert len([s for s, x in found.items() if any(r.text == "the same text" for r in x)]) >= 6


def test_extreme_ids(spark):
    low, high = -(1 << 63), (1 << 63) - 1
    rows = [(x, "t") for i in range(40) for x in (low + i, high - i, i)]
    found = shards_of(sharding.shard(frame(spark, rows), shards=6))
    assert [len(found[i]) for i in range(6)] == [20] * 6


def test_odd_rows(spark):
    docs = frame(spark, ODD, "doc_id bigint, text string, lang string, source string, h bigint, key string, slot int, piece string").withColumn("m", F.create_map(F.lit("a"), "doc_id"))
    out = sharding.shard(docs, shards=3, pieces=2)
    assert out.columns == ["doc_id", "text", "lang", "source", "h", "key", "piece", "m", "size", "shard", "slot"]
    found = shards_of(out)
    assert Counter((r.doc_id, r.text, r.key, r.piece) for x in found.values() for r in x) == Counter((i, t, "k", "x") for i, t in ODD)
    assert all(r.size == 16 + len((r.text or "").encode()) for x in found.values() for r in x)


def test_fewer_rows_than_shards(spark):
    docs = frame(spark, [(1, "a"), (2, "b" * 1000)])
    found = shards_of(sharding.shard(docs, shards=10))
    assert sum(map(len, found.values())) == 2 and set(found) <= set(range(10))
    assert sharding.shard(docs.limit(0)).count() == 0 and sharding.shard(docs.where("doc_id = 1"), shards=4).count() == 1
