"""Keyed state of streams, batch by batch: what is appended when, out-of-order and repeated rows, and that state goes."""

from __future__ import annotations

import os
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tramaline.streaming.states import balance_watch, busy_minutes, error_digests, page_bounds, settled_payments, sliding_counts

BEGIN = datetime(2024, 5, 1, 12)


def at(minutes: float) -> datetime:
    return BEGIN + timedelta(minutes=minutes)


def streamed(spark, tmp_path, operator, schema, batches, late="10 minutes"):
    """The rows that the operator appends over the batches, and the number of state rows after the last one.

    A last batch, a day later and of a key of its own, moves the watermark past all timers of the others.
    """
    folder = tmp_path / uuid.uuid4().hex
    for k, rows in enumerate(batches):
        part = f"{folder}/in/{k}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(part)
        for f in os.listdir(part):
            os.utime(f"{part}/{f}", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*").withWatermark("ts", late)
    query = operator(stream).writeStream.option("checkpointLocation", f"{folder}/state").format("parquet").option("path", f"{folder}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    states = [op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]]
    return [tuple(r) for r in spark.read.parquet(f"{folder}/out").collect()], states[-1], max(states)


PAYMENTS = "payment string, ts timestamp, n int, status string"


def pay(stream):
    return settled_payments(stream, "payment", "status", "n", keep=timedelta(hours=2)).select("payment", "ts", "status", "credited")


def test_a_payment_settles_once(spark, tmp_path):
    rows = [
        [("a", at(0), 1, "PENDING"), ("b", at(1), 2, "SUCCESSFUL"), ("c", at(2), 3, None)],
        [("a", at(3), 4, "SUCCESSFUL"), ("b", at(4), 5, "PENDING"), ("b", at(5), 6, "SUCCESSFUL")],  # late news and a double
        [("a", at(6), 7, "FAILED"), ("d", at(8), 9, "PENDING"), ("d", at(7), 8, "FAILED")],  # terminal status stays; first by time
        [("e", at(3000), 10, "PENDING")],
    ]
    got, last, most = streamed(spark, tmp_path, pay, PAYMENTS, rows)
    assert sorted(got) == [("a", at(3), "SUCCESSFUL", True), ("b", at(1), "SUCCESSFUL", True), ("c", at(2), "PENDING", False), ("d", at(7), "FAILED", False)]
    assert last < most and last <= 2  # of e alone: its status and its timer


def test_batches_make_no_difference(spark, tmp_path):
    rows = [(f"p{k % 5}", at(k * 7), k, ("PENDING", "FAILED", "PENDING", "SUCCESSFUL")[k % 4]) for k in range(60)]
    ends = [("end", at(9000), 99, "PENDING")]
    one = streamed(spark, tmp_path, pay, PAYMENTS, [rows, ends])[0]
    many = streamed(spark, tmp_path, pay, PAYMENTS, [*(rows[k : k + 9] for k in range(0, 60, 9)), ends])[0]
    assert sorted(one) == sorted(many) and len(one) == 5


CALLS = "user string, ts timestamp, n int, page string, kind string"


def test_bounds_of_a_page(spark, tmp_path):
    bound = lambda s: page_bounds(s, "user", "page", "kind", "n", bounds={"batch": 2, "capture": 1}).select("n", "refused")
    rows = [
        [("u", at(0), 1, "p", "batch"), ("u", at(1), 2, "p", "batch"), ("u", at(2), 3, "p", "batch"), ("u", at(3), 4, "q", "batch")],
        [("u", at(4), 5, "p", "capture"), ("u", at(5), 6, "p", "capture"), ("u", at(6), 7, None, "other"), ("v", at(7), 8, "p", "batch")],
        [("u", at(370), 9, "p", "batch"), ("u", at(371), 10, "q", "batch")],  # the page was let through at 4: forgotten
        [("w", at(3000), 11, "p", "batch")],
    ]
    got, last, most = streamed(spark, tmp_path, bound, CALLS, rows)
    assert dict(got) == {1: None, 2: None, 3: "batch", 4: None, 5: None, 6: "capture", 7: None, 8: None, 9: None, 10: None, 11: None}
    assert last < most and last <= 2


def test_refused_calls_dont_keep_a_page_alive(spark, tmp_path):
    bound = lambda s: page_bounds(s, "user", "page", "kind", "n", bounds={"batch": 1}).select("n", "refused")
    rows = [[("u", at(0), 1, "p", "batch"), ("u", at(300), 2, "p", "batch")], [("u", at(359), 3, "p", "batch"), ("u", at(361), 4, "p", "batch")]]
    assert dict(streamed(spark, tmp_path, bound, CALLS, rows)[0]) == {1: None, 2: "batch", 3: "batch", 4: None}


@pytest.mark.parametrize("split", [1, 2, 6])
def test_the_page_unseen_for_longest_makes_room(spark, tmp_path, split):
    bound = lambda s: page_bounds(s, "user", "page", "kind", "n", bounds={"batch": 1}, pages=2).select("n", "refused")
    pages = ["a", "b", "a", "c", "b", "a"]  # c drops the page a, as its second call was refused; b drops nothing
    rows = [("u", at(k), k, p, "batch") for k, p in enumerate(pages)]
    got = streamed(spark, tmp_path, bound, CALLS, [rows[k : k + split] for k in range(0, 6, split)])[0]
    assert dict(got) == {0: None, 1: None, 2: "batch", 3: None, 4: "batch", 5: None}


ERRORS = "source string, ts timestamp, fault string"


@pytest.mark.parametrize("split", [1, 3, 20])
def test_first_error_at_once_then_digests(spark, tmp_path, split):
    digest = lambda s: error_digests(s, "source", "fault")
    faults = [(0, "x"), (5, "y"), (10, "x"), (15, "x"), (20, "z"), (25, "w"), (70, "x"), (200, "y")]
    rows = [("s", at(m), f) for m, f in faults]
    batches = [*(rows[k : k + split] for k in range(0, len(rows), split)), [("t", at(3000), "x")]]
    got, last, most = streamed(spark, tmp_path, digest, ERRORS, batches)
    want = [(at(0), 1, "x:1"), (at(60), 5, "x:2,w:1,y:1"), (at(120), 1, "x:1"), (at(200), 1, "y:1")]
    assert sorted(g[1:] for g in got if g[0] == "s") == want and ("t", at(3000), 1, "x:1") in got
    assert last <= 2 <= most  # the last source's time and timer


def test_a_digest_comes_without_a_further_error(spark, tmp_path):
    """The watermark alone, moved by another source, gives what is held."""
    got = streamed(spark, tmp_path, lambda s: error_digests(s, "source", "fault"), ERRORS, [[("s", at(0), "x"), ("s", at(1), None)], [("t", at(200), "y")]])[0]
    assert ("s", at(60), 1, ":1") in got


def test_sliding_counts(spark, tmp_path):
    minutes = [0, 3, 3, 9, 10, 13.001, 30, 40, 40.0001]
    rows = [("k", at(m), i) for i, m in enumerate(minutes)]
    want = {i: sum(0 <= (at(m) - at(x)) / timedelta(minutes=10) <= 1 for x in minutes[: i + 1]) for i, m in enumerate(minutes)}
    for split in (1, 4, 20):
        batches = [*(rows[k : k + split] for k in range(0, len(rows), split)), [("z", at(3000), 99)]]
        got, last, _ = streamed(spark, tmp_path, lambda s: sliding_counts(s, "key", "n"), "key string, ts timestamp, n int", batches)
        assert {n: c for k, n, c in got if k == "k"} == want and last <= 2


def test_busy_minutes(spark, tmp_path):
    rows = [("a", at(k / 10)) for k in range(25)] + [("b", at(1))]
    got, last, _ = streamed(spark, tmp_path, lambda s: busy_minutes(s, "key", 4), "key string, ts timestamp", [rows, [("z", at(100))]])
    assert sorted(got) == [("a", at(0), 10, 6), ("a", at(1), 10, 6), ("a", at(2), 5, 1)] and last == 1


@pytest.mark.parametrize("split", [1, 3, 20])
def test_balances(spark, tmp_path, split):
    """Low once per crossing; drops of a day, told once a day; what is paid in is no drop."""
    readings = [(0, 9.0), (60, 8.0), (120, 1.5), (180, 1.0), (240, 9.0), (300, 1.0), (600, 0.9), (1700, 5.0), (1800, 1.9), (3300, 0.5)]
    rows = [("k", at(m), i, v) for i, (m, v) in enumerate(readings)]
    batches = [*(rows[k : k + split] for k in range(0, len(rows), split)), [("z", at(9000), 99, 9.0)]]
    got, last, most = streamed(spark, tmp_path, lambda s: balance_watch(s, "key", "balance", "n", spend=7.0), "key string, ts timestamp, n int, balance double", batches)
    lows = [g[1] for g in got if g[2] == "low"]
    assert sorted(lows) == [at(120), at(300), at(1800)]
    spends = sorted((g[1], g[3]) for g in got if g[2] == "spend")
    want, told = [], None
    for i, (m, _) in enumerate(readings):
        spent = round(sum(max(0.0, readings[j - 1][1] - readings[j][1]) for j in range(1, i + 1) if readings[j][0] >= m - 1440), 4)
        if spent > 7 and (told is None or m - told >= 1440):
            told = m
            want.append((at(m), spent))
    assert spends == want and len(want) >= 2
