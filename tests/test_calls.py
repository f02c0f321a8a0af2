"""Calls of a key are held as numbers, in the order of the tuples they stand for."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Row

from tramaline.streaming.states import _Calls


@pytest.mark.parametrize("name", [lambda i: i, lambda i: f"n{i}"])
def test_order_of_calls(name):
    r = random.Random(3)
    rows = [Row(at=r.randrange(9), n=name(r.randrange(4)), page=r.choice(["p", "q", "", "é"]), kind=r.choice(["batch", "analysis", ""]), amount=r.randrange(3)) for _ in range(2000)]
    assert list(_Calls(iter(rows))) == sorted((x.at, x.n, x.page, x.kind, x.amount) for x in rows)


def test_no_calls():
    assert list(_Calls(iter([]))) == []
