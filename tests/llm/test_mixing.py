"""Poisson replication at all rates, and with columns of clashing names."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm_operators import frame
from tramaline.llm import mixing


def plain_count(rate, u):
    k, log_p = 0, -rate
    cdf = math.exp(log_p)
    while cdf < u and k < rate + 10 * math.sqrt(rate) + 20:
        k += 1
        log_p += math.log(rate / k)
        cdf += math.exp(log_p)
    return k


def test_inverse_of_the_distribution(spark):
    rng = np.random.default_rng(2)
    rows = [(float(r), float(u)) for r in (0.01, 0.7, 1.0, 3.0, 40.0, 150.0, 400.0, 700.0) for u in rng.random(60)]
    got = spark.createDataFrame(rows, "r double, u double").withColumn("n", mixing.poisson_count(F.col("r"), F.col("u"))).collect()
    assert [x.n for x in got] == [plain_count(r, u) for r, u in rows]


@pytest.mark.parametrize("rate", [1e4, 1e6])
def test_great_rates(spark, rate):
    n = 200 if rate < 1e5 else 40
    got = [r[0] for r in spark.range(n).select(mixing.poisson_count(F.lit(rate), (F.col("id") + 0.5) / n)).collect()]
    want = [rate + math.sqrt(rate) * x for x in np.sqrt(2) * np.array([_inverse_erf(2 * (i + 0.5) / n - 1) for i in range(n)])]
    assert got == sorted(got) and np.abs(np.array(got) - np.array(want)).max() < 0.05 * math.sqrt(rate) + 2


def _inverse_erf(y):
    lo, hi = -6.0, 6.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if math.erf(mid) < y else (lo, mid)
    return lo


def test_one_document_very_often(spark):
    docs = frame(spark, [(1, "a"), *((2 * i, "b") for i in range(1, 50))])
    out = mixing.mix_sources(docs, {"s1": 1.0}, total=30_000)
    n = out.where("doc_id = 1").agg(F.count("*"), F.countDistinct("copy"), F.max("copy"), F.max("n_copies")).first()
    assert out.where("doc_id <> 1").count() == 0 and len(set(n)) == 1 and abs(n[0] - 30_000) < 1000


def test_clashing_names(spark):
    rows = [(i, f"s{i % 2}", "x", 5, 6.0, "mine") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, rate string, order int, source_ double, _u string")
    out = mixing.mix_sources(docs)
    assert out.columns == [*docs.columns, "n_copies", "copy"]
    assert {tuple(r)[2:6] for r in out.collect()} == {("x", 5, 6.0, "mine")}
