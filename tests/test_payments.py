"""Evidence of payments, methods, a user's plans, and accounts that share signals, case by case."""

from __future__ import annotations

import hashlib
import hmac
import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tramaline.operators.limits import account_relations, active_at
from tramaline.operators.payments import conforming, hmac_sha256, method_availability, plan_history

SECRET = b"a secret of more than thirty-two bytes"
NOW = 1_700_000_000
DATA = {"eventType": "payment.confirmed", "projectId": "p", "paymentId": "pay", "merchantId": "m", "externalReference": "x", "providerReference": "r", "provider": "fapshi", "currency": "XAF", "amountMinor": 100}
EVENT = {"version": 1, "type": "payment.confirmed", "eventId": "e", "environment": "live", "projectId": "p", "paymentId": "pay", "effectKey": "k", "data": DATA}


def refused(spark, rows):
    """rows: (body, changes of the headers)."""
    full = []
    for body, change in rows:
        body = body if isinstance(body, str | None) else json.dumps(body)
        h = {"event_id": "e", "key_id": "k1", "stamp": str(NOW), "received": NOW} | change
        mac = hmac.new(SECRET, f"v1\n{h['stamp']}\n{h['event_id']}\n{body}".encode(), hashlib.sha256).hexdigest()
        full.append((len(full), body, h["event_id"], h["key_id"], h["stamp"], h.get("signature", f"v1={mac}"), h["received"]))
    df = spark.createDataFrame(full, "n int, body string, event_id string, key_id string, stamp string, signature string, received bigint")
    return [r.refused for r in conforming(df, SECRET, "k1", "p", "live", "fapshi", "XAF").orderBy("n").collect()]


def test_hmac(spark):
    texts = ["", "a", "é" * 500]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(hmac_sha256(SECRET, F.col("t").cast("binary"))).collect()]
    assert got == [hmac.new(SECRET, t.encode(), hashlib.sha256).hexdigest() for t in texts]


def test_headers_and_window(spark):
    rows = [(EVENT, {}), (EVENT, {"received": NOW + 300}), (EVENT, {"received": NOW - 301}), (EVENT, {"key_id": "k2"}), (EVENT, {"key_id": None}), (EVENT, {"stamp": "12x"}), (EVENT, {"stamp": "1" * 13}), (EVENT, {"event_id": "a b"}), (EVENT, {"signature": "v1=" + "0" * 64}), (EVENT, {"signature": "v2"}), ("", {}), (None, {}), (EVENT | {"pad": "x" * 9000}, {})]
    assert refused(spark, rows) == [None, None, "window", *["authentication"] * 5, "signature", "authentication", "size", "size", "size"]


@pytest.mark.parametrize("bodies, why", [
    ([ "{broken", "[1]", "1", {"version": 1}, EVENT | {"data": []}], "malformed"),
    ([EVENT | {k: v} for k, v in {"version": 2, "type": "x", "eventId": "f", "environment": "sandbox", "projectId": "q", "paymentId": "other", "effectKey": "no ref"}.items()], "evidence"),
    ([EVENT | {"data": DATA | {k: v}} for k, v in {"eventType": "x", "projectId": "q", "paymentId": "z", "merchantId": "", "externalReference": None, "providerReference": "x" * 161, "provider": "o", "currency": "EUR", "environment": "sandbox"}.items()], "evidence"),
    ([EVENT | {"data": DATA | {"amountMinor": v}} for v in (99, -100, "100", 100.5, True, None)], "evidence"),
    ([EVENT | {"data": DATA | {k: None}} for k in ("pages", "credits", "grant", "phone", "email", "userId")], "evidence"),
    ([EVENT | {"data": DATA | {"environment": "live"}}, EVENT | {"more": [1]}, EVENT | {"data": DATA | {"amountMinor": 10**12}}], None),
])
def test_contents(spark, bodies, why):
    assert refused(spark, [(b, {}) for b in bodies]) == [why] * len(bodies)


def test_methods(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    routing = frame([("card", " Paddle"), ("momo", "campay"), ("orange", "fapshi"), ("paypal", ""), ("wire", "nobody"), ("momo2", "paddle")], "method string, provider string")
    providers, takes = frame([("paddle", True), ("campay", True), ("fapshi", None)], "provider string, configured boolean"), frame([("paddle", "card"), ("campay", "momo"), ("fapshi", "orange")], "provider string, method string")
    pays = frame([("paddle", "EUR"), ("campay", "XAF"), ("fapshi", "XAF")], "provider string, currency string")
    asked = frame([(m, c) for m, c in (("card", "EUR"), ("card", "XAF"), ("momo", "XAF"), ("orange", "XAF"), ("paypal", "EUR"), ("wire", "EUR"), ("momo2", "EUR"), ("cash", "EUR"), (None, None))], "method string, currency string")
    got = {(r.method, r.currency): (r.provider, r.reason) for r in method_availability(asked, routing, providers, takes, pays).collect()}
    assert got == {("card", "EUR"): ("paddle", None), ("card", "XAF"): (None, "currency"), ("momo", "XAF"): ("campay", None), ("orange", "XAF"): (None, "not_configured"), ("paypal", "EUR"): (None, "no_provider"), ("wire", "EUR"): (None, "no_provider"), ("momo2", "EUR"): (None, "unsupported"), ("cash", "EUR"): (None, "unknown"), (None, None): (None, "unknown")}


def test_plans_over_time(spark):
    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    events = [("u", 1, "subscription", "pro", 1, day(2), day(32)), ("u", 2, "renewal", "pro", 1, day(30), day(60)), ("u", 3, "expiry", "free", None, day(60), None), ("u", 4, "admin", "pro", 3, day(60), None), ("x", 9, "admin", "pro", 3, day(60), None)]
    users = spark.createDataFrame([("u", day(90)), ("v", day(5))], "user_id string, created_at timestamp")
    out = plan_history(spark.createDataFrame(events, "user_id string, event_id int, kind string, plan string, months int, happened timestamp, expires_at timestamp"), users).collect()
    u = sorted((r.place, r.kind, r.subscriptions, r.expiries, r.renewals) for r in out if r.user_id == "u")
    assert u == [(1, "expiry", 3, 1, 1), (2, "admin", 3, 1, 1), (3, "renewal", 3, 1, 1), (4, "subscription", 3, 1, 1), (5, "signup", 3, 1, 1)]
    assert [(r.place, r.kind, r.subscriptions) for r in out if r.user_id == "v"] == [(1, "signup", 1)] and len(out) == 6


def test_active_by_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.choice("wxyz"), rng.randrange(60)) for _ in range(150)]
    got = {(r.k, r.t): r.active for r in active_at(spark.createDataFrame(rows, "k string, who string, t int"), ["k"], "who", "t", 7).collect()}
    assert got == {(k, t): len({w for q, w, s in rows if q == k and t - 7 <= s <= t}) for k, _, t in rows}


def test_relations_by_brute_force(spark):
    rng, begin = random.Random(4), datetime(2024, 3, 1)
    rows = [(k, rng.choice(["m1", "m2", None]), rng.choice([f"e{i}" for i in range(9)] + [None]), rng.choice(["i1", "i2", None]), rng.choice(["b1", "b2", "b3"]), begin + timedelta(minutes=rng.randrange(9 * 1440)), 1) for k in range(120)]
    df = spark.createDataFrame(rows, "id int, mailbox string, email string, ip string, browser string, ts timestamp, _day int")
    out = account_relations(df, days=2, seconds=7200, most=4)
    assert out.columns == [*df.columns, "same_mailbox", "same_ip", "same_browser", "rapid_sequence", "related"]
    for r in out.collect():
        near = lambda x, days: abs((x[5].date() - r.ts.date()).days) <= days  # noqa: B023, E731
        by = {c: {x[2] for x in rows if x[i] is not None and x[i] == r[c] and (c == "mailbox" or near(x, 2))} - {None} for i, c in ((1, "mailbox"), (3, "ip"), (4, "browser"))}
        rapid = any(r[c] is not None and r.email is not None and len({x[2] for x in rows if x[i] == r[c] and timedelta(0) <= r.ts - x[5] <= timedelta(hours=2)} - {None}) >= 3 for i, c in ((3, "ip"), (4, "browser")))
        own = {r.email}
        assert [r.same_mailbox, r.same_ip, r.same_browser] == [len(by[c] - own) for c in ("mailbox", "ip", "browser")], r
        assert r.related == sorted(set().union(*by.values()) - own)[:4]
        if r.email is not None:
            assert r.rapid_sequence == rapid
    assert account_relations(df.limit(0)).count() == 0
