"""Small cases by hand for column functions and operators."""

from __future__ import annotations

import datetime as dt
import json

import numpy as np
from pyspark.sql import functions as F

from tramaline.functions import identity as I
from tramaline.functions import money as M
from tramaline.functions import text as T
from tramaline.operators import ledger as L
from tramaline.operators.graph import connected_components
from tramaline.operators.folds import anchor_clusters, greedy_batches, typed_batches
from tramaline.operators.layout import column_gutters, page_order, stacked_blocks, trailing_folios
from tramaline.operators.pairs import word_recall
from tramaline.operators.tables import insert_if_absent
from tramaline.sources.extracts import load_segments, text_leaves
from tramaline.sources.html import html_segments
from tramaline.streaming.jobs import bounded_alerts, cooldown_alerts, drained


def values(spark, column, items, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}").orderBy("i").select(column).collect()]


def test_tags(spark):
    assert values(spark, T.strip_tags("x"), ["[[0]]a\nb[[/0]] [[1]]c", None, ""]) == ["a\nb c", None, ""]
    assert values(spark, T.tag_contents("x"), ["[[0]]a[[/0]][[2]]b[[/2]][[0]]c[[/0]]"]) == [{2: "b", 0: "c"}]


def test_numbers_and_words(spark):
    assert values(spark, T.is_numeric_text("x"), ["1 234,5 %", "12e3", "x1", "", "-.5"]) == [True, True, False, False, True]
    assert values(spark, T.word_count("x"), ["one two 33", "漢字 ok", "a" * 120, "สวัสดีค", "l'été"]) == [2, 3, 3, 2, 1]
    assert values(spark, T.has_words("x"), ["ABC", "Abc", "a1b2", "日本"]) == [False, True, False, True]
    assert values(spark, T.open_parens("x"), ["a (b) （c）", "étudiant(e)s"]) == [2, 0]


def test_pages(spark):
    assert values(spark, T.page_range("x"), ["1-3, 8", "5-3", "0, x", "", "2,2"]) == [[1, 2, 3, 8], [3, 4, 5], None, None, [2]]
    assert values(spark, T.page_token(T.page_range("x")), ["3-5", "7", "x"]) == ["p3-5", "p7", ""]


def test_versions(spark):
    assert [values(spark, T.version_newer(F.col("x"), F.lit("1.2")), [v])[0] for v in ("1.10", "1.2", "1.2.0", "1.2.1", "x")] == [True, False, False, True, False]


def test_money(spark):
    fee = lambda n, card: M.transaction_fee(F.col("x"), F.lit("C"), F.lit(card))
    assert values(spark, fee(0, False), [100, 101], "bigint") == [3, 4]
    assert values(spark, fee(0, True), [790], "bigint") == [-(-(790 + 47) * 100 // 95) - 790]
    assert values(spark, M.billable_pages(F.col("x"), F.lit("A"), F.lit(False)), [1, 5], "bigint") == [2, 5]
    assert values(spark, M.zone_for_country(F.col("x")), [" cm ", "MA", "FR", None]) == ["A", "B", "C", "C"]


def test_identity(spark):
    assert values(spark, I.canonical_mailbox(F.col("x")), [" A.b+c@GoogleMail.com", "x+y@pm.me", "x-y@yahoo.fr", "x+y@corp.org", "none"]) == ["ab@gmail.com", "x@pm.me", "x@yahoo.fr", "x+y@corp.org", "none"]
    assert values(spark, I.network_key(F.col("x")), ["::ffff:1.2.3.4", "2001:db8::1", "bad", "9.9.9.9", None]) == ["1.2.3.4", "2001:db8::/64", None, "9.9.9.9", None]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def test_reading_order():
    boxes = [(0, 0, 100, 10, "title"), (0, 20, 45, 30, "l1"), (55, 20, 100, 30, "r1"), (0, 40, 45, 50, "l2"), (55, 40, 100, 50, "r2"), (0, 90, 100, 99, "foot")]
    read = lambda rows: [rows[i][4] for i in page_order(np.array([r[:4] for r in rows], float))]
    for turn in range(6):
        assert read(boxes[turn:] + boxes[:turn]) == ["title", "l1", "l2", "r1", "r2", "foot"]
    # a line without columns of its own stays a band, though it leaves the corridor above free
    short = [*boxes[1:5], (0, 60, 40, 70, "tail"), (0, 90, 100, 99, "foot")]
    assert read(short) == ["l1", "l2", "r1", "r2", "tail", "foot"]
    # columns at other places are read on their own
    other = [(0, 0, 45, 10, "a"), (55, 0, 100, 10, "b"), (0, 20, 20, 30, "c"), (30, 20, 100, 30, "d")]
    assert read(other) == ["a", "b", "c", "d"]
    assert read([(5, 5, 5, 5, "x"), (5, 5, 5, 5, "y")]) == ["x", "y"] and read([(0, 0, 1, 1, "x")]) == ["x"]


def test_batches_and_clusters(spark):
    t = spark.createDataFrame([("d", i, "x" * n) for i, n in enumerate([5, 6, 20, 3, 3, 3, 3])], "g string, seq bigint, text string")
    assert [r.batch for r in greedy_batches(t, "g", 3, 12).orderBy("seq").collect()] == [0, 0, 1, 2, 2, 2, 3]
    k = spark.createDataFrame([("d", i, x) for i, x in enumerate([1, 1, 2, 2, 2, 2, 2, 1])], "g string, seq bigint, kind int")
    assert [r.batch for r in typed_batches(k, ["g"], 2, 4).orderBy("seq").collect()] == [0, 0, 1, 1, 1, 1, 2, 2]
    long = spark.createDataFrame([("e", 400, "x")] + [("d", i, "y") for i in range(30_000)], "g string, seq bigint, text string")
    assert greedy_batches(long, "g", 300, 18_000).where("g = 'd'").selectExpr("max(batch)", "count(*)").first() == (99, 30_000)
    c = spark.createDataFrame([("d", i, float(x)) for i, x in enumerate([0, 2, 4, 10])], "g string, seq bigint, x double")
    assert [r.cluster for r in anchor_clusters(c, ["g"], "x", 3.0).orderBy("seq").collect()] == [0, 0, 1, 2]


def test_html(spark):
    pages = {
        1: '<p>Hello <b>big</b> world</p><script>x("no")</script><img alt="A cat"><p>12</p>',
        2: None,
        3: '<p>One<br>two <code>x = 1</code> <i>three <a href="#">four</a></i> five</p><pre>not this</pre>',
        4: '<div class="a notranslate"><p title="no">brand</p></div><p>Say <span translate="no">Acme <b>Corp</b></span> now</p>',
        5: "<p>has [[1]] a tag</p><p>open <em>run<p>next<input placeholder='Your name'/></p><svg><text>drawn</text></svg>",
    }
    got = {}
    for r in html_segments(spark.createDataFrame(list(pages.items()), "page_id bigint, html string")).orderBy("page_id", "seq").collect():
        got.setdefault(r.page_id, []).append((r.kind, r.text))
    assert got == {
        1: [("text", "Hello [[1]]big[[/1]] world"), ("alt", "A cat")],
        3: [("text", "One[[1]][[/1]]two [[2]][[/2]] [[3]]three [[4]]four[[/4]][[/3]] five")],
        4: [("text", "Say [[1]][[/1]] now")],
        5: [("text", "open [[1]]run[[/1]]"), ("placeholder", "Your name"), ("text", "next[[1]][[/1]]")],
    }


def test_cooldown(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    rows = [("a", day + dt.timedelta(minutes=m)) for m in (0, 30, 59, 61, 150)] + [("b", day)]
    spark.createDataFrame(rows, "k string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ts timestamp").parquet(str(tmp_path / "in")).withWatermark("ts", "1 hour")
    got = sorted((r.k, (r.ts - day).seconds // 60) for r in drained(cooldown_alerts(stream, "k", 3600), "append").collect())
    assert got == [("a", 0), ("a", 61), ("a", 150), ("b", 0)]
    rows = [(f"k{i % 4}", day + dt.timedelta(minutes=7 * i)) for i in range(20)]
    spark.createDataFrame(rows, "k string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "alerts"))
    stream = spark.readStream.schema("k string, ts timestamp").parquet(str(tmp_path / "alerts"))
    got = sorted((r.ts - day).seconds // 60 for r in drained(bounded_alerts(stream, "k", 3600, 2), "append").collect())
    assert got == [0, 7, 63, 70, 126, 133]


def test_blocks_and_gutters(spark):
    rows = [("p", 0, 0, 0, 100, 10, False), ("p", 1, 0, 12, 90, 22, False), ("p", 2, 0, 24, 95, 34, True), ("p", 3, 300, 12, 380, 22, False), ("p", 4, 0, 80, 99, 90, False)]
    lines = spark.createDataFrame(rows, "page string, seq bigint, x0 bigint, y0 bigint, x1 bigint, y1 bigint, bullet boolean")
    got = {r.seq: r.block for r in stacked_blocks(lines, ["page"]).collect()}
    assert got[0] == got[1] and len({got[0], got[2], got[3], got[4]}) == 4


def gutters(spark, lines, barriers=None):
    """lines: words (x0, x1) of each; or a pair of a top and words."""
    rows = []
    for n, words in enumerate(lines):
        top, words = words if isinstance(words, tuple) else (12 * n, words)
        rows += [("p", n, a, top, b, top + 10, 5) for a, b in words]
    df = spark.createDataFrame(rows[::-1], "page string, line int, x0 int, top int, x1 int, bottom int, glyph int")
    drawn = spark.createDataFrame(barriers, "page string, x0 int, y int, x1 int") if barriers else None
    return sorted((r.x0, r.x1, r.lines) for r in column_gutters(df, ["page"], drawn).collect())


def test_gutters(spark):
    two = [(0, 50), (55 + 9, 100)]
    assert gutters(spark, [two] * 5) == [(50.0, 64.0, 5)] and gutters(spark, [two] * 4) == []
    # blanks between words move, the corridor narrows to what all share
    assert gutters(spark, [[(0, 20 + n), (28 + n * 3, 45), (60 + n % 2, 100)] for n in range(6)]) == [(45.0, 60.0, 6)]
    assert gutters(spark, [[(0, 50 - n), (64 + n, 120)] for n in range(6)]) == [(50.0, 64.0, 6)]
    # a margin or a bullet has no text beside it
    assert gutters(spark, [[(0, 4), (20, 120)]] * 8) == []
    assert gutters(spark, [[(0, 4), (20, 60), (80, 120)]] * 8) == [(60.0, 80.0, 8)]
    # text across, a gap between blocks, and a line drawn across end it; a short line or one far away says nothing
    assert gutters(spark, [two] * 3 + [[(0, 100)]] + [two] * 3) == []
    assert gutters(spark, [two] * 3 + [[(0, 30)]] + [two] * 3) == [(50.0, 64.0, 6)]
    assert gutters(spark, [two] * 3 + [[(0, 20), (110, 150)]] + [two] * 3) == [(50.0, 64.0, 6)]
    assert gutters(spark, [(12 * n + 40 * (n > 2), two) for n in range(6)]) == []
    assert gutters(spark, [two] * 6, [("p", 0, 35, 200)]) == [] and gutters(spark, [two] * 6, [("p", 70, 35, 200), ("q", 0, 35, 200)]) == [(50.0, 64.0, 6)]
    assert gutters(spark, [two] * 12, [("p", 40, 83, 60)]) == [(50.0, 64.0, 5), (50.0, 64.0, 7)]


def test_rules_by_hand(spark):
    """Cases that the queries' own tables don't hold."""
    assert values(spark, I.phone_operator(F.col("x")), ["684 12 34 56", "+237 685123456", "237689123456", "677123456", "65412345", "655123456", "220123456", None]) == ["mtn", "orange", "orange", "mtn", None, "orange", None, None]
    assert values(spark, I.phone_operator(F.col("x")), ["684123456", "699 123 456", "6541234567"]) == ["mtn", "orange", None]
    blocked, allowed = ["trash.net", "example.org"], ["good.example.org"]
    assert values(spark, I.is_disposable(F.col("x"), blocked, allowed), ["a.trash.net", "x.example.org", "good.example.org", "sub.good.example.org", "net"]) == [True, True, False, False, False]

    def copied(source, target):
        row = spark.createDataFrame([(source, target)], "s array<string>, t array<string>")
        return row.select(T.copied_run(F.col("s"), F.col("t"))).first()[0]

    assert copied(["a", "b", "c"], ["x", "y", "c"]) and copied(["a", "7", "c"], ["x", "7", "c"])
    assert not copied(["a", "b"], ["a", "b"]) and not copied(["a", "7", "c"], ["x", "7", "z"]) and not copied(["a"], ["a"])

    rows = spark.createDataFrame([("p", 0, 100.0, "3"), ("p", 1, 102.4, "17"), ("p", 2, 49.9, "5"), ("p", 3, 101.0, "x"), ("p", 4, 60.0, "8"), ("p", 5, 62.6, "9")], "page string, line bigint, x1 double, token string")
    assert sorted(r.line for r in trailing_folios(rows, ["page"]).collect()) == [0, 1]  # on either side of a fixed bound

    there = spark.createDataFrame([(1, 50)], "k bigint, v bigint")
    new = spark.createDataFrame([(1, 3), (2, 9), (2, 7)], "k bigint, v bigint")
    assert sorted(map(tuple, insert_if_absent(there, new, ["k"], "v").collect())) == [(1, 50), (2, 7)]

    pairs = spark.createDataFrame([(1, "a b b c", "b b b d"), (2, "", "x")], "k bigint, a string, b string")
    assert {r.k: r.recall for r in word_recall(pairs, ["k"], "a", "b").collect()} == {1: 0.5, 2: 0.0}


def test_refunds(spark):
    schema = "document_id bigint, line bigint, part bigint, kind string, pages bigint, refunded boolean, status string"
    rows = [(1, 1, 0, "plan", 5, False, "P"), (1, 2, 0, "credits", 4, False, "P"), (1, 3, 0, "credits", 2, True, "P"), (2, 1, 0, "plan", 6, False, "O"), (2, 2, 0, "credits", 3, False, "O"), (3, 1, 0, "plan", 1, False, "F")]
    usage = spark.createDataFrame(rows, schema)
    once = L.refund_documents(usage, F.col("status") == "P")
    assert once.count() == 6 and once.agg(F.sum("credits_back")).first()[0] == 4
    assert L.refund_documents(once.drop("credits_back"), F.col("status") == "P").agg(F.sum("credits_back")).first()[0] == 0
    part = L.refund_unfinished(usage.where("not refunded").withColumn("kept", F.when(F.col("status") == "O", 5)), "kept")
    assert {(r.document_id, r.line): (r.pages, r.given_back) for r in part.collect()} == {(1, 1): (5, 0), (1, 2): (4, 0), (2, 1): (5, 1), (2, 2): (0, 3), (3, 1): (1, 0)}
    again = L.rebill_documents(once, F.col("status") == "P").agg(F.sum("pages_again"), F.sum("credits_again"), F.count_if("refunded")).first()
    assert tuple(again) == (11, 6, 0)
    lines = usage.withColumn("format", F.when(F.col("document_id") == 2, "pdf").otherwise("docx"))
    assert [(r.document_id, r.line) for r in L.partial_delivery(lines, F.col("status") != "F", 1).where("delivered").collect()] == [(2, 1)]


def test_extracts(spark):
    t = lambda *xs: [{"text": x} for x in xs]
    shapes = {
        1: {"pages": [{"text_blocks": t("a", " ", "b")}, {}, {"text_blocks": t("c")}], "objets": t("o")},
        2: {"slides": [{"text_elements": t("a"), "excel_elements": t("x"), "diagram_elements": [{"text_elements": t("d")}, {}], "chart_elements": [{"text_elements": t("c", "\u00a0")}], "master_elements": [{"text_elements": t("m")}], "layout_elements": [{"text_elements": t("l")}]}, {"text_elements": t("b")}]},
        3: {"workbook": {"elements": t("s1", "", "s2")}},
        4: {"document": {"charts": t("z"), "headers": t("h"), "elements": [{"text": "p", "context": {"type": "heading"}}]}, "objets": t("o1", None, "o2")},
        5: {"other": 1},
    }
    rows = [(k, json.dumps(v)) for k, v in shapes.items()] + [(6, "{broken"), (7, None)]
    got = {}
    for r in load_segments(spark.createDataFrame(rows, "k int, body string"), ["k"], "body").orderBy("k", "seq").collect():
        got.setdefault(r.k, []).append((r.section, r.unit, r.text))
    assert [x[1:] for x in got[1]] == [(0, "a"), (0, "b"), (2, "c"), (0, "o")]
    assert [x[1:] for x in got[2]] == [(0, "a"), (0, "d"), (0, "c"), (0, "l"), (0, "m"), (0, "x"), (1, "b")]
    assert [x[2] for x in got[3]] == ["s1", "s2"]
    assert got[4] == [("elements", 0, "p"), ("headers", 0, "h"), ("charts", 0, "z"), ("objets", 0, "o1"), ("objets", 0, "o2")]
    assert set(got) == {1, 2, 3, 4}


def test_text_leaves(spark):
    deep = "[" * 400 + '{"text": "far"}' + "]" * 400
    bodies = ['{"a": [{"text": "x", "b": {"text": 5, "c": [{"text": "y"}]}}], "text": "top", "z": {"text": "last"}}', deep, "{", None, "3"]
    assert values(spark, text_leaves("x"), bodies) == [["top", "x", "y", "last"], ["far"], None, None, []]
