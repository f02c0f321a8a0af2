"""Paragraphs rule by rule, list markers, margins by brute force, numbers of pages."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tramaline.operators.paragraphs import OPEN_WORDS, Bounds, Line, list_markers, list_ordinal, paragraphs, set_margins, split_trailing_numbers

SCHEMA = "page string, seq bigint, x0 double, top double, x1 double, bottom double, base double, size double, glyph double, bold boolean, cell bigint, text string, width double"


def line(seq, x0, top, text, x1=None, size=10.0, bold=False, cell=None, page="p", width=None):
    end = x0 + 5.0 * len(text or "") if x1 is None else float(x1)
    return (page, seq, float(x0), float(top), end, float(top + size), float(top + size - 2), size, 5.0, bold, cell, text, width)


def found(spark, rows, **kw):
    """{seq: (paragraph, rule)}; rows come in any order."""
    rows = list(rows)
    random.Random(3).shuffle(rows)
    return {r.seq: (r.paragraph, r.rule) for r in paragraphs(spark.createDataFrame(rows, SCHEMA), ["page"], width="width", **kw).collect()}


#: Second line's changes, the first one's, and the rule that decides between them; gaps are in sizes of letters.
CASES = {
    "bullet": ({"text": "• an item"}, {"text": "and so on with the"}, 1.2),
    "item": ({"text": "2. Another one"}, {"text": "A sentence ends."}, 1.2),
    "weight": ({"text": "in bold", "bold": True}, {"text": "not in bold"}, 1.2),
    "size": ({"text": "greater", "size": 13.0}, {"text": "smaller"}, 1.2),
    "gap": ({"text": "far below"}, {"text": "on top and"}, 2.0),
    "capitals": ({"text": "Mixed Letters"}, {"text": "ALL CAPITALS"}, 1.2),
    "room": ({"text": "Would have fitted", "width": 400.0}, {"text": "A short line", "width": 400.0}, 1.2),
    "entries": ({"text": "Other entry", "x0": 20, "x1": 80}, {"text": "An entry of one line (1)", "x0": 0, "x1": 100}, 1.2),
    "flow": ({"text": "Goes on here", "x1": 100}, {"text": "One line of it all", "x1": 100}, 1.2),
    "small letter": ({"text": "goes on", "x0": 40}, {"text": "One line of it."}, 1.5),
    "indent": ({"text": "Indented line", "x0": 40, "x1": 140}, {"text": "One line of text", "x1": 100}, 1.5),
    "sentence": ({"text": "A new one"}, {"text": "It ended.”", "x1": 45}, 1.7),
    "near": ({"text": "But not a new one"}, {"text": "It ended.", "x1": 85}, 1.7),
}
BREAKS = set(CASES) - {"flow", "small letter", "near"}


@pytest.mark.parametrize("rule", CASES)
def test_each_rule(spark, rule):
    below, above, gap = CASES[rule]
    if rule == "entries":  # a wide neighbour makes the column's margin
        others = [line(9, 0, 24, "x", x1=300)]
    else:
        others = []
    size = max(below.get("size", 10.0), 10.0)
    top = 8 + gap * size - below.get("size", 10.0) + 2
    got = found(spark, [line(1, **({"x0": 0, "top": 0} | above)), line(2, **({"x0": 0, "top": top} | below)), *others])
    assert got[1] == (0, None) and got[2] == ((1 if rule in BREAKS else 0), rule)


def test_a_sentence_that_runs_on_holds_together(spark):
    """An open word, a hyphen or a slash above; a small letter, a measure, an ampersand or a joining word below."""
    pairs = [("It comes from the", "Old world"), ("A hyphen-", "Ated word"), ("This/", "That"), ("He was", "17 years old"), ("DRIVERS", "& VEHICLE owners"), ("It ended.", "However it went"), ("A LIST", "of things")]
    for above, below in pairs:
        got = found(spark, [line(1, 0, 0, above, width=900.0), line(2, 0, 12, below, width=900.0)])
        assert got[2] == (0, "flow"), (above, below)
    assert found(spark, [line(1, 0, 0, "It ended", width=900.0), line(2, 0, 12, "Elsewhere", width=900.0)])[2] == (1, "room")


def test_open_words_are_whole():
    assert len(OPEN_WORDS) == len(set(OPEN_WORDS)) and {"via", "vers", "à", "nor"} <= set(OPEN_WORDS)


def test_an_item_that_wraps_isnt_cut(spark):
    got = found(spark, [line(1, 0, 0, "• Official", width=500.0), line(2, 9, 12, "Transcript", width=500.0), line(3, 0, 24, "• Next", width=500.0)])
    assert got == {1: (0, None), 2: (0, "flow"), 3: (1, "bullet")}


def test_a_proven_marker_breaks_what_spelling_would_join(spark):
    rows = [line(0, 0, 0, "by one of your:"), line(1, 6, 12, "1. Parent; / or"), line(2, 6, 24, "2. Guardian; / or"), line(3, 6.9, 36, "3. Anyone"), line(4, 200, 0, "it reached"), line(5, 200, 12, "1. Then it fell")]
    got = found(spark, rows)
    assert [got[k][1] for k in range(6)] == [None, "marker", "marker", "marker", None, "flow"]


def test_columns_cells_and_wrapping(spark):
    rows = [line(1, 0, 0, "left column and"), line(2, 200, 0.04, "right column and"), line(3, 0, 12, "its next line"), line(4, 200, 11.96, "that one's next"), line(5, 400, 0, "cell of a", cell=1), line(6, 400, 12, "other cell", cell=2)]
    got = {k: v[0] for k, v in found(spark, rows).items()}
    assert got[1] == got[3] and got[2] == got[4] and len({got[k] for k in (1, 2, 5, 6)}) == 4


def test_lines_of_one_height_by_rounding(spark):
    """Tops that differ by noise are one height: the left line comes first."""
    got = found(spark, [line(1, 300, 10.01, "right"), line(2, 0, 10.04, "left")])
    assert got[2][0] == 0 and got[1][0] == 1


def test_obstacles_bound_the_room(spark):
    rows = [line(1, 0, 0, "Beside a picture", width=500.0), line(2, 0, 12, "Goes on", width=500.0)]
    assert found(spark, rows)[2] == (1, "room")
    pictures = spark.createDataFrame([("p", 90, 0, 200, 30), ("q", 0, 0, 9, 9)], "page string, x0 double, top double, x1 double, bottom double".replace("double", "int"))
    assert found(spark, rows, obstacles=pictures)[2] == (0, "flow")


def test_nulls_and_no_rows(spark):
    rows = [("p", 1, 0.0, 0.0, 50.0, 10.0, 8.0, None, None, None, None, None, None), ("p", 2, 0.0, 12.0, 50.0, 22.0, 20.0, 10.0, None, False, None, "text", None)]
    assert set(found(spark, rows)) == {1, 2}
    assert paragraphs(spark.createDataFrame([], SCHEMA), ["page"]).count() == 0


def plain_margin(x, lines, obstacles, width, b):
    """As set_margins, by looking at everything."""
    near = [y for y in lines if y is x or (y.x1 > x.x0 and y.x0 < x.x1 and abs((y.top + y.bottom) - (x.top + x.bottom)) / 2 <= b.window * x.size)]
    right, left = max(y.x1 for y in near), min(y.x0 for y in near)
    flows = sum(right - y.x1 <= x.size / 2 for y in near) >= 2 and sum(y.x0 - left <= x.size / 2 for y in near) >= 2
    band = lambda q: q[3] > x.top and q[1] < x.bottom and q[0] > x.x1
    blocks = [q[0] for q in obstacles if band(q)]
    free = min([width, *blocks, *(y.x0 for y in lines if band((y.x0, y.top, y.x1, y.bottom)))])
    margin = right if flows and x.x1 - x.x0 >= free - x.x1 else free
    return margin, min([margin, *blocks]) - x.x1


def test_margins_by_brute_force():
    rng = random.Random(5)
    for n in (1, 2, 30, 80):
        def box():
            x, y = rng.randrange(0, 500), rng.randrange(0, 400)
            return x, y, x + rng.choice([20, 100, 100, 200]), y + rng.choice([8, 10, 30])
        lines = []
        for k in range(n):
            x0, top, x1, bottom = map(float, box())
            lines.append(Line(k, x0, top, x1, bottom, bottom - 2, 10.0, 5.0, False, None, *[False] * 12, 3))
        obstacles = [tuple(map(float, box())) for _ in range(n // 8)]
        set_margins(lines, obstacles, 600.0, Bounds())
        assert [(x.margin, x.room) for x in lines] == [plain_margin(x, lines, obstacles, 600.0, Bounds()) for x in lines]


def test_ordinals(spark):
    texts = ["5. x", "(12) x", "b) x", "C. x", " (d.  x", "1234. x", "5.x", "x", "§ 5. x", None, "ab) x"]
    kind, rank = list_ordinal(F.col("t"))
    got = [tuple(r) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(kind, rank).collect()]
    assert got == [("d", 5), ("d", 12), ("a", 98), ("a", 99), ("a", 100), *[(None, None)] * 6]


def test_markers_are_proven_by_neighbours(spark):
    def marked(rows):
        rows = [("p", k, float(x), float(10 * k), t) for k, (x, t) in enumerate(rows)]
        random.Random(1).shuffle(rows)
        return {r.seq: r.proven for r in list_markers(spark.createDataFrame(rows, "page string, seq bigint, x0 double, top double, text string"), ["page"]).collect()}

    assert marked([(0, "1. a"), (1.5, "2. b"), (0, "not"), (3.1, "3. c"), (0, "4. d")]) == {0: True, 1: True, 3: False, 4: False}
    assert marked([(0, "1. a"), (0, "2. b"), (0, "1. a"), (0, "2. b"), (0, "a. b"), (0, "7. x")]) == {0: True, 1: True, 2: True, 3: True, 4: False, 5: False}


def test_numbers_of_pages_are_parted(spark):
    rows = [
        ("p", 1, 0.0, 300.0, "Entry one 12", "12", 288.0, 60.0), ("p", 2, 0.0, 301.9, "Entry two 7", "7", 296.0, 60.0), ("p", 3, 0.0, 80.0, "close 5", "5", 64.0, 60.0),
        ("p", 4, 0.0, 200.0, "alone 9", "9", 195.0, 60.0), ("p", 5, 295.0, 299.0, "14", "14", 295.0, None), ("q", 6, 0.0, 300.0, "Entry 12", "12", 288.0, 60.0), ("p", 7, 0.0, 300.0, "words", "words", 0.0, None),
    ]
    df = spark.createDataFrame([(*r, 5.0, "kept") for r in rows], "page string, seq bigint, x0 double, x1 double, text string, tail string, tail_x0 double, body_x1 double, glyph double, other string")
    got = sorted((r.seq, r.part, r.x0, r.x1, r.text) for r in split_trailing_numbers(df, ["page"]).collect())
    assert [g for g in got if g[0] < 3] == [(1, 0, 0.0, 60.0, "Entry one"), (1, 1, 288.0, 300.0, "12"), (2, 0, 0.0, 60.0, "Entry two"), (2, 1, 296.0, 301.9, "7")]
    assert [g[:2] for g in got if g[0] >= 3] == [(k, 0) for k in range(3, 8)]
