"""Operators over words and boxes of pages that need a page's rows together."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructField, StructType

from tramaline.operators.folds import fold_rows


_Interval = tuple[float, float]


def _blanks(spans: list[_Interval]) -> list[_Interval]:
    """Intervals of an axis that no span covers, those before the first span and after the last included."""
    spans = sorted(spans, key=itemgetter(0))
    low, end, out = spans[0][0] if spans else math.inf, -math.inf, []
    for lo, hi in [*spans, (math.inf, math.inf)]:
        # boxes may touch; those without extent at the same place aren't parted
        if lo >= end and (end == -math.inf or lo > low) and (not out or out[-1] != (end, lo)):
            out.append((end, lo))
        end = max(end, hi)
    return out


def _meet(a: list[_Interval], b: list[_Interval]) -> list[_Interval]:
    """What two lists of intervals, each in order, have in common."""
    out, first = [], 0
    for lo, hi in a:
        while first < len(b) and b[first][1] < lo:
            first += 1
        for k in range(first, len(b)):
            if b[k][0] > hi:
                break
            out.append((max(lo, b[k][0]), min(hi, b[k][1])))
    return out


def _parted(own: list[int], at: list[float], blanks: list[_Interval]) -> list[list[int]]:
    """Rows by the blanks that lie between them."""
    edges, out = [begin for _, begin in blanks[1:-1]], [[] for _ in blanks[1:]]
    for i in own:
        out[bisect_right(edges, at[i])].append(i)
    return out


def page_order(boxes: np.ndarray) -> np.ndarray:
    """Rows of boxes (x0, y0, x1, y1) in reading order.

    A piece of the page with a blank from top to bottom is read column by column. Else it is read band by band;
    bands one below the other that have columns and a corridor in common are one piece. A piece that can't be cut
    is read by lines.
    """
    return np.array(_order(np.asarray(boxes, float).reshape(-1, 4).tolist()), np.int64)


def _order(boxes: list) -> list[int]:
    """page_order of a page's boxes; pages have few, for which arrays would cost more than they save."""
    left, top = [b[0] for b in boxes], [b[1] for b in boxes]
    across, down = [(b[0], b[2]) for b in boxes], [(b[1], b[3]) for b in boxes]
    read: list[int] = []
    todo = [list(range(len(boxes)))]
    while todo:
        own = todo.pop()
        corridors = _blanks([across[i] for i in own])
        columns = _parted(own, left, corridors) if len(corridors) > 2 else []
        if sum(map(bool, columns)) > 1:
            todo += reversed(columns)
            continue
        rungs = _blanks([down[i] for i in own])
        bands = _parted(own, top, rungs)
        if len(rungs) <= 2 or sum(map(bool, bands)) < 2:
            read += sorted(own, key=lambda i: (top[i], left[i]))
            continue
        pieces: list[list[int]] = []
        common = None  # corridors of the piece so far, if all of its bands have columns
        for band in bands:
            mine = _blanks([across[i] for i in band])
            mine = mine if len(mine) > 2 else None
            both = None if common is None or mine is None else _meet(common, mine)
            if both is not None and len(both) > 2:
                pieces[-1] += band
                common = both
            else:
                pieces.append(band)
                common = mine
        if len(pieces) > 1:
            todo += reversed(pieces)
        else:  # boxes without width leave a corridor to the bands, but not to the piece
            read += [i for band in bands for i in sorted(band, key=lambda i: (top[i], left[i]))]
    return read


def _placed(rows: DataFrame) -> DataFrame:
    """rows with their edges as numbers; a missing one is no number, which comes last."""
    return rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(math.nan)) for c in ("x0", "y0", "x1", "y1")})


def reading_order(boxes: DataFrame, page: list[str]) -> DataFrame:
    """page, seq and place (from 0): boxes has page's columns, seq, x0, y0, x1, y1. A page is a unit of work."""

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        rows = list(rows)  # sorted, so that the order in which they came doesn't matter
        yield from ((rows[i][4], place) for place, i in enumerate(_order(rows)))

    edges = ["x0", "y0", "x1", "y1"]
    return fold_rows(_placed(boxes), page, [*edges, "seq"], [*edges, "seq"], "seq long, place long", fold)


def stacked_blocks(lines: DataFrame, page: list[str], height: float = 0.35, edge: float = 0.6) -> DataFrame:
    """page, seq and block (from 0): lines stacked under one another make a block.

    lines has page's columns, seq, x0, y0, x1, y1 and bullet (opens a block). A line goes to the first block whose
    last line is about as high, shares its left edge, right edge or axis, overlaps it sideways, and ends close
    above. Lines are streamed from top to bottom; blocks that ended too far above are let go.
    """
    reach = 0.8

    def joins(a: tuple, b: tuple) -> bool:
        ha, hb = a[3] - a[1], b[3] - b[1]
        slack = edge * max(ha, hb)
        shared = abs(a[0] - b[0]) <= slack or abs(a[2] - b[2]) <= slack or abs(a[0] + a[2] - b[0] - b[2]) <= 2 * slack
        return shared and abs(ha - hb) <= height * max(ha, hb) and -0.3 * ha < b[1] - a[3] < reach * ha and min(a[2], b[2]) > max(a[0], b[0])

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        n, live = 0, {}  # the last line of each block that a line may still join, in the order of blocks
        for *r, seq, bullet in rows:
            # lines come by y0, so that what is out of reach stays so
            for k in [k for k, a in live.items() if r[1] - a[3] >= reach * (a[3] - a[1])]:
                del live[k]
            k = next((k for k, a in live.items() if not bullet and joins(a, r)), n)
            n += k == n
            live[k] = r
            yield seq, k

    return fold_rows(_placed(lines), page, ["y0", "x0", "seq"], ["x0", "y0", "x1", "y1", "seq", "bullet"], "seq long, block long", fold)


class Gutters(NamedTuple):
    """Lines that a corridor lasts, and in widths of a glyph its width, the text on either side, how far that
    text may be from it; the distance of lines of one block, in heights of a line."""

    lines: int = 5
    width: float = 1.2
    side: float = 4.0
    reach: float = 4.0
    apart: float = 1.5


def column_gutters(words: DataFrame, page: list[str], barriers: DataFrame | None = None, bounds: Gutters = Gutters()) -> DataFrame:
    """page, x0, x1, lines: blank corridors between columns, which stay where they are over many lines.

    words has page's columns, line, x0, top, x1, bottom and glyph. A blank between two words of a line opens a corridor
    if it is wide enough and has text enough on either side in its line: a bullet or a margin has none. From top to bottom
    a corridor narrows to what it shares with each line's blank; a line whose text is far from it says nothing, nor does
    one that ends before it. It ends where text crosses it, a line has too little beside it, a block ends, or a barrier lies
    across (page's columns, x0, y, x1: a line drawn); it counts if enough lines bear it. Lines may come in any order.
    """
    word = F.collect_list(F.struct(*(F.col(c).cast("double").alias(c) for c in _WORD))).alias("words")
    lines = words.groupBy(*page, "line").agg(F.min(F.col("top").cast("double")).alias("top"), F.max(F.col("bottom").cast("double")).alias("bottom"), word)
    return line_gutters(lines, page, barriers, bounds)


def line_gutters(lines: DataFrame, page: list[str], barriers: DataFrame | None = None, bounds: Gutters = Gutters()) -> DataFrame:
    """column_gutters of lines with top, bottom (doubles), and their words (x0, x1, glyph: doubles) as an array in any order.

    No word is shuffled: of each line its edges, its median glyph and its blanks go to the page's task.
    """
    kept = [*page, "top", "bottom"]
    kinds = StructType([lines.schema[c] for c in kept] + [StructField(c, DoubleType()) for c in _WORD] + [StructField("blanks", BinaryType())])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there, *edges, blanks = _line_blanks(batch.column(len(kept)))
            there = pa.array(there)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(there) for k in range(len(kept))), *map(pa.array, edges), pa.array(blanks, pa.binary())], [f.name for f in kinds])

    lines = lines.select(*kept, "words").mapInArrow(measured, kinds).withColumn("drawn", F.lit(False))
    if barriers is not None:
        drawn = barriers.select(*page, F.lit(True).alias("drawn"), F.col("x0").cast("double").alias("x0"), F.col("y").cast("double").alias("top"), F.col("x1").cast("double").alias("x1"))
        lines = lines.unionByName(drawn, allowMissingColumns=True)

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        live = np.zeros((4, 0))  # x0, x1, lines and glyph of each corridor
        end, height = None, 0.0

        def borne(over: np.ndarray) -> Iterator[tuple]:
            return ((x0, x1, int(n)) for x0, x1, n, _ in over[:, over[2] >= bounds.lines].T.tolist())

        for drawn, top, bottom, x0, x1, glyph, blanks in rows:
            if drawn:
                across = (x0 < live[1]) & (x1 > live[0])
                yield from borne(live[:, across])
                live = live[:, ~across]
                continue
            if end is not None and top - end > bounds.apart * max(height, 1.0):
                yield from borne(live)
                live = live[:, :0]
            begins, ends = np.frombuffer(blanks).reshape(2, -1)
            live, over = _carried(live, x0, x1, glyph, begins, ends, bounds)
            yield from borne(over)
            live = np.concatenate([live, _opened(live, x0, x1, glyph, begins, ends, bounds)], axis=1)
            end, height = bottom, bottom - top
        yield from borne(live)

    return fold_rows(lines, page, ["top", "drawn", "x0"], ["drawn", "top", "bottom", "x0", "x1", "glyph", "blanks"], "x0 double, x1 double, lines bigint", fold)


_WORD = ("x0", "x1", "glyph")


def _line_blanks(words: pa.ListArray) -> tuple:
    """Of lines that have words: their numbers, x0, x1, median glyph, and blanks: all begins, then all ends.

    A blank begins where all words so far have ended, as words may overlap. A missing edge bounds nothing.
    """
    size = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    there = np.flatnonzero(size)
    n = size[there]
    first = np.cumsum(n) - n
    flat = words.flatten()
    x0, x1, glyph = (flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in _WORD)
    if not len(n):
        return (there, *[np.zeros(0)] * 3, [])
    line = np.repeat(np.arange(len(n)), n)
    # the median: the middle one or two of those that are there, which come first
    order = np.lexsort((glyph, line))
    known = np.add.reduceat(~np.isnan(glyph), first, dtype=np.int64)
    low, high = (glyph[order][first + k] for k in (np.maximum(known - 1, 0) // 2, known // 2))
    middle = np.where(known % 2 == 1, low, low * 0.5 + high * 0.5)
    # the furthest end so far, by rank so that numbers stay as they are
    order = np.lexsort((x1, np.where(np.isnan(x0), -np.inf, x0), line))
    begin, values = x0[order], np.unique(x1)
    rank = np.where(np.isnan(x1[order]), 0, np.searchsorted(values, x1[order]) + 1)
    reach = np.maximum.accumulate(line * (len(values) + 1) + rank) - line * (len(values) + 1)
    end = np.append(np.nan, values)[reach]
    blank = np.flatnonzero((line[1:] == line[:-1]) & (begin[1:] > end[:-1]))
    a, b, of = end[blank], begin[blank + 1], line[blank]
    cuts = np.searchsorted(of, np.arange(len(n) + 1)).tolist()
    blanks = [a[i:j].tobytes() + b[i:j].tobytes() for i, j in zip(cuts, cuts[1:], strict=False)]
    return there, np.fmin.reduceat(x0, first), np.fmax.reduceat(x1, first), middle, blanks


def _carried(live: np.ndarray, x0: float, x1: float, glyph: float, begins: np.ndarray, ends: np.ndarray, bounds: Gutters) -> tuple[np.ndarray, np.ndarray]:
    """Corridors that go on, as a line leaves them, and those that end. Blanks are in order and disjoint."""
    middle = (live[0] + live[1]) / 2
    beside = (x0 < middle) & (middle < x1)
    k = np.searchsorted(ends, middle)
    begin, end = np.append(begins, np.inf)[k], np.append(ends, np.inf)[k]
    blank = beside & (begin <= middle) & (np.minimum(middle - x0, x1 - middle) >= bounds.side * glyph)
    told = blank & ~(np.maximum(live[0] - begin, end - live[1]) > bounds.reach * glyph)
    low, high = np.maximum(live[0], begin), np.minimum(live[1], end)
    wide = high - low >= bounds.width * live[3]
    over = (beside & ~blank) | (told & ~wide)
    narrow = told & wide
    after = np.stack([np.where(narrow, low, live[0]), np.where(narrow, high, live[1]), live[2] + narrow, live[3]])
    return after[:, ~over], live[:, over]


def _opened(live: np.ndarray, x0: float, x1: float, glyph: float, begins: np.ndarray, ends: np.ndarray, bounds: Gutters) -> np.ndarray:
    """Corridors that a line's blanks open, where none in use has its middle."""
    middle = (begins + ends) / 2
    taken = np.append(np.sort((live[0] + live[1]) / 2), np.inf)
    free = taken[np.searchsorted(taken, begins)] > ends
    own = np.flatnonzero(free & (ends - begins >= bounds.width * glyph) & (np.minimum(middle - x0, x1 - middle) >= bounds.side * glyph))
    return np.stack([begins[own], ends[own], np.ones(len(own)), np.full(len(own), glyph)])


def trailing_folios(last: DataFrame, page: list[str], tolerance: float = 2.5) -> DataFrame:
    """Of the last words of lines (page's columns, line, x1, token), the bare numbers whose right edge lies within
    the tolerance of another line's: page numbers of a table of contents."""
    # in hundredths, as frames of ranges take whole numbers
    near = Window.partitionBy(*page).orderBy(F.round(F.col("x1") * 100).cast("long")).rangeBetween(round(-100 * tolerance), round(100 * tolerance))
    numbers = last.where(F.col("token").rlike(r"^[0-9]+$"))
    return numbers.withColumn("_near", F.count("*").over(near)).where("_near >= 2").drop("_near")


def ocr_lines(words: DataFrame, line: list[str], order: str, least: float = 70.0) -> DataFrame:
    """line's columns, text, x0, x1 and conf of lines of words (token, x, x1, conf) read with so much confidence.

    Words are joined by a space, and without one between signs of Chinese, Japanese or Korean.
    """
    parts = F.array_sort(F.collect_list(F.struct(order, "token", "x", "x1", "conf")))
    return read_lines(words.groupBy(*line).agg(parts.alias("words")), line, least)


def read_lines(lines: DataFrame, line: list[str], least: float = 70.0) -> DataFrame:
    """ocr_lines of lines that have their words (token, x, x1, conf) as an array in order: nothing is shuffled."""
    of = lambda c: F.col(f"words.{c}")
    text = F.regexp_replace(F.array_join(of("token"), " "), f"(?<={CJK}) (?={CJK})", "")
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"))
    conf = F.aggregate(of("conf"), start, lambda a, c: F.struct((a["sum"] + F.coalesce(c.cast("double"), F.lit(0.0))).alias("sum"), (a["n"] + c.isNotNull().cast("int")).alias("n")), lambda a: a["sum"] / F.nullif(a["n"], F.lit(0)))
    read = lines.select(*line, conf.alias("conf"), "words").where(F.col("conf") >= least)
    return read.select(*line, text.alias("text"), F.array_min(of("x")).alias("x0"), F.array_max(of("x1")).alias("x1"), "conf")


#: Signs of Chinese, Japanese and Korean.
CJK = r"[\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{ac00}-\x{d7af}]"


def page_readability(words: DataFrame, page: list[str], least_words: int = 1, confidence: float = 65.0, sure: float = 40.0, share: float = 0.9, grey: str | None = None, blank_grey: float = 12.0) -> DataFrame:
    """page's columns, n words, conf, status (ok, blank, unreadable) and reason of pages of words with conf.

    Without words (fewer than least_words) a page is blank; if grey names its deviation of greys, only where that is
    below blank_grey, else it can't be read. Nor can one of low mean confidence, or of too few words read surely.
    """
    read = words.groupBy(*page).agg(F.count("*").alias("n"), F.avg("conf").alias("conf"), F.count_if(F.col("conf") >= sure).alias("_sure"), *([F.max(grey).alias("_grey")] if grey else []))
    none, low, few = F.col("n") < least_words, F.col("conf") < confidence, F.col("_sure") < share * F.col("n")
    blank = none & (F.col("_grey") < blank_grey) if grey else none
    status = F.when(blank, "blank").when(none | low | few, "unreadable").otherwise("ok")
    reason = F.when(none, "no word").when(low, "confidence").when(few, "doubtful words")
    return read.select(*page, "n", "conf", status.alias("status"), reason.alias("reason"))
