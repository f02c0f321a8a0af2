"""Paragraphs out of a page's lines, with the rule that decided each break or join.

What a line's text says (marks) is columns. What a page's geometry says (proven list markers, the right margin of a
line's column) and which line follows which is decided page by page; a page's lines are the unit of work.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramaline.operators.folds import anchor_clusters, fold_rows

#: Words that end no sentence, in English and French; words that join a sentence to the one before.
OPEN_WORDS = [
    "the", "a", "an", "to", "of", "from", "and", "or", "for", "with", "in", "on", "at", "by", "as", "is", "are", "was", "were", "be", "been", "that", "this", "these", "those", "which", "who", "but", "nor", "so", "into", "onto", "than", "then", "if", "when", "while", "your", "our", "their", "its", "his", "her", "no", "not", "any", "each", "per", "via",
    "le", "la", "les", "un", "une", "des", "de", "du", "à", "au", "aux", "et", "ou", "en", "dans", "sur", "sous", "par", "pour", "avec", "que", "qui", "dont", "est", "sont", "ce", "cette", "ces", "son", "sa", "ses", "leur", "leurs", "votre", "vos", "notre", "nos", "ne", "se", "sans", "vers",
]
JOINING = ["But", "And", "So", "Yet", "Or", "Nor", "For", "However", "Because", "Although", "Though", "While", "Thus", "Therefore", "Also", "Then", "Still", "Besides", "Moreover", "Furthermore", "Hence"]
#: Fixed patterns of what opens an item, and of what a line of one entry ends with.
BULLET, ITEM = r"^\s*[•◦▪‣·●○∙\-–—*]\s+", r"^\s*\(?(\d{1,3}|[a-zA-Z])[.)]\s+"
MEASURE, ENTRY_END = r"^\d[\d\s., ]*\s+[a-zà-ÿ]", r"([.!?)\]»]|\d|\.\w{2,4})\s*$"


class Bounds(NamedTuple):
    """Fixed values. In sizes of letters: gaps between base lines, indent, change of size, the height in which neighbours
    tell a column's margin, shifts of an axis; a share of the narrower line; points; glyphs beside a first word."""

    gap: float = 1.8
    some_gap: float = 1.35
    sentence_gap: float = 1.6
    indent: float = 1.2
    size: float = 0.2
    window: float = 2.5
    axis: float = 0.6
    overlap: float = 0.3
    ragged: float = 6.0
    edge: float = 1.5
    spare: float = 1.0


def _edges_off(word: Column, signs: str) -> Column:
    return F.regexp_replace(word, f"^[{signs}]+|[{signs}]+$", "")


def list_ordinal(text: Column) -> tuple[Column, Column]:
    """kind (d: a number, a: a letter) and rank of the enumerator that a line begins with, such as 5. or (b); else null."""
    token = F.regexp_extract(text, ITEM, 1)
    number = token.rlike("^[0-9]+$")
    kind = F.when(number, "d").when(token != "", "a")
    return kind, F.when(number, F.try_to_number(token, F.lit("999")).cast("long")).when(token != "", F.ascii(F.lower(token)).cast("long"))


def marks(text: Column, open_words: list[str] = OPEN_WORDS, joining: list[str] = JOINING) -> dict[str, Column]:
    """What the text of a line shows at its ends."""
    head, last = F.regexp_extract(text, r"^\s*([^ ]*)", 1), F.regexp_extract(text, r"([^ ]*)\s*$", 1)
    word = F.rtrim(_edges_off(head, r""".,;:!?)\]}»”"'"""))
    joins = word.isin(joining)
    return {
        "bullet": text.rlike(BULLET), "item": text.rlike(ITEM), "ended": text.rlike(r"""[.!?…]["”’')]*\s*$"""),
        "open_end": text.rlike(r"[-/]\s*$") | F.lower(_edges_off(last, r""".,;:!?(\[{«"'""")).isin(open_words),
        "lower": text.rlike(r"^[^\p{L}\p{Nd}]*\p{Ll}"), "capital": text.rlike(r"^[^\p{L}\p{Nd}]*\p{Lu}"),
        "joins": joins, "runs_on": text.rlike(MEASURE) | text.rlike(r"^\s*[&+]") | joins,
        "caps": text.rlike(r"\p{Lu}") & ~text.rlike(r"\p{Ll}"), "small": text.rlike(r"\p{Ll}"),
        "entry": text.rlike(ENTRY_END), "word": F.length(word),
    }


def list_markers(lines: DataFrame, page: list[str], tolerance: float = Bounds().edge) -> DataFrame:
    """page, seq and proven: of lines that begin with an enumerator, whether a neighbour's rank proves it.

    lines has x0, top, text. Markers whose left edges lie within the tolerance of the first are a list; from top to
    bottom, one is proven if the marker before or after it is of its kind and a rank below or above. An enumerator by
    itself proves nothing. The order of rows doesn't matter.
    """
    kind, rank = list_ordinal(F.col("text"))
    found = lines.select(*page, "seq", "x0", "top", kind.alias("kind"), rank.alias("rank")).where("rank is not null")
    lists = found.join(anchor_clusters(found, page, "x0", tolerance), [*page, "seq"])
    down = Window.partitionBy(*page, "cluster").orderBy("top", "x0", "seq")

    def beside(f: Callable[[str], Column], step: int) -> Column:
        return F.coalesce((f("kind").over(down) == F.col("kind")) & (f("rank").over(down) == F.col("rank") + step), F.lit(False))

    return lists.select(*page, "seq", (beside(F.lag, -1) | beside(F.lead, 1)).alias("proven"))


@dataclass
class Line:
    """A line's box, base line, size of letters, width of a glyph, weight, cell of a table; and its marks."""

    seq: int
    x0: float
    top: float
    x1: float
    bottom: float
    base: float
    size: float
    glyph: float
    bold: bool
    cell: int | None
    proven: bool
    bullet: bool
    item: bool
    ended: bool
    open_end: bool
    lower: bool
    capital: bool
    joins: bool
    runs_on: bool
    caps: bool
    small: bool
    entry: bool
    word: int
    margin: float = 0.0
    room: float = 0.0


@dataclass
class Pair:
    """A line below the last line of a paragraph."""

    above: Line
    line: Line
    left: float
    opens: Line
    bounds: Bounds
    size: float = field(init=False)
    gap: float = field(init=False)
    goes_on: bool = field(init=False)

    def __post_init__(self) -> None:
        self.size = max(self.above.size, self.line.size, 1.0)
        self.gap = (self.line.base - self.above.base) / self.size
        self.goes_on = self.above.open_end or self.line.lower or self.line.runs_on

    def axes_apart(self) -> float:
        """Distance of the two lines' middles, in sizes."""
        return abs(self.above.x0 + self.above.x1 - self.line.x0 - self.line.x1) / 2 / self.size

    def room(self) -> bool:
        """The first word would have fitted on the line above: whoever wrote this wanted a new line."""
        wrapped = (self.opens.bullet or self.opens.item) and not (self.line.bullet or self.line.item)
        return not wrapped and self.line.word > 0 and self.above.room >= (self.line.word + self.bounds.spare) * self.line.glyph

    def entries(self) -> bool:
        """Both are centred, of different lengths, and the line above is an entry by itself."""
        ragged = min(abs(self.above.x0 - self.line.x0), abs(self.above.x1 - self.line.x1)) > self.bounds.ragged
        return self.axes_apart() <= self.bounds.axis and ragged and self.above.entry and self.above.x1 < self.above.margin - 2 * self.above.glyph

    def indented(self) -> bool:
        return self.line.x0 - self.left > self.bounds.indent * self.size and self.axes_apart() > 0.5


#: In order, the first rule that applies to a pair decides: whether it breaks there.
RULES: list[tuple[str, bool, Callable[[Pair], bool]]] = [
    ("bullet", True, lambda p: p.line.bullet),
    ("marker", True, lambda p: p.line.proven),
    ("item", True, lambda p: p.line.item and p.above.ended and not p.above.open_end),
    ("weight", True, lambda p: p.above.bold != p.line.bold),
    ("size", True, lambda p: abs(p.above.size - p.line.size) > p.bounds.size * p.size),
    ("gap", True, lambda p: p.gap > p.bounds.gap),
    ("capitals", True, lambda p: not p.goes_on and p.above.caps and p.line.small),
    ("room", True, lambda p: not p.goes_on and p.room()),
    ("entries", True, lambda p: not p.goes_on and p.entries()),
    ("flow", False, lambda p: p.gap < p.bounds.some_gap),
    ("small letter", False, lambda p: p.line.lower),
    ("indent", True, Pair.indented),
    ("sentence", True, lambda p: p.gap > p.bounds.sentence_gap and p.above.ended and p.line.capital and not p.line.joins),
    ("near", False, lambda p: True),
]


def verdict(pair: Pair) -> tuple[str, bool]:
    return next((name, breaks) for name, breaks, applies in RULES if applies(pair))


Box = tuple[float, float, float, float]


class _Bands:
    """Boxes by their tops, to find those that share a band of heights with another."""

    def __init__(self, boxes: list[Box]):
        self.boxes = sorted(boxes, key=lambda b: b[1])
        self.tops = [b[1] for b in self.boxes]
        self.tallest = max((b[3] - b[1] for b in boxes), default=0.0)

    def beside(self, top: float, bottom: float) -> Iterator[Box]:
        lo, hi = bisect_left(self.tops, top - self.tallest), bisect_left(self.tops, bottom)
        return (b for b in self.boxes[lo:hi] if b[3] > top)

    def first_right(self, x: float, top: float, bottom: float, limit: float) -> float:
        return min([limit, *(b[0] for b in self.beside(top, bottom) if b[0] > x)])


def set_margins(lines: list[Line], obstacles: list[Box], width: float | None, b: Bounds) -> None:
    """How far to the right each line might have gone.

    Where neighbours above and below end and begin together, text flows up to their end, unless more room is free beside
    the line than it takes up itself. Else the line is free up to the next text or obstacle, or the page's edge.
    Obstacles bound its room in any case. Without the page's width neighbours alone make a margin, and no room is known.
    """
    text, blocks = _Bands([(x.x0, x.top, x.x1, x.bottom) for x in lines]), _Bands(obstacles)
    order = sorted(lines, key=lambda x: x.top + x.bottom)
    middles = [(x.top + x.bottom) / 2 for x in order]
    for x in lines:
        middle, reach = (x.top + x.bottom) / 2, b.window * x.size
        near = [y for y in order[bisect_left(middles, middle - reach) : bisect_right(middles, middle + reach)] if y is x or y.x1 > x.x0 and y.x0 < x.x1]
        right, left = max(y.x1 for y in near), min(y.x0 for y in near)
        together = lambda edges: sum(e <= x.size / 2 for e in edges) >= 2  # noqa: B023, E731
        flows = together(right - y.x1 for y in near) and together(y.x0 - left for y in near)
        x.margin = right
        if width is not None:
            free = min(text.first_right(x.x1, x.top, x.bottom, width), blocks.first_right(x.x1, x.top, x.bottom, width))
            if not flows or x.x1 - x.x0 < free - x.x1:
                x.margin = free
            x.room = blocks.first_right(x.x1, x.top, x.bottom, x.margin) - x.x1


def _over(above: Line, line: Line, share: float) -> bool:
    """Whether a line lies above another in its cell and column."""
    narrower = max(1.0, min(above.x1 - above.x0, line.x1 - line.x0))
    return above.cell == line.cell and above.bottom <= line.top + line.size / 2 and min(above.x1, line.x1) - max(above.x0, line.x0) > share * narrower


def paragraphs(lines: DataFrame, page: list[str], obstacles: DataFrame | None = None, width: str | None = None, bounds: Bounds = Bounds(), open_words: list[str] = OPEN_WORDS, joining: list[str] = JOINING) -> DataFrame:
    """page, seq, paragraph (from 0) and rule, for lines with page's columns, seq, x0, top, x1, bottom, base, size, glyph, bold, cell and text.

    A line follows the nearest of the paragraphs' last lines that lie above it in its cell and column, unless one of RULES
    breaks there; rule names what decided, and is null for a line with none above it. Lines are gone through from the top, in
    tenths of a point, and from the left. obstacles (page's columns, x0, top, x1, bottom) are pictures and drawings;
    width names a column with the page's width. A null text is empty; a null glyph is half the size, a null size 1.
    """
    proven = list_markers(lines, page, bounds.edge)
    size = F.coalesce(F.nullif(F.col("size").cast("double"), F.lit(0.0)), F.lit(1.0))
    shown = {k: F.coalesce(c, F.lit(0 if k == "word" else False)) for k, c in marks(F.coalesce("text", F.lit("")), open_words, joining).items()}
    boxes = [F.col(c).cast("double").alias(c) for c in ("x0", "top", "x1", "bottom", "base")]
    rows = lines.join(proven, [*page, "seq"], "left").select(
        *page, F.lit(False).alias("obstacle"), (F.col(width).cast("double") if width else F.lit(None).cast("double")).alias("width"), "seq", *boxes, size.alias("size"),
        F.coalesce(F.col("glyph").cast("double"), size / 2).alias("glyph"), F.coalesce("bold", F.lit(False)).alias("bold"), "cell", F.coalesce("proven", F.lit(False)).alias("proven"), *(c.alias(k) for k, c in shown.items()),
    )
    if obstacles is not None:
        rows = rows.unionByName(obstacles.select(*page, F.lit(True).alias("obstacle"), *(F.col(c).cast("double").alias(c) for c in ("x0", "top", "x1", "bottom"))), allowMissingColumns=True)
    rows = rows.withColumn("height", F.round("top", 1))

    def fold(stream: Iterator[tuple]) -> Iterator[tuple]:
        own, boxes, wide = [], [], None
        for obstacle, width, *row in stream:
            if obstacle:
                boxes.append(tuple(row[1:5]))
            else:
                own.append(Line(*row))
                wide = width if width is not None else wide
        set_margins(own, boxes, wide, bounds)
        last: list[Line] = []
        first: list[Line] = []
        left: list[float] = []
        for line in own:
            k = max((i for i, above in enumerate(last) if _over(above, line, bounds.overlap)), key=lambda i: last[i].base, default=None)
            rule, breaks = verdict(Pair(last[k], line, left[k], first[k], bounds)) if k is not None else (None, True)
            if breaks:
                k = len(last)
                last.append(line)
                first.append(line)
                left.append(line.x0)
            last[k], left[k] = line, min(left[k], line.x0)
            yield line.seq, k, rule

    return fold_rows(rows, page, ["obstacle", "height", "x0", "seq"], ["obstacle", "width", *list(Line.__dataclass_fields__)[:-2]], "seq bigint, paragraph bigint, rule string", fold)


def split_trailing_numbers(lines: DataFrame, page: list[str], tolerance: float = 2.5, gap: float = 1.2) -> DataFrame:
    """lines with the numbers of pages that end entries of a table of contents as lines of their own.

    lines has x0, x1, text, glyph, and of its last run tail (its text), tail_x0, and body_x1 (where what stands before it
    ends; null: nothing does). A bare number at least `gap` glyphs away from its text is parted from it if its right edge
    is within the tolerance of another such number's, or of a line's that is a number by itself. Adds part: 0 for text and whole lines, 1 for numbers.
    """
    number = F.trim("tail").rlike(r"^\d{1,4}$")
    apart = number & F.col("body_x1").isNotNull() & (F.col("tail_x0") - F.col("body_x1") >= gap * F.col("glyph"))
    alone = F.trim("text").rlike(r"^\d{1,4}$")
    # in hundredths, as frames of ranges take whole numbers
    edge = F.round(F.round("x1", 1) * 100).cast("long")
    near = Window.partitionBy(*page).orderBy(edge).rangeBetween(round(-100 * tolerance), round(100 * tolerance))
    folio = F.coalesce(apart, F.lit(False))
    aligned = F.count_if(folio | F.coalesce(alone, F.lit(False))).over(near)
    found = lines.withColumn("_split", folio & (aligned >= 2))
    body = F.rtrim(F.expr("substring(text, 1, length(rtrim(text)) - length(trim(tail)))"))
    whole = F.struct(F.lit(0).alias("part"), F.col("x0"), F.when(F.col("_split"), F.col("body_x1")).otherwise(F.col("x1")).alias("x1"), F.when(F.col("_split"), body).otherwise(F.col("text")).alias("text"))
    tail = F.struct(F.lit(1).alias("part"), F.col("tail_x0").alias("x0"), F.col("x1"), F.trim("tail").alias("text"))
    parts = F.explode(F.when(F.col("_split"), F.array(whole, tail)).otherwise(F.array(whole))).alias("_part")
    kept = [c for c in lines.columns if c not in ("x0", "x1", "text", "tail", "tail_x0", "body_x1")]
    return found.select(*kept, parts).select(*kept, "_part.*")
