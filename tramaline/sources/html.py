"""Translatable blocks of web pages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed sets: elements whose text stays in a block as a tagged run; those that stand in it as an empty tag; those never
#: read; those without content; and attributes that are read.
INLINE = frozenset("a abbr b bdi bdo big cite data del dfn em font i ins label mark nobr q s small span strong sub sup textpath time tspan tt u var".split())
OPAQUE = frozenset("audio br canvas code embed iframe img input kbd math object picture samp select svg textarea video wbr".split())
IGNORED = frozenset("code input noscript pre script select style template textarea".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ATTRIBUTES = ("alt", "title", "placeholder", "aria-label")
#: Pages whose blocks are held at once.
PAGES = 100
_TAG = re.compile(r"\[\[/?\d+\]\]")


class _Blocks(HTMLParser):
    """Text between block elements, inline elements as [[n]]...[[/n]] (from 1), opaque ones as [[n]][[/n]].

    Attributes are blocks of their own. What translate="no" or the class notranslate marks isn't read; in a line it
    is an opaque element. Text that holds such tags by itself is left out.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, str]] = []
        self.closed: list[str] = []  # elements open inside one that isn't read
        self.begin()

    def begin(self) -> None:
        self.text, self.runs, self.n, self.trap = "", [], 0, False

    def flush(self) -> None:
        self.close_runs(0)
        text = " ".join(self.text.split())
        if not self.trap and any(c.isalpha() for c in _TAG.sub("", text)):
            self.out.append(("text", text))
        self.begin()

    def close_runs(self, depth: int) -> None:
        while len(self.runs) > depth:
            self.text += f"[[/{self.runs.pop()[1]}]]"

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.closed:
            self.closed += [] if tag in VOID else [tag]
            return
        named = dict(attrs)
        kept_out = named.get("translate") == "no" or "notranslate" in (named.get("class") or "").split()
        if not kept_out:
            self.out += [(a, named[a]) for a in ATTRIBUTES if named.get(a) and any(c.isalpha() for c in named[a])]
        in_line = tag in INLINE or tag in OPAQUE
        unread = kept_out or tag in OPAQUE or tag in IGNORED or "contenteditable" in named
        if in_line:
            self.n += 1
            self.text += f"[[{self.n}]]" + (f"[[/{self.n}]]" if unread else "")
        else:
            self.flush()
        if unread:
            self.closed = [] if tag in VOID else [tag]
        elif in_line:
            self.runs.append((tag, self.n))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.closed:
            if tag in self.closed:
                del self.closed[len(self.closed) - 1 - self.closed[::-1].index(tag) :]
        elif tag in INLINE:
            same = [i for i, (t, _) in enumerate(self.runs) if t == tag]
            if same:
                self.close_runs(same[-1])
        elif tag not in OPAQUE:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.closed:
            self.trap = self.trap or _TAG.search(data) is not None
            self.text += data


def html_segments(pages: DataFrame) -> DataFrame:
    """page_id, seq, kind (text or an attribute's name) and text of each block; null HTML has none."""

    schema = pa.schema([("page_id", pa.int64()), ("seq", pa.int64()), ("kind", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # blocks of a few pages are held, not those of a batch
            for at in range(0, batch.num_rows, PAGES):
                rows = []
                for page, html in zip(*(c.to_pylist() for c in batch.slice(at, PAGES).columns), strict=True):
                    parser = _Blocks()
                    parser.feed(html or "")
                    parser.close()
                    parser.flush()
                    rows += [(page, i, kind, text) for i, (kind, text) in enumerate(parser.out)]
                columns = zip(*rows, strict=True) if rows else ([] for _ in schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, "page_id long, seq long, kind string, text string")
