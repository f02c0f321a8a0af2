"""License scans: fuzzy search for short notices.

A notice may be met with a few edits. Split into two pieces more than the edits allowed, at least two pieces
stand unchanged in any such match (pigeonhole), at places that agree up to the edits. One pass of an Aho-Corasick
automaton finds the pieces; around two that agree the regex library looks for the whole notice within its bound of
errors. A word that many notices share is so no candidate by itself.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramaline.llm.textblock import ALNUM, Block, blocks

#: Fixed phrases of the base labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Fixed short notices of public licenses, lower-cased, by label.
NOTICES_OF = {
    "afl": ["academic free license"],
    "agpl": ["gnu affero general public license"],
    "apache-2.0": ["licensed under the apache license, version 2.0", "apache license, version 2.0", "released under the apache license"],
    "artistic": ["licensed under the artistic license", "same terms as perl itself"],
    "bsd": ["redistribution and use in source and binary forms", "licensed under the bsd license", "released under the bsd license", "this software is provided by the copyright holders and contributors"],
    "bsl": ["business source license"],
    "boost": ["boost software license"],
    "cc-by": ["licensed under cc by", "creative commons attribution", "licensed under a creative commons attribution license"],
    "cc-by-nc": ["creative commons attribution-noncommercial"],
    "cc-by-nd": ["creative commons attribution-noderivs"],
    "cc-by-sa": ["creative commons attribution-sharealike"],
    "cc0": ["cc0 1.0 universal", "creative commons zero"],
    "cddl": ["common development and distribution license"],
    "cecill": ["cecill free software license"],
    "cpl": ["common public license"],
    "elastic": ["licensed under the elastic license"],
    "epl": ["eclipse public license"],
    "eupl": ["european union public licence"],
    "gfdl": ["gnu free documentation license"],
    "gpl": ["licensed under the gnu general public license", "under the terms of the gnu general public license", "released under the gpl"],
    "isc": ["permission to use, copy, modify, and/or distribute this software for any purpose", "licensed under the isc license"],
    "lgpl": ["licensed under the gnu lesser general public license", "gnu library general public license"],
    "lppl": ["latex project public license"],
    "mit": ["permission is hereby granted, free of charge", "released under the mit license", "licensed under the mit license"],
    "mpl": ["subject to the terms of the mozilla public license", "mozilla public license"],
    "ms-pl": ["microsoft public license"],
    "ncsa": ["university of illinois/ncsa open source license"],
    "odbl": ["open data commons open database license"],
    "odc-by": ["open data commons attribution license"],
    "ofl": ["sil open font license"],
    "openssl": ["openssl toolkit license"],
    "osl": ["open software license"],
    "pddl": ["public domain dedication and license"],
    "proprietary": ["proprietary and confidential", "unauthorized copying of this file", "no part of this publication may be reproduced"],
    "psf": ["python software foundation license"],
    "public-domain": ["released into the public domain", "dedicated to the public domain"],
    "reserved": ["all rights reserved", "tous droits réservés", "todos los derechos reservados", "alle rechte vorbehalten"],
    "sspl": ["server side public license"],
    "unlicense": ["this is free and unencumbered software"],
    "upl": ["universal permissive license"],
    "zlib": ["this software is provided 'as-is', without any express or implied warranty"],
}
NOTICES = {notice: label for label, notices in NOTICES_OF.items() for notice in notices}
#: One edit is allowed for so many characters of a notice.
CHARS_PER_EDIT = 9
#: White space, and marks that open lines of comments: between words at a line's end, they are one space.
SPACE, MARK = np.zeros(256, bool), np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
MARK[list(b"!#%*-/;>|")] = True


@lru_cache(maxsize=4)
def _seeds(notices: tuple[str, ...], chars_per_edit: int):
    """The automaton of all pieces; of each notice its pattern, length and edits."""
    pieces: dict[bytes, list[tuple[int, int, int]]] = {}
    found = []
    for k, notice in enumerate(x.encode() for x in notices):
        edits = len(notice) // chars_per_edit
        found.append((regex.compile(rb"(?b)(?:" + regex.escape(notice) + b"){e<=" + str(edits).encode() + b"}"), len(notice), edits))
        cuts = [len(notice) * i // (edits + 2) for i in range(edits + 3)]
        for j, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            pieces.setdefault(notice[a:b], []).append((k, j, a))
    machine = ahocorasick.Automaton()
    for piece, owners in pieces.items():
        machine.add_word(piece.decode("latin-1"), (len(piece), owners))
    machine.make_automaton()
    return machine, found


def flowing(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's bytes as running text, where each stood, and where each document begins.

    A run of white space is one space; so is one of white space and comment marks with a line break in it.
    """
    data = block.bytes
    filler = np.append(SPACE[data] | MARK[data], False)
    before = np.zeros(len(filler), bool)
    before[1:] = filler[:-1]
    before[block.offsets] = False  # a run doesn't go on into the next document
    start = np.flatnonzero(filler & ~before)
    after = filler.copy()
    after[block.offsets] = False
    end = np.flatnonzero(filler[:-1] & ~after[1:]) + 1
    up_to = lambda on: np.append(0, np.cumsum(on))
    breaks, marks = up_to((data == 10) | (data == 13)), up_to(MARK[data])
    one = (breaks[end] > breaks[start]) | (marks[end] == marks[start])
    keep, out = np.ones(len(data), bool), data.copy()
    inside = np.zeros(len(data) + 1, np.int64)
    np.add.at(inside, start[one] + 1, 1)
    np.add.at(inside, end[one], -1)
    keep[np.cumsum(inside)[:-1] > 0] = False
    out[start[one]] = 32
    return out[keep], np.flatnonzero(keep), up_to(keep)[block.offsets]


def _matches(pattern: regex.Pattern[bytes], least: int, data: bytes, windows: list[tuple[int, int]]) -> list[regex.Match[bytes]]:
    """Matches of at least so many bytes, none overlapping: the best of each window, of those that overlap the better one.

    A window whose match gave way is searched again beside what took its place, so that it never grows, and all
    windows together take time in proportion to their number.
    """
    taken: list[tuple[int, int]] = []
    out = []
    while windows:
        found = [(sum(m.fuzzy_counts), m.start(), m, w) for w in sorted(set(windows)) if w[1] - w[0] >= least and (m := pattern.search(data, *w))]
        windows = []
        for _, start, m, (lo, hi) in sorted(found, key=lambda x: x[:2]):
            i = bisect_left(taken, (start, m.end()))
            beside = [t for t in taken[max(0, i - 1) : i + 2] if t[0] < m.end() and t[1] > start]
            if not beside:
                taken.insert(i, (start, m.end()))
                out.append(m)
            elif (start, m.end()) not in beside:
                edges = [lo, *(x for t in beside for x in t), hi]
                windows += [(a, b) for a, b in zip(edges[::2], edges[1::2], strict=True) if a < b]
    return out


def agreeing(places: list[tuple[int, int]], edits: int) -> list[int]:
    """Of sorted (begin of the notice, piece), the begins that another piece gives, too, up to so many edits."""
    out: list[int] = []
    for i, (begin, piece) in enumerate(places):
        for near, other in _following(places, i):
            if near - begin > edits:
                break
            if other != piece:
                out += [begin, near]
    return sorted(set(out))


def _following(places: list[tuple[int, int]], i: int) -> Iterator[tuple[int, int]]:
    return (places[k] for k in range(i + 1, len(places)))


def fuzzy_spans(block: Block, notices: tuple[str, ...], chars_per_edit: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, end, notice, edits) of the block's matches, in bytes of the document, sorted."""
    machine, patterns = _seeds(notices, chars_per_edit)
    data, stood, offsets = flowing(block)
    raw = data.tobytes()
    hits: dict[int, list[tuple[int, int]]] = {}
    for last, (size, owners) in machine.iter(raw.decode("latin-1")):
        for k, j, a in owners:
            hits.setdefault(k, []).append((last + 1 - size - a, j))
    out = []
    for k, places in hits.items():
        _, n, e = patterns[k]
        spans: list[tuple[int, int]] = []
        first = None
        for begin in agreeing(sorted(places), e):
            if first is not None and begin - first <= e:  # another place of the same notice, shifted by its edits
                spans[-1] = (first - e, begin + n + e)
            else:
                first = begin
                spans.append((begin - e, begin + n + e))
        if not spans:
            continue
        doc = np.searchsorted(offsets, [a + (b - a) // 2 for a, b in spans], "right") - 1
        windows: dict[int, list[tuple[int, int]]] = {}
        for (a, b), near in zip(spans, np.clip(doc, 0, block.hi - block.lo - 1).tolist(), strict=True):
            for d in range(max(0, near - 1), min(block.hi - block.lo, near + 2)):  # a window may touch neighbours
                lo, hi = max(a, int(offsets[d])), min(b, int(offsets[d + 1]))
                if hi > lo:
                    windows.setdefault(d, []).append((lo, hi))
        for d, own in windows.items():
            home, (pattern, n, e) = int(block.offsets[d]), patterns[k]
            out += [(d, int(stood[m.start()]) - home, int(stood[m.end() - 1]) + 1 - home, k, sum(m.fuzzy_counts)) for m in _matches(pattern, n - e, raw, own)]
    return sorted(out)


def better(spans: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Sorted spans without those that a closer match of about the same place outdoes.

    Notices may differ by the name of a license alone: of two that overlap, the one with more edits goes, unless
    the other is shorter by a fifth.
    """
    out, live = [], []
    lost = set()
    for x in spans:
        live = [y for y in live if y[0] == x[0] and y[2] > x[1]]
        for y in live:
            for a, b in ((x, y), (y, x)):
                if b[4] < a[4] and 5 * (b[2] - b[1]) >= 4 * (a[2] - a[1]):
                    lost.add(a)
        live.append(x)
        out.append(x)
    return [x for x in out if x not in lost]


def _phrase_places(block: Block, h: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Words at which the phrase begins, inside one document."""
    n = len(h) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    same = block.doc[:n] == block.doc[len(phrase) - 1 :]
    for j, x in enumerate(phrase):
        same &= h[j : j + n] == x
    return np.flatnonzero(same)


def scan_licenses(docs: DataFrame, phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Base counts come from places where a phrase's words stand consecutively. labels adds those of notices found
    with at most len // chars_per_edit edits. score is 1 with a base place, else the best match's share of
    characters that need no edit, else 0. Of notices that overlap at about one place, the closest counts. They may be broken over lines, with comment marks. spans lists the fuzzy matches as label:start:end:edits (code points).
    A null or empty text has no words, zero counts, null first_word and last_word, and empty labels. Keys may
    be null or repeat; other columns are not read.
    """
    phrases, notices = phrases or BASE, notices or NOTICES
    names, texts = list(notices.values()), tuple(notices)
    one = next(iter(blocks(pa.array([" ".join(phrases).encode()], pa.binary()))))
    one.words(ALNUM)
    h, known = one.word_hashes(), []
    for phrase, label in phrases.items():
        n = len(phrase.split())
        known.append((h[:n].copy(), label))
        h = h[n:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for block in blocks(batch.column(1)):
                rows += _rows(block)
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.string()]
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    def _rows(block: Block) -> list[tuple]:
        block.words(ALNUM)
        hashes = block.word_hashes()
        base: dict[int, list[tuple[int, str]]] = {}
        for phrase, label in known:
            for w in _phrase_places(block, hashes, phrase).tolist():
                base.setdefault(int(block.doc[w]), []).append((w - int(block.first[block.doc[w]]), label))
        fuzzy: dict[int, list[tuple[int, int, int, int]]] = {}
        for d, a, b, k, e in better(fuzzy_spans(block, texts, chars_per_edit)):
            fuzzy.setdefault(d, []).append((a, b, k, e))
        rows = []
        for d, n in enumerate(np.diff(block.first).tolist()):
            places, spans = base.get(d, ()), fuzzy.get(d, ())
            if not places and not spans:
                rows.append((n, 0, None, None, "", "", 0.0, ""))
                continue
            text = block.raw[block.offsets[d] : block.offsets[d + 1]]
            lead = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
            at = [w for w, _ in places]
            own = sorted({x for _, x in places})
            every = sorted({*own, *(names[k] for _, _, k, _ in spans)})
            score = 1.0 if places else max(max(0.0, 1 - e / len(texts[k])) for _, _, k, e in spans)
            said = ",".join(f"{names[k]}:{lead[a]}:{lead[b]}:{e}" for a, b, k, e in spans)
            rows.append((n, len(at), min(at, default=None), max(at, default=None), ",".join(own), ",".join(every), score, said))
        return rows

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string")
