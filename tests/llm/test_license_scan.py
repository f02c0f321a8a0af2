"""License scans against plain regular expressions over whole texts."""

from __future__ import annotations

import re

import numpy as np
import pytest
import regex

from tests.llm.test_llm_operators import ODD, WORD, frame, lower, prose
from tramaline.llm import license_scan as ls


def base_brute(text):
    words = WORD.findall(lower(text))
    places = []
    for phrase, label in ls.BASE.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    at = [i for i, _ in places]
    return (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))


def flowing_brute(text):
    """Running text and where each of its characters stood."""
    out, at, last = "", [], 0
    for m in re.finditer(r"[\t\n\x0b\x0c\r !#%*\-/;>|]+", text):
        one = re.search(r"[\r\n]", m[0]) or not re.search(r"[!#%*\-/;>|]", m[0])
        out += text[last : m.start()] + (" " if one else m[0])
        at += [*range(last, m.start()), *(range(m.start(), m.end()) if not one else [m.start()])]
        last = m.end()
    return out + text[last:], [*at, *range(last, len(text))]


def spans_brute(text, notices):
    """Of each notice its best match in the whole text, and likewise before and after it."""
    flow, at = flowing_brute(lower(text))
    out = []
    for k, notice in enumerate(notices):
        e = len(notice.encode()) // ls.CHARS_PER_EDIT
        p = regex.compile(f"(?b)(?:{regex.escape(notice)}){{e<={e}}}")
        rest = [(0, len(flow))]
        while rest:
            lo, hi = rest.pop()
            if lo < hi and (m := p.search(flow[lo:hi])):
                out.append((at[lo + m.start()], at[lo + m.end() - 1] + 1, k, sum(m.fuzzy_counts)))
                rest += [(lo, lo + m.start()), (lo + m.end(), hi)]
    beaten = lambda x, y: y[0] < x[1] and x[0] < y[1] and y[3] < x[3] and 5 * (y[1] - y[0]) >= 4 * (x[1] - x[0])
    return sorted(x for x in out if not any(beaten(x, y) for y in out))


def edited(rng, notice):
    t = list(notice)
    for _ in range(int(rng.integers(0, len(notice) // ls.CHARS_PER_EDIT + 1))):
        i = int(rng.integers(len(t)))
        t[i : i + int(rng.integers(2))] = [chr(97 + int(rng.integers(26)))] * int(rng.integers(2))
    return "".join(t)


def test_at_least_fifty_notices():
    assert len(ls.NOTICES) >= 50 and all(n == lower(n) for n in ls.NOTICES)


def test_columns(spark):
    rng = np.random.default_rng(8)
    notices = list(ls.NOTICES)
    docs = list(ODD)
    for i in range(120):
        picked = [edited(rng, notices[int(rng.integers(len(notices)))]) for _ in range(int(rng.integers(0, 4)))]
        parts = [p for x in picked for p in (prose(int(rng.integers(99)), int(rng.integers(1, 9))), x)]
        docs.append((100 + i, " ".join(parts).title() if i % 3 else ". ".join(parts)))
    docs += [(300, "All rights reservd. All rights reserved."), (301, "released under the MIT licence released under the mit license"), (302, "x" * 1_200_000 + " cc by " + "all rights reserved " * 3)]
    got = sorted(ls.scan_licenses(frame(spark, docs)).collect(), key=str)
    assert len(got) == len(docs)
    text = dict(docs)
    lost = total = 0
    for r in got:
        t = text[r.doc_id] or ""
        if r.doc_id is None or r.doc_id == 5:
            continue  # keys that repeat
        assert tuple(r)[1:6] == base_brute(t)
        if len(t) > 10_000:
            assert r.n_base == 4 and r.spans.count("reserved:") == 3
            continue
        want = spans_brute(t, notices)
        mine = [x.rsplit(":", 3) for x in r.spans.split(",")] if r.spans else []
        total += len(want)
        # a match may differ by where an edit at its edge is counted, so spans are held against each other by overlap
        lost += sum(not any(label == ls.NOTICES[notices[k]] and int(x) < b and a < int(y) for label, x, y, _ in mine) for a, b, k, _ in want)
        assert set(r.labels.split(",")) - {""} == set(r.base_labels.split(",")) - {""} | {x[0] for x in mine}
        best = max([1.0] * bool(r.n_base) + [1 - e / len(notices[k].encode()) for *_, k, e in want], default=0.0)
        assert r.score == pytest.approx(best, abs=0.03)
    assert total > 150 and lost <= 0.01 * total


@pytest.mark.parametrize("text", ["All rights reservd. All rights reserved.", "released under the MIT licence released under the mit license"])
def test_both_of_two(spark, text):
    assert ls.scan_licenses(frame(spark, [(1, text)])).first().spans.count(":") == 6 and len(set(ls.scan_licenses(frame(spark, [(1, text)])).first().labels.split(","))) == 1


@pytest.mark.parametrize("lead", ["\n", "\r\n * ", "\n// ", "\n# ", "  \n;;  ", "\n\n-- "])
def test_broken_lines(spark, lead):
    text = "été. Licensed under the" + lead + "Apache License," + lead + "Version 2.0"
    r = ls.scan_licenses(frame(spark, [(1, text)]), notices={"licensed under the apache license, version 2.0": "apache-2.0"}).first()
    assert r.spans == f"apache-2.0:5:{len(text)}:0" and r.score == 1.0
