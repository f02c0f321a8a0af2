"""Notices that stand next to each other are all listed, whichever is the better copy."""

from __future__ import annotations

import time

import pyarrow as pa
import pytest

from tests.llm.test_llm_operators import frame
from tramaline.llm import license_scan
from tramaline.llm.textblock import blocks

EXACT, EDITED = "all rights reserved", "all rights reservd"


@pytest.mark.parametrize("order", [(EDITED, EXACT), (EXACT, EDITED), (EDITED, EDITED, EDITED, EXACT), (EDITED, EXACT, EDITED, EXACT, EDITED)])
@pytest.mark.parametrize("between", [". ", " and so on. ", " and a longer piece of text between the two notices "])
def test_all_are_listed(spark, order, between):
    want, at = [], 4
    for x in order:
        want.append(f"reserved:{at}:{at + len(x)}:{int(x == EDITED)}")
        at += len(x) + len(between)
    got = license_scan.scan_licenses(frame(spark, [(1, "été " + between.join(order) + between)])).first()
    assert got.spans == ",".join(want)
    assert (got.labels, got.score) == ("reserved", 1.0)


def test_many_edited_notices_in_one_text():
    """Work grows with the number of notices, not with its square: 400 kB of them within a few seconds."""
    n = 20_000
    for notice, edits in (("all rights reservd. ", 1), ("all rights reserved. ", 0)):
        text = notice * n
        began = time.process_time()
        found = [x for b in blocks(pa.array([text])) for x in license_scan.fuzzy_spans(b, tuple(license_scan.NOTICES), license_scan.CHARS_PER_EDIT)]
        assert time.process_time() - began < 6
        assert len(found) == n and {x[4] for x in found} == {edits}
