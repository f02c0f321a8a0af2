"""Numbered tags of a block, as a tree: [[n]] opens an element, [[/n]] ends it."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TAG = re.compile(r"\[\[(/?)(\d+)\]\]")


def elements(text: str) -> Iterator[tuple[int, int | None, bool]]:
    """(element, its parent, or None for the block, whether it has content), as elements end; ValueError if they aren't a tree.

    Not a tree: an end that isn't the open element's, an element without one, or one that comes twice. One pass with a
    stack, so that depth doesn't matter.
    """
    stack, met, at = [[None, False]], set(), 0
    for tag in _TAG.finditer(text):
        stack[-1][1] |= not text[at : tag.start()].isspace() and at < tag.start()
        at, n = tag.end(), int(tag[2])
        if tag[1]:
            number, filled = stack.pop()
            if number != n or not stack:
                raise ValueError(f"[[/{n}]] ends no open element")
            yield n, stack[-1][0], filled
        elif n in met:
            raise ValueError(f"[[{n}]] comes twice")
        else:
            stack[-1][1] = True
            met.add(n)
            stack.append([n, False])
    if len(stack) > 1:
        raise ValueError(f"[[{stack[-1][0]}]] has no end")


def same_tree(target: str | None, source: str | None, voids: list[int] | None) -> bool:
    """Whether target has the elements of source, each under its parent, and those of voids empty."""
    try:
        expected = {n: parent for n, parent, _ in elements(source or "")}
        found = list(elements(target or ""))
    except ValueError:
        return False
    empty = set(() if voids is None else voids)
    return {n: parent for n, parent, _ in found} == expected and not any(filled for n, _, filled in found if n in empty)


def tag_tree_ok(target: Column | str, source: Column | str, voids: Column | str) -> Column:
    """same_tree of columns: two texts, and an array of the numbers of void elements, such as images and line breaks."""

    @F.pandas_udf("boolean")
    def run(target: pd.Series, source: pd.Series, voids: pd.Series) -> pd.Series:
        return pd.Series([same_tree(*row) for row in zip(target, source, voids, strict=True)], dtype=bool)

    return run(target, source, voids)
