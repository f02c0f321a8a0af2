"""What was extracted from documents of any format: nested JSON to flat segments, in one pass of columns."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tramaline.session import shared_folder

_BLOCK = "struct<text: string, context: struct<type: string>>"
_BLOCKS = f"array<{_BLOCK}>"
_NESTED = f"array<struct<text_elements: {_BLOCKS}>>"
#: Lists of a slide and of a text document, in the order in which they are read (fixed names).
SLIDE_GROUPS = ("diagram_elements", "chart_elements", "layout_elements", "master_elements")
SECTIONS = ("elements", "headers", "footers", "textboxes", "smartarts", "charts")
SCHEMA = ", ".join((
    f"pages array<struct<text_blocks: {_BLOCKS}>>",
    f"slides array<struct<text_elements: {_BLOCKS}, {', '.join(f'{g}: {_NESTED}' for g in SLIDE_GROUPS)}, excel_elements: {_BLOCKS}>>",
    f"workbook struct<elements: {_BLOCKS}>",
    f"document struct<{', '.join(f'{s}: {_BLOCKS}' for s in SECTIONS)}>",
    f"objets {_BLOCKS}",
))
_SEGMENT = "array<struct<section: string, unit: bigint, kind: string, text: string>>"


def _listed(blocks: Column, section: str, unit: Column) -> Column:
    """Blocks as segments; none for null."""
    one = lambda b: F.struct(F.lit(section).alias("section"), unit.cast("long").alias("unit"), b["context"]["type"].alias("kind"), b["text"].alias("text"))
    return F.coalesce(F.transform(blocks, one), F.array().cast(_SEGMENT))


def _slide(s: Column, i: Column) -> Column:
    groups = [F.flatten(F.transform(s[g], lambda x: F.coalesce(x["text_elements"], F.array().cast(_BLOCKS)))) for g in SLIDE_GROUPS]
    return F.concat(*(_listed(b, "slide", i) for b in (s["text_elements"], *groups, s["excel_elements"])))


def load_segments(extracts: DataFrame, keys: list[str], body: str) -> DataFrame:
    """keys, seq (from 0), section, unit, kind and text of each block whose text isn't blank, in reading order.

    body is JSON of one of the shapes: pages of text_blocks; slides, each with its texts, diagrams, charts, layouts,
    masters and sheets; a workbook's elements; a document's elements, headers, footers, boxes, graphics and charts.
    The first of these that is there counts. Embedded objects (objets) follow, beside any of them. unit is the number
    of the page or slide. Text that isn't JSON, and null, have no segments.
    """
    none = F.array().cast(_SEGMENT)
    x = F.from_json(body, SCHEMA)
    pages = F.flatten(F.transform(x["pages"], lambda p, i: _listed(p["text_blocks"], "page", i)))
    slides = F.flatten(F.transform(x["slides"], _slide))
    document = F.concat(*(_listed(x["document"][s], s, F.lit(0)) for s in SECTIONS))
    main = F.when(x["pages"].isNotNull(), pages).when(x["slides"].isNotNull(), slides).when(x["workbook"].isNotNull(), _listed(x["workbook"]["elements"], "workbook", F.lit(0))).otherwise(document)
    every = F.concat(F.coalesce(main, none), _listed(x["objets"], "objets", F.lit(0)))
    written = F.filter(every, lambda b: F.coalesce(F.rlike(b["text"], F.lit(r"(?U)\S")), F.lit(False)))
    out = extracts.select(*keys, F.posexplode(written).alias("seq", "b"))
    return out.select(*keys, F.col("seq").cast("long").alias("seq"), "b.section", "b.unit", "b.kind", "b.text")


@F.pandas_udf(ArrayType(StringType()))
def text_leaves(bodies: pd.Series) -> pd.Series:
    """Every string named text, at any depth of a JSON document, each before those inside its neighbours.

    Null for null and for what isn't JSON.
    """

    def leaves(root: object) -> Iterator[str]:
        todo = [root]
        while todo:  # a stack, as documents may be deeper than calls
            node = todo.pop()
            if isinstance(node, dict) and isinstance(node.get("text"), str):
                yield node["text"]
            if isinstance(node, (dict, list)):
                todo += reversed(list(node.values() if isinstance(node, dict) else node))

    def of(body: str | None) -> list[str] | None:
        try:
            return None if body is None else list(leaves(json.loads(body)))
        except (ValueError, RecursionError):
            return None

    return bodies.map(of, na_action=None)


def export_json(rows: DataFrame, newest: str, order: list[str], most: int = 5000, path: str | None = None) -> str:
    """Write the `most` newest rows as JSON lines, newest first; gives the folder, by default a new one in the shared."""
    path = path or f"{shared_folder(rows.sparkSession)}/export-{uuid.uuid4().hex}"
    rows.orderBy(F.desc(newest), *order).limit(most).write.json(path)
    return path
