"""What a batch of texts is sent with."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def page_context(lines: DataFrame, page: list[str], most: int = 2500) -> DataFrame:
    """page's columns, batch and context: of the page's text, `most` characters about the batch's middle.

    lines has page's columns, batch, seq and line. A page that fits is whole; near an end the context reaches it.
    """
    past = F.sum(F.length("line") + 1).over(Window.partitionBy(*page).orderBy("seq"))
    placed = lines.withColumn("_past", past)
    spans = placed.groupBy(*page, "batch").agg(F.min(F.col("_past") - F.length("line") - 1).alias("_lo"), F.max(F.col("_past") - 1).alias("_hi"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"])
    whole = lines.groupBy(*page).agg(F.array_join(parts, "\n").alias("_text"))
    both = spans.join(whole, page).withColumn("_at", F.expr(f"greatest(0L, least(length(_text) - {most}, (_lo + _hi) div 2 - {most // 2}))"))
    return both.select(*page, "batch", F.expr(f"substring(_text, cast(1 + _at as int), {most})").alias("context"))
