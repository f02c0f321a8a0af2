"""Rewrites of usage ledgers: refunds, charges again, partial deliveries. Every row comes back, changed or not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Formats of which pages that are done can be delivered on their own.
BY_PAGE = ("pdf", "pptx")


def refund_documents(usage: DataFrame, failed: Column) -> DataFrame:
    """usage with every row of failed documents marked as refunded, and credits_back: credits that this returns.

    usage has kind, pages and refunded. Rows refunded before return nothing, so that a second run changes nothing.
    """
    now = failed & ~F.col("refunded")
    back = F.when(now & (F.col("kind") == "credits"), F.col("pages")).otherwise(F.lit(0).cast("long"))
    return usage.withColumn("credits_back", back).withColumn("refunded", F.col("refunded") | failed)


def refund_unfinished(usage: DataFrame, kept: str, order: tuple[str, ...] = ("line", "part", "pages")) -> DataFrame:
    """usage with given_back, the pages beyond `kept` of each document, credits first, and pages less that.

    usage has document_id, kind and pages, of rows not refunded; kept is null where a document isn't unfinished.
    """
    document = Window.partitionBy("document_id")
    before = document.orderBy((F.col("kind") != "credits").cast("int"), *order).rowsBetween(Window.unboundedPreceding, -1)
    back = F.coalesce(F.greatest(F.sum("pages").over(document) - F.col(kept), F.lit(0)), F.lit(0))
    left = F.greatest(back - F.coalesce(F.sum("pages").over(before), F.lit(0)), F.lit(0))
    given = usage.withColumn("given_back", F.least("pages", left))
    return given.withColumn("pages", F.col("pages") - F.col("given_back"))


def rebill_documents(usage: DataFrame, delivered: Column) -> DataFrame:
    """usage with refunds of delivered documents taken back, and pages_again and credits_again: what that charges."""
    again = delivered & F.col("refunded")
    zero = F.lit(0).cast("long")
    out = usage.withColumn("pages_again", F.when(again, F.col("pages")).otherwise(zero))
    out = out.withColumn("credits_again", F.when(F.col("kind") == "credits", F.col("pages_again")).otherwise(zero))
    return out.withColumn("refunded", F.col("refunded") & ~delivered)


def partial_delivery(lines: DataFrame, stopped: Column, paid: int | str, formats: tuple[str, ...] = BY_PAGE) -> DataFrame:
    """lines with delivered: the first `paid` (a number or column) of each stopped document in one of the formats."""
    rank = F.row_number().over(Window.partitionBy("document_id").orderBy("line"))
    most = F.lit(paid) if isinstance(paid, int) else F.col(paid)
    return lines.withColumn("_rank", rank).withColumn("delivered", stopped & F.col("format").isin(*formats) & (F.col("_rank") <= most)).drop("_rank")
