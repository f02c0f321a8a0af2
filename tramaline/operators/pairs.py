"""Operators over pairs of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def word_recall(pairs: DataFrame, keys: list[str], expected: str, read: str) -> DataFrame:
    """keys and recall: the share of the words of `expected` that `read` has too, each as often at most as there.

    Words are counted by pair and side, so that long texts are no more than rows. Without words it is 0.
    """
    def words(text: str, e: int, r: int) -> DataFrame:
        return pairs.select(*keys, F.explode(F.split(text, " ")).alias("w"), F.lit(e).alias("e"), F.lit(r).alias("r"))

    counts = words(expected, 1, 0).union(words(read, 0, 1)).withColumn("some", (F.col("w") != "").cast("int")).groupBy(*keys, "w")
    counts = counts.agg(F.sum(F.col("e") * F.col("some")).alias("e"), F.sum(F.col("r") * F.col("some")).alias("r"))
    return counts.groupBy(*keys).agg((F.sum(F.least("e", "r")) / F.greatest(F.sum("e"), F.lit(1)).cast("double")).alias("recall"))
