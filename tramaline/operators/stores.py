"""Rules of the store of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orphan_roots(roots: DataFrame, references: DataFrame, root: str = "root", path: str = "path", separator: str = "/") -> DataFrame:
    """roots that no reference is, or lies under: a reference lies under each of the prefixes that end before a separator.

    References become all their prefixes, each once, so that the two are joined by equality, however deep a root is. A
    null reference refers to nothing; a null root is never referred to. A root that ends in a separator is what stands
    before it.
    """
    parts = F.split(F.col(path), "\\Q" + separator + "\\E")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), separator))
    held = references.where(F.col(path).isNotNull()).select(F.explode(prefixes).alias("_held")).distinct()
    bare = F.regexp_replace(F.col(root), "\\Q" + separator + "\\E+$", "")
    return roots.join(held, bare == F.col("_held"), "left_anti")
