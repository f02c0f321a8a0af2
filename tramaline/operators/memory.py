"""What a document remembers: texts sent once, one translation per text, translations served again, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramaline.functions import text as T


def distinct_texts(texts: DataFrame, scope: list[str], order: list[str], text: str = "text") -> DataFrame:
    """texts with place: where each occurrence's text stands (from 1) in its scope's list of distinct texts, as first seen.

    Texts without a letter aren't in the list: their place is null. What is answered for a place goes back to every
    occurrence by a join on scope and place.
    """
    known = T.letters(text) > 0
    first = F.min(F.struct(*order)).over(Window.partitionBy(*scope, text))
    # a text's first occurrence is the only one whose order is the first
    seen = texts.withColumn("_first", F.when(known, first)).withColumn("_new", F.coalesce(F.col("_first") == F.struct(*order), F.lit(False)))
    listed = seen.withColumn("_n", F.count_if("_new").over(Window.partitionBy(*scope).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    place = F.when(known, F.min("_n").over(Window.partitionBy(*scope, text)))
    return listed.select(*texts.columns, place.alias("place"))


def harmonised(pairs: DataFrame, scope: list[str], order: list[str], text: str = "text", translation: str = "translation") -> DataFrame:
    """pairs with one translation of each text in a scope: the most frequent; of these one that is the text itself, then the first.

    Blank texts, and occurrences that aren't translated (null), stay as they are and don't vote.
    """
    votes = F.count("*").over(Window.partitionBy(*scope, text, translation))
    first = F.min(F.struct(*order)).over(Window.partitionBy(*scope, text, translation))
    counts = pairs.withColumn("_votes", F.when(F.col(translation).isNotNull(), votes)).withColumn("_first", first)
    best = Window.partitionBy(*scope, text).orderBy(F.desc_nulls_last("_votes"), F.desc(F.coalesce(F.col(text) == F.col(translation), F.lit(False))), "_first")
    chosen = F.first(translation).over(best.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    settled = F.when(F.col(translation).isNotNull() & (F.trim(text) != ""), chosen).otherwise(F.col(translation))
    return counts.withColumn("_settled", settled).select(*(F.col("_settled").alias(c) if c == translation else F.col(c) for c in pairs.columns))


def document_memory(items: DataFrame, scope: list[str], order: list[str], tagged: str = "tagged", translation: str = "translation", failed: str | None = None, most: int = 120) -> DataFrame:
    """items with served: the translation that the document's memory gives again, null where the item is translated itself.

    The first item of a key (the text without tags, memo_key) that was translated, in order, is remembered if the key has
    `most` characters at most; failed (a column) names items that only repeat their source. Later items of the key get its
    translation if their tags stand at the same words; with other tags they are translated anew.
    """
    key, written = T.memo_key(tagged), T.without_typography(tagged)
    done = F.col(translation).isNotNull() & (F.col(translation) != "")
    if failed is not None:
        done = done & ~F.coalesce(F.col(failed), F.lit(False))
    keyed = items.withColumn("_key", key).withColumn("_entry", F.when(done, F.struct(written.alias("tagged"), F.col(translation).alias("translation"))))
    past = Window.partitionBy(*scope, "_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    memo = F.first("_entry", ignorenulls=True).over(past)
    fits = (F.length("_key") > 0) & (F.length("_key") <= most)
    out = keyed.withColumn("_memo", F.when(fits, memo))
    return out.select(*items.columns, F.when(F.col("_memo.tagged") == T.without_typography(tagged), F.col("_memo.translation")).alias("served"))


def neighbours(blocks: DataFrame, scope: list[str], order: list[str], target: str, group: list[str] | None = None, text: str = "text", each: int = 300, most: int = 4000) -> DataFrame:
    """group, place (from 1) and text: what stands before and after a group's target blocks, as context for them.

    blocks has scope's columns (a document), order, text and a boolean target; group (default: scope) holds scope's columns
    and tells targets of one request. Neighbours' texts are squeezed and cut to `each` characters, and come once, in order, as
    long as they fit `most` characters together: the first that doesn't ends the list. Those that have nothing to translate
    are left out.
    """
    group = group or scope
    along = Window.partitionBy(*scope).orderBy(*order)
    short = lambda c: F.substring(T.squeezed(c), 1, each)
    beside = blocks.select(*group, *(c for c in order if c not in group), target, F.lag(text).over(along).alias("_0"), F.lead(text).over(along).alias("_1")).where(target)
    found = beside.select(*group, *(c for c in order if c not in group), F.posexplode(F.array(short("_0"), short("_1"))).alias("_side", "text"))
    found = found.where(T.is_translatable("text"))
    first = found.groupBy(*group, "text").agg(F.min(F.struct(*order, "_side")).alias("_at"))
    so_far = Window.partitionBy(*group).orderBy("_at")
    total = F.sum(F.length("text")).over(so_far)
    return first.withColumn("place", F.row_number().over(so_far).cast("long")).withColumn("_total", total).where(F.col("_total") <= most).select(*group, "place", "text")


def joined(texts: Column, places: Column, sign: str) -> Column:
    """Texts of a group in the order of their places, as one."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(places.alias("place"), texts.alias("text")))), lambda x: x["text"]), sign)


def brief_material(texts: DataFrame, excerpts: DataFrame, scope: list[str], order: str, title: str, text: str = "text", most: int = 60, sign: str = "\n") -> DataFrame:
    """scope, titles and excerpts: a document's first `most` titles, and excerpts spread over it (of spread_sample), in order."""
    rank = F.row_number().over(Window.partitionBy(*scope).orderBy(order))
    titles = texts.where(title).withColumn("_n", rank).where(F.col("_n") <= most).groupBy(*scope).agg(joined(F.col(text), F.col(order), sign).alias("titles"))
    spread = excerpts.groupBy(*scope).agg(joined(F.col("excerpt"), F.col(order), sign).alias("excerpts"))
    return spread.join(titles, scope, "left").select(*scope, F.coalesce("titles", F.lit("")).alias("titles"), "excerpts")
