"""Interaction audit of quality filters by sorted posting lists.

Each filter has, per part of the corpus, the sorted list of documents that fail it, cut into ranges of ids. What a
filter removes after others have run is its list without their union; what it would have removed too is the rest of
its list. Unions and differences come from galloping merges within each range, and the sizes are summed over ranges,
so that all orders of the filters follow from one difference per filter and set of filters before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramaline.session import cut

#: Documents in one range of ids at most: what a task holds as posting lists at a time.
RANGE = 1 << 18
FILTERS = "ABCDE"
MARKS = ("good", "toxic")


def places(ids: np.ndarray, posting: np.ndarray, stride: int = 64) -> np.ndarray:
    """How many entries of a sorted posting list lie below each of some sorted ids, by galloping.

    Every stride-th id is searched in the whole list; from there the ids up to the next one leap ahead by doubling
    steps, and the last leap is halved, so that work follows the distance from one id to the next.
    """
    if not len(ids) or not len(posting):
        return np.zeros(len(ids), np.int64)
    low = np.repeat(np.searchsorted(posting, ids[::stride]), stride)[: len(ids)]
    high, step = low.copy(), 1
    leaping = np.arange(len(ids))
    while len(leaping):  # until the entry at high isn't below the id
        inside = leaping[high[leaping] < len(posting)]
        leaping = inside[posting[high[inside]] < ids[inside]]
        low[leaping] = high[leaping] + 1
        high[leaping] = np.minimum(high[leaping] + step, len(posting))
        step *= 2
    while (halving := np.flatnonzero(low < high)).size:
        mid = (low[halving] + high[halving]) // 2
        below = posting[mid] < ids[halving]
        low[halving[below]] = mid[below] + 1
        high[halving[~below]] = mid[~below]
    return low


def without(ids: np.ndarray, posting: np.ndarray) -> np.ndarray:
    """The sorted ids that aren't in the posting list. A longer list is galloped over, a shorter one gallops itself."""
    keep = np.ones(len(ids), bool)
    if len(posting) < len(ids):
        at = places(posting, ids)
        inside = at < len(ids)
        keep[at[inside][ids[at[inside]] == posting[inside]]] = False
    else:
        at = places(ids, posting)
        inside = at < len(posting)
        keep[inside] = posting[at[inside]] != ids[inside]
    return ids[keep]


def union(lists: list[np.ndarray]) -> np.ndarray:
    """The sorted union of k posting lists: shorter ones are merged into the longest, each by what it adds."""
    out = np.zeros(0, np.int64)
    for ids in sorted(lists, key=len, reverse=True):
        new = without(ids, out)
        out = np.insert(out, places(new, out), new) if len(out) else new
    return out


def _differences(lists: list[np.ndarray], marked: list[np.ndarray]) -> Iterator[tuple[int, int, list[int]]]:
    """(filter, set of filters before it as bits, sizes): what the filter alone still removes, in all and of each mark."""
    n = len(lists)
    for before in range(1 << n):
        gone = union([x for i, x in enumerate(lists) if before >> i & 1])
        for i in (i for i in range(n) if not before >> i & 1):
            left = without(lists[i], gone)
            yield i, before, [len(left), *(len(left) - len(without(left, m)) for m in marked)]


def difference_sizes(flags: DataFrame, filters: list[str], marks: list[str], key: str = "doc_id", part: str = "part", tie: str | None = None, span: int = RANGE) -> DataFrame:
    """part, filter, before, n, n_fail and n_removed, n_<mark>...: one row per part, filter and set of filters before it.

    flags has a row per document with its part, its key and a boolean for each filter (true: fails) and mark; null
    counts as false. filter is the place of a filter in filters, before a bit set of such places; n counts the
    part's documents. Rows are dealt by ranges of (part, key) and go through a task in that order, span at a time:
    a document's number in its range stands for it in the posting lists, so that rows with equal or null keys are
    documents of their own; tie, a column, spreads many rows of one key. Parts of any size are spread over tasks. A null
    part is the empty one; an empty table gives no rows.
    """
    columns = [F.coalesce(F.col(c), F.lit(False)).alias(f"f{i}") for i, c in enumerate([*filters, *marks])]
    rows = flags.select(F.coalesce(F.col(part), F.lit("")).alias("part"), F.col(key).alias("key"), *([F.col(tie).alias("tie")] if tie else []), *columns)
    parts, order = int(flags.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["part", "key", *(["tie"] if tie else [])]
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("key", "tie")
    names = ["n", "n_fail", "n_removed", *(f"n_{m}" for m in marks)]
    schema = pa.schema([("part", pa.string()), ("filter", pa.int32()), ("before", pa.int32()), *((c, pa.int64()) for c in names)])

    def counted(table: pa.Table) -> pa.RecordBatch:
        """The sizes of one range of rows, which may hold the end of one part and others after it."""
        labels = table.column("part").combine_chunks().dictionary_encode()
        codes = np.asarray(labels.indices)
        flags = [np.asarray(c.combine_chunks().cast(pa.uint8())) != 0 for c in table.columns[1:]]
        edges = np.flatnonzero(np.diff(codes, prepend=-1, append=-1))
        found: list[tuple] = []
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            lists = [np.flatnonzero(f[lo:hi]) for f in flags]
            for i, before, left in _differences(lists[: len(filters)], lists[len(filters) :]):
                found.append((labels.dictionary[int(codes[lo])].as_py(), i, before, hi - lo, len(lists[i]), *left))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= span:
                yield counted(pa.Table.from_batches(held))
                held = []
        if any(b.num_rows for b in held):
            yield counted(pa.Table.from_batches(held))

    found = ranged.mapInArrow(run, "part string, filter int, before int, " + ", ".join(f"{c} long" for c in names))
    return found.groupBy("part", "filter", "before").agg(*(F.sum(c).alias(c) for c in names))


def audit(sizes: DataFrame, filters: str, losses: dict[str, str]) -> DataFrame:
    """One row per part, order of the filters and step, from difference_sizes; losses names a column for each mark.

    An order's step removes the difference of its filter's list and the union of those before it, so that all orders
    take their rows from the same sums; nothing here grows with the documents. Columns: part, filter_order, step,
    kept, removed, redundant, unique_fails, one per loss, shapley (removed of the same filter, summed over all orders).
    """
    n, spark = len(filters), sizes.sparkSession
    steps = [("".join(filters[i] for i in p), at + 1, p[at], sum(1 << i for i in p[:at])) for p in permutations(range(n)) for at in range(n)]
    order = spark.createDataFrame(steps, "filter_order string, step int, filter int, before int")
    # in so many of all orders just the filters of a set of size k stand before a given other
    ways = F.array(*(F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)))
    alone = F.max(F.when(F.bit_count("before") == n - 1, F.col("n_removed")))
    over_orders = F.sum(F.col("n_removed") * F.element_at(ways, F.bit_count("before") + 1))
    per_filter = sizes.groupBy("part", "filter").agg(alone.alias("unique_fails"), over_orders.alias("shapley"))
    rows = sizes.join(per_filter, ["part", "filter"]).join(F.broadcast(order), ["filter", "before"])  # n! * n rows
    so_far = F.sum("n_removed").over(Window.partitionBy("part", "filter_order").orderBy("step"))
    return rows.select(
        "part", "filter_order", "step", (F.col("n") - so_far).alias("kept"), F.col("n_removed").alias("removed"),
        (F.col("n_fail") - F.col("n_removed")).alias("redundant"), "unique_fails", *(F.col(f"n_{m}").alias(c) for m, c in losses.items()), "shapley",
    )


def text_failures(text: Column) -> dict[str, Column]:
    """The conditions under which filters A to D fail a text; null counts as empty. Words are parted by white space."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(F.translate(text, "\t\n\x0b\f\r", "     "), " "), lambda w: w != "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 50 * F.size(words).cast("long"),
        "C": 100 * capitals.cast("long") > 3 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def document_flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, part, tie (a hash of the text), A to E, good, toxic: a row per row of docs.

    E: some smaller doc_id has the same text (by SHA-256); of a text's doc_ids the least is taken with a combine
    before the shuffle, and only texts with more than one doc_id are joined back, where Spark splits a frequent one.
    A null doc_id neither fails E nor makes others fail, and has no labels. Null lang is the empty part. Of several
    labels of a document any counts. Columns of docs beyond doc_id, text and lang aren't read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    fails = text_failures(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("same"), F.xxhash64("text").alias("tie"), *(c.alias(k) for k, c in fails.items()))
    rows = cut(rows, "failures")  # texts are read once
    # a table of its own: joined to its own aggregate, a text copied very often would be one task's
    first = rows.groupBy("same").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("same", "first")
    first = cut(first, "copies")
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    rows = rows.join(first, "same", "left").withColumn("E", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))).drop("same", "first")
    return rows.join(marks.where("doc_id is not null"), "doc_id", "left")


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Filters A to E over docs: one row per part (lang), order and step; see audit and document_flags.

    Empty docs give no rows, as there are no parts; empty labels give no losses.
    """
    sizes = difference_sizes(document_flags(docs, labels), list(FILTERS), list(MARKS), tie="tie")
    return audit(sizes, FILTERS, {"good": "good_lost", "toxic": "toxic_lost"})
