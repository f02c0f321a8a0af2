"""Suffix-array dedup with a common-prefix interval tree.

A full suffix array of a corpus is far larger than the corpus. Here windows of `length` bytes are dealt by
their minimizer, the least hash of a 32-gram inside: equal windows have equal minimizers, wherever they stand.
Consecutive windows with one minimizer form a run, a string a little longer than a window. Of runs with equal
bytes the first stands for all; the others are repeats as a whole. Minimizers met in one run only are done.

The strings left go by minimizer to tasks, each of which builds an enhanced suffix array of its strings (order,
common prefixes, left neighbours), scans it with a stack for the intervals of the common-prefix tree, and tests
left extensions: an interval whose suffixes are all preceded by one byte is part of a longer repeat, the others
are maximal repeats, with all their occurrences. Every occurrence but the first is removed.

A minimizer with very many different runs is not kept in one task: its windows are dealt one by one, by hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramaline.llm.textblock import _BYTE, U64, Block, binary, blocks, mix, powers
from tramaline.session import cut

LENGTH, GRAM = 100, 32
#: Different runs of one minimizer that go to one task at most.
HOT = 4_000
#: Bytes of strings in one suffix array.
BATCH = 1 << 20


def _sums(data: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * powers(len(data) + 1)[0][: len(data)], out=total[1:])
    return total


def _hash(total: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each stretch of bytes, from prefix sums."""
    return mix(((total[end] - total[begin]) * powers(len(total))[1][begin]) ^ (end - begin).astype(U64))


def minimizer_runs(block: Block, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one minimizer: minimizer, hash, document, start, windows, and whether it recurs inside."""
    b, w = block.raw, length - GRAM + 1
    none = np.zeros(0, np.int64)
    if len(b) < length:
        return none.view(U64), none.view(U64), none, none, none, none.astype(bool)
    v = b.astype(U64)
    for k in (1, 2, 4):
        v = v[:-k] | (v[k:] << U64(8 * k))
    n = len(b) - GRAM + 1
    g = v[:n] * U64(0x9E3779B97F4A7C15)
    for k, c in ((8, 0xC2B2AE3D27D4EB4F), (16, 0x165667B19E3779F9), (24, 0xD6E8FEB86659FD93)):
        g += v[k : k + n] * U64(c)
    g = mix(g)
    low, span = g, 1
    while 2 * span <= w:
        low, span = np.minimum(low[:-span], low[span:]), 2 * span
    if span < w:
        low = np.minimum(low[: len(low) - (w - span)], low[w - span :])
    windows = np.diff(block.offsets) - length + 1
    docs = np.flatnonzero(windows > 0)
    if not len(docs):
        return none.view(U64), none.view(U64), none, none, none, none.astype(bool)
    first = np.zeros(len(low) + 1, bool)
    first[1:-1] = low[1:] != low[:-1]
    valid = np.zeros(len(low) + 1, np.int8)
    np.add.at(valid, block.offsets[docs], 1)
    np.add.at(valid, block.offsets[docs] + windows[docs], -1)
    valid = np.cumsum(valid) > 0
    first[block.offsets[docs]] = True
    start = np.flatnonzero(first & valid)
    doc = np.searchsorted(block.offsets, start, "right") - 1
    stop = np.minimum(np.append(start[1:], len(low)), block.offsets[doc] + windows[doc])
    pieces = (stop - start + w - 1) // w
    at = np.repeat(start, pieces)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    stop, doc, start = np.repeat(stop, pieces), np.repeat(doc, pieces), at + nth * w
    count = np.minimum(stop - start, w)
    m = low[start]
    left, right = start.copy(), start.copy()
    last = start + count - 1
    for j in range(w):
        i = w - 1 - j
        same = g[start + i] == m
        left[same] = start[same] + i
        same = g[last + j] == m
        right[same] = last[same] + j
    total = _sums(b)
    return m, _hash(total, start, start + count + length - 1), doc, start - block.offsets[doc], count, left != right


def repeated_here(m: np.ndarray, h: np.ndarray, key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of runs met in one batch: whether an earlier one there has the same bytes.

    Such a run is a repeat as a whole whatever else there is, so it need not meet the others of its minimizer: a
    passage that many documents share sends one run per batch to its minimizer's task.
    """
    order = np.lexsort((at, key, h, m))
    out = np.zeros(len(m), bool)
    out[order[1:]] = (m[order][1:] == m[order][:-1]) & (h[order][1:] == h[order][:-1])
    return out


def repeats_of(strings: list[bytes], key: np.ndarray, start: np.ndarray, length: int) -> tuple[list[tuple[int, int, list[int]]], np.ndarray, np.ndarray]:
    """Maximal repeats among strings: (length, first occurrence, other occurrences not in a longer one) of each.

    Occurrences are numbers into the two arrays that follow: their key and position. Earlier means a smaller
    (key, position). Strings come from documents (key) at start.
    """
    data = np.frombuffer(b"".join(strings), np.uint8)
    sizes = np.array([len(s) for s in strings])
    ends = np.cumsum(sizes)
    n_windows = sizes - length + 1
    string = np.repeat(np.arange(len(strings)), n_windows)
    pos = np.arange(len(string)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows) + (ends - sizes)[string]
    # a suffix whose first `length` bytes stand nowhere else is in no interval
    h = _hash(_sums(data), pos, pos + length)
    order = np.argsort(h, kind="stable")
    again = np.zeros(len(h), bool)
    same = h[order][1:] == h[order][:-1]
    again[order[1:][same]] = again[order[:-1][same]] = True
    pos, string = pos[again], string[again]
    where, home = start[string] + pos - (ends - sizes)[string], key[string]
    if not len(pos):
        return [], home, where
    room = ends[string] - pos
    width = int(room.max())
    view = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(width, np.uint8)]), width)
    found: list[tuple[int, int, list[int]]] = []
    suffixes = view[pos]
    suffixes[np.arange(width) >= room[:, None]] = 0
    order = np.argsort(suffixes.view(f"S{width}").ravel(), kind="stable")
    suffixes = suffixes[order]
    differs = suffixes[1:] != suffixes[:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
    common = np.minimum(common, np.minimum(room[order][1:], room[order][:-1]))
    rank = np.empty(len(pos), np.int64)
    rank[np.lexsort((where, home))] = np.arange(len(pos))
    before = np.where(pos > (ends - sizes)[string], data[pos - 1].astype(np.int64), -1)
    _scan(common.tolist(), order.tolist(), rank.tolist(), before.tolist(), length, found)
    return found, home, where


def _scan(common: list[int], order: list[int], rank: list[int], before: list[int], length: int, found: list) -> None:
    """Stack scan of the common prefixes. A node: [prefix, first occurrence, left byte or -1 if they differ, open].

    open are occurrences without a maximal repeat so far. A left byte of -1 at the head of a string counts as
    different from all: there the repeat can't be followed further to the left.
    """
    stack: list[list] = []

    def join(a: list, b: list) -> None:
        a[3] += b[3]
        if rank[b[1]] < rank[a[1]]:
            a[1] = b[1]
        if a[2] != b[2]:
            a[2] = -1

    def close(node: list) -> list:
        if node[2] == -1:
            rest = [i for i in node[3] if i != node[1]]
            if rest:
                found.append((node[0], node[1], rest))
            node[3] = [node[1]]
        return node

    leaf = [0, order[0], before[order[0]], [order[0]]]
    for c, i in zip([*common, 0], [*order[1:], -1], strict=True):
        child = leaf
        while stack and stack[-1][0] > c:
            join(stack[-1], child)
            child = close(stack.pop())
        if c >= length:
            if stack and stack[-1][0] == c:
                join(stack[-1], child)
            else:
                stack.append([c, child[1], child[2], child[3]])
        if i >= 0:
            leaf = [0, i, before[i], [i]]


def merged(key: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of each key, those that touch joined."""
    if not len(key):
        return key, begin, end
    order = np.lexsort((begin, key))
    key, begin, end = key[order], begin[order], end[order]
    block = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])) << 40
    reach = np.maximum.accumulate(block + end)
    new = np.concatenate([[True], (block + begin)[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    return key[at], begin[at], (reach - block)[np.append(at[1:], len(key)) - 1]


def _suffix_arrays(length: int):
    """Strings sorted by bucket, to the stretches to remove; a bucket's strings are in one suffix array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings: list[bytes] = []
        keys: list[int] = []
        starts: list[int] = []
        size, at = 0, None
        for batch in batches:
            for bucket, key, start, string in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if bucket != at and size >= BATCH:
                    yield removed(strings, keys, starts)
                    strings, keys, starts, size = [], [], [], 0
                at = bucket
                strings.append(string)
                keys.append(key)
                starts.append(start)
                size += len(string)
        if strings:
            yield removed(strings, keys, starts)

    def removed(strings: list[bytes], keys: list[int], starts: list[int]) -> pa.RecordBatch:
        found, home, where = repeats_of(strings, np.array(keys), np.array(starts), length)
        own = np.array([i for _, _, rest in found for i in rest], np.int64)
        reach = np.array([n for n, _, rest in found for _ in rest], np.int64)
        cols = merged(home[own], where[own], where[own] + reach)
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["key", "begin", "end"])

    return run


def keyed_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """key (a number in the order of documents) and text; and, unless key is doc_id, what each key stands for.

    Rows alike in doc_id and text are one document. Those that share a doc_id go by a hash of their text, and
    those without a doc_id come last.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    rows, known, different = base.agg(F.count("*"), F.count("doc_id"), F.countDistinct("doc_id")).first()
    if rows == known == different:
        # never null here; said so, lest a filter on it makes one use of the shuffled texts differ from the others
        return base.select(F.coalesce("doc_id", F.lit(0).cast("long")).alias("key"), "text"), None
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = base.withColumn("k", F.xxhash64("doc_id", "text"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("k")]
    ids = base.groupBy("doc_id", "k").agg(F.count("*").alias("n_rows")).repartitionByRange(parts, *order)
    ids = cut(ids.withColumn("part", F.spark_partition_id()), "order")
    sizes, total, before = {r[0]: r[1] for r in ids.groupBy("part").count().collect()}, 0, []  # one row per partition
    for p in sorted(sizes):
        before += [F.lit(p), F.lit(total).cast("long")]
        total += sizes[p]
    offset = F.create_map(*before)[F.col("part")] if before else F.lit(0)
    ids = cut(ids.withColumn("key", offset + F.row_number().over(Window.partitionBy("part").orderBy(*order))), "keys")
    texts = base.groupBy("k").agg(F.first("text").alias("text"))
    texts = ids.select("k", "key").join(texts, "k").select(F.coalesce("key", F.lit(0).cast("long")).alias("key"), "text")
    return texts, ids.select("key", "doc_id", "n_rows")


def _hot_stretches(runs: DataFrame, length: int) -> DataFrame:
    """Stretches (key, begin, end) of windows that are met before, of the runs of hot minimizers.

    Such windows are known by 128-bit hashes, and made and shuffled once. Of those alike in a batch only the first
    meets the others: the rest are repeats whatever else there is and go by document, so that a window of very many
    documents is a row for each batch.
    """

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = binary(batch.column(1))
            lists, bounds = batch.column(2), batch.column(2).offsets.to_numpy()
            ats = lists.flatten().field(1).to_numpy(zero_copy_only=False)
            bounds = bounds - bounds[0]
            hashes: list[bytes] = []
            owners: list[int] = []
            starts: list[int] = []
            for r, key in enumerate(batch.column(0).to_pylist()):
                text = data[off[r] : off[r + 1]].tobytes()
                for at in ats[bounds[r] : bounds[r + 1]].tolist():
                    x, n = at >> 9, (at >> 1) & 255
                    hashes += [hashlib.blake2b(text[i : i + length], digest_size=16).digest() for i in range(x, x + n)]
                    owners += [key] * n
                    starts += range(x, x + n)
                if len(hashes) > 1 << 16:
                    yield told(hashes, owners, starts)
                    hashes, owners, starts = [], [], []
            yield told(hashes, owners, starts)

    def told(hashes: list[bytes], owners: list[int], starts: list[int]) -> pa.RecordBatch:
        """Windows with whether an earlier one in the batch is alike; those go by their key instead of their hash."""
        h = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
        key, start = np.array(owners, np.int64), np.array(starts, np.int64)
        again = repeated_here(h[:, 0], h[:, 1], key, start)
        a, b = np.where(again, key, h[:, 0]), np.where(again, 0, h[:, 1])
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (a, b, key, start, again)], ["a", "b", "key", "start", "again"])

    met = runs.mapInArrow(windows, "a long, b long, key long, start long, again boolean")
    alike = Window.partitionBy("a", "b").orderBy("again", "key", "start")
    later = met.withColumn("nth", F.row_number().over(alike)).where("again or nth > 1")
    return later.select("key", F.col("start").alias("begin"), (F.col("start") + length).alias("end"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte is removed if a string of `length` bytes over it also starts earlier, in a document with a smaller
    doc_id or before in the same. Strings are those of the input's UTF-8 bytes; null counts as empty. n_spans
    counts maximal removed stretches; kept_sha256 is of what stays. Rows alike in doc_id and text are one
    document and come out as often as they came in. Other columns are not read. Documents shorter than `length`
    keep all bytes.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    read, named = keyed_documents(docs)
    texts = read.repartition(parts, "key")  # the one shuffle of the texts; it is used up to three times, in the last job
    if named is None:
        # runs are made where the texts are read, unless that leaves cores idle (one large row group, say)
        spread = len(read.select(F.spark_partition_id().alias("part")).distinct().collect())  # one row per partition
        read = read if spread >= spark.sparkContext.defaultParallelism else texts

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found = batch.column(0).to_numpy(), []
            for block in blocks(batch.column(1)):
                m, h, doc, start, count, inner = minimizer_runs(block, length)
                found.append((m, h, keys[block.lo + doc], (start << 9) | (count << 1) | inner))
            if found:
                m, h, key, at = (np.concatenate(x) for x in zip(*found, strict=True))
                again = repeated_here(m, h, key, at)
                m, h = np.where(again, mix(h ^ mix(key.view(U64) ^ at.view(U64))), m), np.where(again, U64(0), h)
                yield pa.RecordBatch.from_arrays([pa.array(m.view(np.int64)), pa.array(h.view(np.int64)), pa.array(key), pa.array(at), pa.array(again)], ["m", "h", "key", "at", "again"])

    met = Window.partitionBy("m").orderBy("h", "key", "at")
    seen = read.mapInArrow(runs, "m long, h long, key long, at long, again boolean")
    seen = seen.withColumn("first", ~F.col("again") & F.coalesce(F.lag("h").over(met) != F.col("h"), F.lit(True)))
    seen = seen.withColumn("different", F.sum(F.col("first").cast("int")).over(Window.partitionBy("m")))
    wanted = F.col("first") & ((F.col("different") > 1) | (F.col("at").bitwiseAND(F.lit(1)) == 1))
    seen = seen.where(~F.col("first") | wanted)
    per_doc = seen.groupBy("key").agg(F.collect_list(F.struct("m", "at", "first", (F.col("different") > hot).alias("hot"))).alias("runs"))
    per_doc = cut(per_doc, "runs")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Strings for the suffix arrays (bucket, key, start, string), and whole runs to remove (no string)."""
        for batch in batches:
            data, off = binary(batch.column(1))
            keys, lists = batch.column(0).to_numpy(), batch.column(2)
            bounds, flat = lists.offsets.to_numpy(), lists.flatten()
            bounds = bounds - bounds[0]
            ms, ats, firsts, hots = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            out: tuple[list, list, list, list] = ([], [], [], [])
            size = 0
            for r, key in enumerate(keys.tolist()):
                at, first = ats[bounds[r] : bounds[r + 1]], firsts[bounds[r] : bounds[r + 1]]
                begin, count = at >> 9, (at >> 1) & 255
                whole = ~first
                _, b, e = merged(np.zeros(whole.sum(), np.int64), begin[whole], (begin + count + length - 1)[whole])
                for x, y in zip(b.tolist(), e.tolist(), strict=True):
                    _add(out, None, key, x, y.to_bytes(8, "little"))
                text = data[off[r] : off[r + 1]].tobytes()
                for m, x, n, is_hot in zip(ms[bounds[r] : bounds[r + 1]][first].tolist(), begin[first].tolist(), count[first].tolist(), hots[bounds[r] : bounds[r + 1]][first].tolist(), strict=True):
                    if not is_hot:
                        _add(out, m, key, x, text[x : x + n + length - 1])
                        size += n + length
                if size > 1 << 22:
                    yield _strings(out)
                    out, size = ([], [], [], []), 0
            yield _strings(out)

    def _add(out: tuple[list, list, list, list], *row) -> None:
        for column, value in zip(out, row, strict=True):
            column.append(value)

    def _strings(out: tuple[list, list, list, list]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["bucket", "key", "start", "string"])

    found = texts.join(per_doc, "key").select("key", "text", "runs").mapInArrow(cut_out, "bucket long, key long, start long, string binary")
    # whole runs pass through, dealt by document; a bucket has the different runs of one minimizer, `hot` at most
    bucketed = found.repartition(parts, F.coalesce("bucket", F.xxhash64("key"))).sortWithinPartitions(F.col("bucket").isNull(), "bucket")

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def strings() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                whole = batch.column(0).is_null()
                n = len(batch) - batch.column(0).null_count  # those with a bucket come first
                if n:
                    yield batch.slice(0, n)
                if n < len(batch):
                    rest = batch.slice(n)
                    assert whole.slice(n).false_count == 0
                    ends = np.array([int.from_bytes(x.as_py(), "little") for x in rest.column(3)], np.int64)
                    passed.append(pa.RecordBatch.from_arrays([rest.column(1), rest.column(2), pa.array(ends)], ["key", "begin", "end"]))

        passed: list[pa.RecordBatch] = []
        for out in _suffix_arrays(length)(strings()):
            yield out
            yield from passed
            passed.clear()
        yield from passed

    spans = bucketed.mapInArrow(stretches, "key long, begin long, end long")
    hot_docs = per_doc.withColumn("runs", F.filter("runs", lambda r: r["hot"] & r["first"])).where("size(runs) > 0")
    if not hot_docs.isEmpty():
        spans = spans.union(_hot_stretches(texts.join(hot_docs, "key").select("key", "text", "runs"), length))
    spans = spans.groupBy("key").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = binary(batch.column(1))
            data = data.tobytes()
            rows = []
            for i, spans in enumerate(batch.column(2)):
                text, done, removed, n, digest = memoryview(data)[off[i] : off[i + 1]], 0, 0, 0, hashlib.sha256()
                pairs = np.array([(s["begin"], s["end"]) for s in spans.as_py() or ()], np.int64).reshape(-1, 2)
                _, begin, end = merged(np.zeros(len(pairs), np.int64), pairs[:, 0], pairs[:, 1])
                for a, b in zip(begin.tolist(), end.tolist(), strict=True):
                    digest.update(text[done:a])
                    done, removed, n = b, removed + b - a, n + 1
                digest.update(text[done:])
                rows.append((len(text), removed, n, digest.hexdigest()))
            cols = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    out = texts.join(spans, "key", "left").select("key", "text", "spans").mapInArrow(keep, "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    if named is None:
        return out.withColumnRenamed("key", "doc_id")
    rows = named.join(out, "key").withColumn("n_rows", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows"))))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
