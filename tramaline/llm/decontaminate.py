"""Benchmark decontamination by winnowing.

Of every run of `window` words, the least hash among its k-grams is kept; the same run of words keeps the
same hash in a document and in an item, so a join of kept hashes misses no shared run. Each hit is then
extended word by word, and counts only if a whole window agrees.

A benchmark of at most `max_broadcast_bytes` is sent to the tasks and looked up there, in one scan without
a shuffle. A larger one is joined by fingerprint across the cluster; both ways share the same extension.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tramaline.llm.textblock import ALNUM, U64, Block, blocks, grams

WINDOW, GRAM = 10, 5
MAX_BROADCAST_BYTES = 4 << 20


def winnow(g: np.ndarray, begin: np.ndarray, end: np.ndarray, span: int) -> np.ndarray:
    """Places of the least hash (the last of equal ones) in every run of span k-grams within a document.

    g: k-gram hashes by the word they begin at; begin, end: each document's k-grams.
    """
    n = len(g) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = g[:n].copy(), np.zeros(n, np.int8)
    for j in range(1, span):
        less = g[j : j + n] <= best
        best[less] = g[j : j + n][less]
        at[less] = j
    inside = np.zeros(len(g) + 1, np.int32)
    full = end - begin >= span
    np.add.at(inside, begin[full], 1)
    np.add.at(inside, end[full] - span + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside[:n]) > 0)
    chosen = np.zeros(len(g), bool)
    chosen[starts + at[starts]] = True
    return np.flatnonzero(chosen)


def _prints(block: Block, h: np.ndarray, window: int, gram: int, lengths: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words, places, hashes): winnowed k-grams, then all runs of each length of the shorter items."""
    first, last = block.first[:-1], block.first[1:]
    g = grams(h, gram)
    at = winnow(g, np.minimum(first, len(g)), np.clip(last - gram + 1, np.minimum(first, len(g)), len(g)), window - gram + 1)
    yield window, at, g[at]
    for n in lengths:
        g = grams(h, n)
        at = np.arange(len(g))
        at = at[at + n <= last[block.doc[: len(g)]]] if len(g) else at
        yield n, at, g[at] ^ U64(n)


class Items:
    """Fingerprints of benchmark items, sorted by hash, each with the words about it."""

    def __init__(self, ids: list[str], texts: list[bytes], window: int = WINDOW, gram: int = GRAM):
        side = window - gram
        hashes, owners, around, sizes, lengths = [], [], [], [], set()
        for block in blocks(pa.array(texts, pa.large_binary())):
            block.words(ALNUM)
            h = block.word_hashes()
            n = np.diff(block.first)
            lengths |= set(n[(n > 0) & (n < window)].tolist())
            padded = np.concatenate([np.zeros(side, U64), h, np.zeros(window, U64)])
            doc = np.concatenate([np.full(side, -1), block.doc, np.full(window, -1)])
            for size, at, g in _prints(block, h, window, gram, tuple(sorted(lengths))):
                if size < window:  # only items that are no longer than this one window
                    own = n[block.doc[at]] == size
                    at, g = at[own], g[own]
                spot = at[:, None] + np.arange(window + side)
                hashes.append(g)
                owners.append(block.doc[at] + block.lo)
                around.append(np.where(doc[spot] == block.doc[at][:, None], padded[spot], U64(0)))
                sizes.append(np.full(len(at), size))
        join = lambda x, empty: np.concatenate(x) if x else empty
        h = join(hashes, np.zeros(0, U64))
        order = np.argsort(h, kind="stable")
        self.hashes, self.owner = h[order], join(owners, np.zeros(0, np.int64))[order]
        self.around, self.size = join(around, np.zeros((0, window + side), U64))[order], join(sizes, np.zeros(0, np.int64))[order]
        self.ids, self.lengths = ids, tuple(sorted(lengths))


def extend(block: Block, h: np.ndarray, at: np.ndarray, around: np.ndarray, size: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grow each hit (place at in the document, words around in the item) while words agree.

    Gives begin and end of what agrees, and whether it holds a whole window.
    """
    side = window - gram
    short = size < window
    first, last = block.first[block.doc[at]], block.first[block.doc[at] + 1]
    begin, end = at.copy(), np.where(short, at + size, at + gram)
    sure = np.ones(len(at), bool)
    for j in range(window):  # the hit's own words
        need = np.where(short, size, gram) > j
        place = np.minimum(at + j, len(h) - 1)
        sure &= ~need | ((at + j < last) & (h[place] == around[:, side + j]))
    alive = sure & ~short
    for j in range(1, side + 1):
        alive = alive & (at - j >= first) & (h[np.maximum(at - j, 0)] == around[:, side - j])
        begin[alive] -= 1
    alive = sure & ~short
    for j in range(side):
        place = np.minimum(at + gram + j, len(h) - 1)
        alive = alive & (at + gram + j < last) & (h[place] == around[:, side + gram + j])
        end[alive] += 1
    return begin, end, sure & (end - begin >= size)


def _rows(block: Block, doc: np.ndarray, begin: np.ndarray, end: np.ndarray, owner: np.ndarray, ids: list[str]) -> list[list]:
    """The columns in NAMES for the documents of a block, from agreeing runs and their items."""
    step = np.zeros(len(block.start) + 1, np.int32)
    np.add.at(step, begin, 1)
    np.add.at(step, end, -1)
    hit = np.concatenate([[0], np.cumsum(np.cumsum(step[:-1]) > 0)])
    n_words, n_hit = np.diff(block.first), hit[block.first[1:]] - hit[block.first[:-1]]
    found: dict[int, set[str]] = {}
    for d, o in set(zip(doc.tolist(), owner.tolist(), strict=True)):
        found.setdefault(d, set()).add(ids[o])
    names = [sorted(found.get(d, ())) for d in range(block.hi - block.lo)]
    return [n_words.tolist(), n_hit.tolist(), [len(x) for x in names], [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names], (n_hit > 0).tolist()]


NAMES = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())


def _schema(carried: T.StructType, prefix: str) -> T.StructType:
    kinds = (T.LongType(), T.LongType(), T.LongType(), T.StringType(), T.BooleanType())
    return T.StructType([*carried.fields, *(T.StructField(prefix + n, k) for n, k in zip(NAMES, kinds, strict=True))])


def _local(docs: DataFrame, items: Items, window: int, gram: int, prefix: str) -> DataFrame:
    """Every document against items that are sent to the tasks. Adds the columns in NAMES, their names prefixed."""
    sent = docs.sparkSession.sparkContext.broadcast(items)
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = sent.value
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for block in blocks(batch.column(text)):
                block.words(ALNUM)
                h = block.word_hashes()
                begin, end, own, doc = [], [], [], []
                for size, at, g in _prints(block, h, window, gram, it.lengths):
                    lo, hi = np.searchsorted(it.hashes, g), np.searchsorted(it.hashes, g, "right")
                    some = hi > lo
                    at, lo, n = at[some], lo[some], (hi - lo)[some]
                    if not len(at):
                        continue
                    # a k-gram that many items share is spread over all of them
                    at, row = np.repeat(at, n), np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                    fits = it.size[row] == size
                    at, row = at[fits], row[fits]
                    b, e, ok = extend(block, h, at, it.around[row], it.size[row], window, gram)
                    begin.append(b[ok])
                    end.append(e[ok])
                    own.append(it.owner[row[ok]])
                    doc.append(block.doc[at[ok]])
                cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
                for k, v in enumerate(_rows(block, cat(doc), cat(begin), cat(end), cat(own), it.ids)):
                    out[k] += v
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, t) for v, t in zip(out, TYPES, strict=True))], [*batch.schema.names, *(prefix + n for n in NAMES)])

    return docs.mapInArrow(run, _schema(docs.schema, prefix))


def _joined(docs: DataFrame, items: DataFrame, window: int, gram: int, prefix: str) -> DataFrame:
    """The same by a join of fingerprints, for a benchmark of any size. Hits belong to texts, by their SHA-256."""
    lengths = tuple(r[0] for r in items.select(F.size(F.regexp_extract_all("text", F.lit(r"([0-9A-Za-z\x{80}-\x{10FFFF}]+)"))).alias("n")).where(f"n > 0 and n < {window}").distinct().limit(window).collect())

    def item_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            it = Items(batch.column(0).to_pylist(), [x.as_py() or b"" for x in batch.column(1)], window, gram)
            yield pa.RecordBatch.from_arrays([pa.array(it.hashes.view(np.int64)), pa.array([it.ids[o] for o in it.owner], pa.string()), pa.array([x.tobytes() for x in it.around], pa.binary()), pa.array(it.size.astype(np.int32))], ["hash", "item", "around", "size"])

    def doc_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                block.words(ALNUM)
                for size, at, g in _prints(block, block.word_hashes(), window, gram, lengths):
                    doc = block.doc[at]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc + block.lo)), pa.array((at - block.first[doc]).astype(np.int32)), pa.array(g.view(np.int64)), pa.array(np.full(len(at), size, np.int32))], ["key", "at", "hash", "size"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = batch.column(2).to_pylist()
            out: list[list] = [[], [], [], [], []]
            for block in blocks(batch.column(1)):
                block.words(ALNUM)
                h = block.word_hashes()
                rows = [(block.first[d] + x["at"], x["size"], x["item"], x["around"]) for d in range(block.hi - block.lo) for x in hits[block.lo + d] or ()]
                at, size = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
                around = np.frombuffer(b"".join(r[3] for r in rows), U64).reshape(len(rows), -1) if rows else np.zeros((0, 2 * window - gram), U64)
                b, e, ok = extend(block, h, at, around, size, window, gram)
                names = [r[2] for r in rows]
                for k, v in enumerate(_rows(block, block.doc[at[ok]], b[ok], e[ok], np.flatnonzero(ok), names)):
                    out[k] += v
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip(out, TYPES, strict=True))], ["_key", *(prefix + n for n in NAMES)])

    # a text's key also stands for rows that repeat it, so that a passage copied often is searched once
    key = _free(docs.columns, "key")
    text_key = F.sha2(F.coalesce(F.col("text").cast("binary"), F.lit(b"")), 256)
    texts = docs.groupBy(text_key.alias("_key")).agg(F.first(F.col("text").cast("binary")).alias("text"))
    found = items.mapInArrow(item_prints, "hash long, item string, around binary, size int")
    hits = texts.mapInArrow(doc_prints, "key string, at int, hash long, size int").join(found, ["hash", "size"])
    per_text = hits.groupBy(F.col("key").alias("_key")).agg(F.collect_list(F.struct("at", "size", "item", "around")).alias("hits"))
    out = texts.join(per_text, "_key", "left").select("_key", "text", "hits")
    out = out.mapInArrow(verify, _schema(T.StructType([T.StructField("_key", T.StringType())]), prefix))
    return docs.withColumn(key, text_key).join(out.withColumnRenamed("_key", key), key).drop(key)


def _free(columns: list[str], name: str) -> str:
    """A column name, or beginning of names, that no column has."""
    while any(c.lower().startswith(name) for c in columns):
        name += "_"
    return name


def _flagged(docs: DataFrame, benchmark: DataFrame, window: int, gram: int, most: int, prefix: str) -> DataFrame:
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 24), F.lit(0))).first()[0]
    if size > most:
        return _joined(docs, items, window, gram, prefix)
    rows = items.collect()
    return _local(docs, Items([r[0] for r in rows], [bytes(r[1] or b"") for r in rows], window, gram), window, gram, prefix)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word of a document is hit if it lies in an occurrence of `window` consecutive words of an item; an item
    with fewer words counts as one window. items_sha256 names the items found (their ids as text, sorted).
    Null or empty texts have no words; an item without words or with a null id is left out, and items of one
    id count once. Repeated rows stay, and null keys are kept. Other columns are not read. An empty benchmark
    leaves all documents clean.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _flagged(docs, benchmark, window, gram, max_broadcast_bytes, "").drop("text")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """The rows of docs without a hit, with docs' columns; rows with null text or key stay."""
    found = _free(docs.columns, "found")
    return _flagged(docs, benchmark, window, gram, max_broadcast_bytes, found).where(~F.col(found + "contaminated")).select(*docs.columns)
