"""Quality classifier by importance resampling of hashed n-gram models.

Two generative models count hashed word n-grams: of target text (documents labelled good) and of raw text (all
documents). A document's log importance weight is the sum, over all its n-grams with their counts, of the log
ratio of the two models. Its own counts are taken out of both models first, so that a text seen in training is
judged as one that was not. A ratio counts where the models differ by more than a factor and by more than chance
in numbers of documents: then the weight of ordinary words doesn't add up with length.

Words and runs of punctuation are tokens. A token that repeats the one before is counted by how many tenths of a
document's tokens do so, as one stuffed text would else outweigh all uses of a word.

Documents are sampled without replacement in proportion to their weights by Gumbel top-k. k is given as a
fraction, or fitted: as many as have a key above the one that parts labelled good from labelled bad best.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramaline.llm.textblock import ALNUM, U64, Block, blocks, grams, mix
from tramaline.session import cut

#: Buckets are 2**BITS; they are summed in slices of 2**SLICE.
BITS, SLICE = 20, 12
#: Longest n-gram of words. Pairs of words only add noise where texts repeat few of them.
ORDER = 1
#: Labelled rows used in fitting, at most. More are sampled by hash of doc_id.
MAX_LABELS = 200_000
#: A ratio counts if it is over FACTOR or under 1 / FACTOR, and SIGMAS standard deviations from chance.
FACTOR, SIGMAS = 5.0, 2.0
#: How much losing a share of the good weighs against catching the same share of the bad.
CARE = 10.0
BINS = 4096
#: Bytes of tokens of runs of punctuation.
MARKS = ~ALNUM
MARKS[:33] = MARKS[65:91] = MARKS[127] = False
_NULL = -(1 << 63)


@dataclass(frozen=True)
class Model:
    """Of each bucket, counts and numbers of documents in raw and target text; and target's share of ordinary words."""

    counts: np.ndarray  # rows: raw counts, target counts, raw documents, target documents
    share: float


def tokens(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every word and run of punctuation, in order."""
    starts, hashes, docs = [], [], []
    for kind in (ALNUM, MARKS):
        block.words(kind)
        starts.append(block.start)
        hashes.append(block.word_hashes())
        docs.append(block.doc)
    order = np.argsort(np.concatenate(starts), kind="stable")
    return np.concatenate(hashes)[order], np.concatenate(docs)[order]


def features(block: Block, order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, bucket and count of every n-gram of up to `order` words, by document and bucket."""
    h, doc = tokens(block)
    n = block.hi - block.lo
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    share = np.bincount(doc, again, n) / np.maximum(np.bincount(doc, minlength=n), 1)
    h, doc = h[~again], doc[~again]
    found = [(doc, h)]
    for k in range(2, order + 1):
        inside = doc[k - 1 :] == doc[: len(doc) - k + 1]
        found.append((doc[k - 1 :][inside], grams(h, k)[inside]))
    for tenth in range(1, 10):
        at = np.flatnonzero(share * 10 >= tenth)
        found.append((at, mix(np.full(len(at), (1 << 40) + tenth, U64))))
    doc, h = (np.concatenate(x) for x in zip(*found, strict=True))
    pair, count = np.unique(doc.astype(np.int64) << BITS | (h >> U64(64 - BITS)).astype(np.int64), return_counts=True)
    return pair >> BITS, pair & ((1 << BITS) - 1), count


def log_ratios(counts: np.ndarray, share: float) -> np.ndarray:
    """Log ratio of target's to raw's model where it counts, else 0. counts has the four rows of a Model."""
    raw, target, raw_docs, target_docs = counts
    ratio = np.log((target + 1) / (raw * share + 1))
    expected = raw_docs * share
    sure = np.abs(target_docs - expected) > SIGMAS * np.sqrt(expected + 1)
    return np.where(sure & (np.abs(ratio) > np.log(FACTOR)), ratio, 0.0)


def log_weights(block: Block, good: np.ndarray, model: Model) -> np.ndarray:
    """Log importance weight of each document of a block; good: whether it is part of target."""
    doc, bucket, count = features(block)
    own = good[doc]
    without = model.counts[:, bucket] - np.stack([count, count * own, np.ones(len(own)), own])
    return np.bincount(doc, count * log_ratios(without, model.share), block.hi - block.lo)


def bounded_labels(labels: DataFrame, most: int = MAX_LABELS) -> tuple[np.ndarray, np.ndarray]:
    """doc_ids, sorted, and whether each is good. A doc_id labelled twice is good only if all its labels are."""
    rows = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    rows = rows.agg((F.min(F.col("quality")) * (1 - F.max(F.coalesce("toxic", F.lit(0))))).cast("int").alias("good"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).toPandas().sort_values("doc_id")
    return rows.doc_id.to_numpy(np.int64), rows.good.to_numpy() > 0


def _labelled(ids: np.ndarray, known: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(known, ids), max(len(known) - 1, 0))
    has = known[at] == ids if len(known) else np.zeros(len(ids), bool)
    return has, has & (good[at] if len(known) else False)


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(_NULL).to_numpy(zero_copy_only=False)


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def fit(docs: DataFrame, labels: tuple[np.ndarray, np.ndarray]) -> Model:
    """Counts over all documents, and over those labelled good.

    A task sends its counts in packed slices, each slice is summed in one task, and the driver gets 2**BITS
    buckets in all, whatever the size of docs.
    """
    sent = docs.sparkSession.sparkContext.broadcast(labels)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, 1 << BITS), np.int64)
        for batch in batches:
            good = _labelled(_ids(batch.column(0)), *sent.value)[1]
            for block in blocks(batch.column(1)):
                doc, bucket, c = features(block)
                own = good[block.lo : block.hi][doc]
                for row, (b, w) in zip(total, ((bucket, c), (bucket[own], c[own]), (bucket, None), (bucket[own], None)), strict=True):
                    row += np.bincount(b, w, 1 << BITS).astype(np.int64)
        slices = total.reshape(4, -1, 1 << SLICE).swapaxes(0, 1)
        some = np.flatnonzero(slices.any(axis=(1, 2)))
        packed = [zstandard.compress(slices[i].tobytes(), 1) for i in some]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(packed, pa.binary())], ["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for batch in batches:
            for i, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if i != at:
                    if at is not None:
                        yield packed_row(at, total)
                    at, total = i, np.zeros((4, 1 << SLICE), np.int64)
                total += np.frombuffer(zstandard.decompress(packed), np.int64).reshape(4, -1)
        if at is not None:
            yield packed_row(at, total)

    def packed_row(at: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slice", "counts"])

    schema = "slice int, counts binary"
    sums = _read(docs).mapInArrow(count, schema).repartition("slice").sortWithinPartitions("slice").mapInArrow(add, schema)
    counts = np.zeros((4, 1 << BITS))
    for i, packed in sums.collect():  # 2**(BITS - SLICE) rows at most
        counts[:, i << SLICE : (i + 1) << SLICE] = np.frombuffer(packed, np.int64).reshape(4, -1)
    return Model(counts, ordinary_share(counts[0], counts[1]))


def ordinary_share(raw: np.ndarray, target: np.ndarray) -> float:
    """The share of target in raw of the middle token, when tokens are in order of their buckets' shares."""
    if not raw.any():
        return 0.0
    share = target / np.maximum(raw, 1)
    order = np.argsort(share, kind="stable")
    up_to = np.cumsum(raw[order])
    return float(share[order][np.searchsorted(up_to, up_to[-1] / 2)])


def gumbel(ids: np.ndarray, seed: int) -> np.ndarray:
    """A standard Gumbel number from a hash of each doc_id and the seed."""
    x = mix(mix(ids.astype(np.int64).view(U64)) ^ U64((seed + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    return -np.log(-np.log(((x >> U64(12)).astype(np.float64) + 0.5) / float(1 << 52)))


def _bin(key: np.ndarray) -> np.ndarray:
    """Keys on a signed square-root scale: fine about 0, and bound."""
    return np.clip(np.sign(key) * np.sqrt(np.abs(key)) * 32, -BINS // 2, BINS // 2 - 1).astype(np.int64)


class Classifier:
    """A fitted model with its labels and seed, sent to all tasks."""

    def __init__(self, docs: DataFrame, labels: DataFrame, seed: int = 42, most: int = MAX_LABELS):
        context = docs.sparkSession.sparkContext
        known = bounded_labels(labels, most)
        self.model, self.seed = fit(docs, known), seed
        self._sent = context.broadcast((self.model, known))

    def weigher(self):
        """A function from arrays of doc_ids and texts to log weights and Gumbel keys, for use in tasks."""
        sent, seed = self._sent, self.seed

        def weigh(ids: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            model, known = sent.value
            good = _labelled(ids, *known)[1]
            w = np.concatenate([np.zeros(0), *(log_weights(b, good[b.lo : b.hi], model) for b in blocks(texts))])
            return w, w + gumbel(ids, seed)

        return weigh

    def fitted_cut(self, docs: DataFrame) -> float:
        """The key above which documents are selected: the one that parts labelled good from labelled bad best.

        Without good or without bad labels, or if nothing tells them apart, every key is above it.
        """
        sent, weigh = self._sent, self.weigher()

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = _ids(batch.column(0))
                has, good = _labelled(ids, *sent.value[1])
                own = np.flatnonzero(has)
                _, key = weigh(ids[own], batch.column(1).take(pa.array(own)))
                yield pa.RecordBatch.from_arrays([pa.array(_bin(key)), pa.array(good[own].astype(np.int64))], ["bin", "good"])

        bins = _read(docs).mapInArrow(score, "bin long, good long").groupBy("bin").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad")).toPandas().sort_values("bin")
        if not len(bins) or not bins.good.sum() or not bins.bad.sum():
            return -np.inf
        gain = (bins.bad.cumsum() / bins.bad.sum() - CARE * bins.good.cumsum() / bins.good.sum()).to_numpy()
        if gain.max() <= 0.05:
            return -np.inf
        # bins up to the last with the best gain are out; the edge lies half way to the next
        at = int(np.flatnonzero(gain >= gain.max() - 1e-12)[-1])
        own = bins.bin.to_numpy()
        edge = (own[at] + 1 + own[min(at + 1, len(own) - 1)]) / 2
        return float(np.sign(edge) * (edge / 32) ** 2)


def kth_key(scored: DataFrame, k: int) -> float:
    """The k-th greatest gumbel_key: intervals of equal width, and of the one it lies in again, until it stands alone.

    Each round counts 2**12 intervals at most, so that the driver's part doesn't grow. scored is a written table.
    """
    lo, hi = scored.agg(F.min("gumbel_key"), F.max("gumbel_key")).first()
    left = k
    while lo < hi:
        width = (hi - lo) / (1 << 12)
        inside = scored.where(F.col("gumbel_key").between(lo, hi)).groupBy(F.floor((F.col("gumbel_key") - lo) / width).alias("i"))
        for _, n, low, high in inside.agg(F.count("*"), F.min("gumbel_key"), F.max("gumbel_key")).orderBy(F.desc("i")).collect():
            if n >= left:
                lo, hi = low, high
                break
            left -= n
    return lo


def classify(docs: DataFrame, labels: DataFrame, fraction: float | None = None, seed: int = 42) -> DataFrame:
    """One row per document: doc_id, log_weight, gumbel_key, selected.

    selected: whether the key is among the top k, with k a fraction of the rows, rounded, or fitted; keys that
    tie with the k-th are all selected. Null text counts as empty and weighs 0; a null doc_id draws noise like
    one key. Unlabelled documents are judged like others; labels of unknown documents, and labels without
    quality, are ignored; a null toxic counts as 0. Repeated rows stay and are selected alike. Other columns are
    not read. Empty tables give empty results.
    """
    classifier = Classifier(docs, labels, seed)
    weigh = classifier.weigher()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, key = weigh(_ids(batch.column(0)), batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(w), pa.array(key)], ["doc_id", "log_weight", "gumbel_key"])

    scored = _read(docs).mapInArrow(run, "doc_id long, log_weight double, gumbel_key double")
    if fraction is None:
        return scored.withColumn("selected", F.col("gumbel_key") > classifier.fitted_cut(docs))
    scored = cut(scored, "scores")  # read once for each count
    k = round(fraction * scored.count())
    return scored.withColumn("selected", F.col("gumbel_key") >= kth_key(scored, k) if k else F.lit(False))


def keep_selected(docs: DataFrame, labels: DataFrame, seed: int = 42) -> DataFrame:
    """The rows of docs whose Gumbel key is among the fitted top k, with docs' columns and no others.

    Rows are judged as by classify; columns of any name pass through as they are.
    """
    classifier = Classifier(docs, labels, seed)
    cut_key, weigh = classifier.fitted_cut(docs), classifier.weigher()
    i, j = docs.columns.index("doc_id"), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, key = weigh(_ids(batch.column(i)), batch.column(j))
            yield batch.filter(pa.array(key > cut_key))

    return docs.mapInArrow(run, docs.schema)
