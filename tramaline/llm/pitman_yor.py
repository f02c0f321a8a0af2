"""LM scoring with a hierarchical Pitman-Yor model.

Each preceding word is a context with a restaurant of its own. All of them share one parent, the restaurant of
words without context, whose own parent is uniform over the known words and one unknown. A table of a context's
restaurant is a customer of the parent, so a word that many contexts know is likely in a new one too.

Seating is sampled by blocked Gibbs. In a sweep, all customers of a word in a restaurant leave and sit down again
together, given all others: the number of their tables is drawn from its posterior, which is the number of seatings
(a generalised Stirling number) times the new tables' weights. Who sits where enters no probability. Words and
restaurants are sampled at the same time, given the others' tables in the sweep before. Each sample's counts and
tables come from one sweep, so that its probabilities add up to 1. Predictive probabilities are averaged over samples.

How it is dealt. Documents are read once, into chunks of numbered tokens. A chunk sends each of its distinct pairs (context, word)
once, packed, to the task of the context; a context with very many pairs is dealt by pair, and its tables are added
up. Words go to tasks by hash. In a sweep the contexts' tasks send tables of words, the words' tasks send back their
seats. Pairs met once have one table for certain, so they need no sampling. At the end both answer the chunks, as
whole numbers in the order in which they were asked. No table of words or pairs is broadcast or collected.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramaline.llm.textblock import INK, U64, Block, blocks, mix
from tramaline.session import cut, discard

#: A context of this share of all tokens or more is dealt by pair; so there are at most 500, and documents' starts.
HEAVY_SHARE = 0.002
CONCENTRATION = 1.0
#: Sweeps before the first sample, samples.
BURN_IN, SAMPLES = 1, 2
#: Customers up to which numbers of seatings are kept in a table; those of more come from an integral. Tokens in one chunk.
KEPT, CHUNK = 2048, 1_000_000
#: Bytes of text in one part of contexts and of words, and in a task that reads documents, at least.
PART, READ = 8 << 20, 8 << 20
END, START = U64(1), U64(2)
#: Bits of a word's hash in pairs: words of one context that agree in them are taken for one.
PAIR_BITS = 40
_SHORT = U64((1 << PAIR_BITS) - 1)
_ROW = "kind int, to int, chunk long, blob binary"
_SCHEMA = pa.schema([("kind", pa.int32()), ("to", pa.int32()), ("chunk", pa.int64()), ("blob", pa.binary())])


# ---- packed arrays ----


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes, byte by byte of all entries, as whole numbers differ in their low bytes most."""
    head, body = [len(arrays)], []
    for a in arrays:
        a = np.ascontiguousarray(a)
        head += [ord(a.dtype.char), len(a)]
        body.append(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes())
    return zstandard.compress(np.array(head, np.int64).tobytes() + b"".join(body), 1)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head, at, out = np.frombuffer(raw, np.int64, 2 * n, 8), 8 + 16 * n, []
    for kind, size in head.reshape(-1, 2).tolist():
        dtype = np.dtype(chr(kind))
        planes = np.frombuffer(raw, np.uint8, size * dtype.itemsize, at).reshape(dtype.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).view(dtype).ravel())
        at += size * dtype.itemsize
    return out


def steps(h: np.ndarray) -> np.ndarray:
    """Differences of sorted hashes, which pack better."""
    return np.diff(h, prepend=h.dtype.type(0))


def small(x: np.ndarray) -> np.ndarray:
    """Whole numbers in as few bytes as they need."""
    top = int(x.max(initial=0))
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else U64)


def release() -> None:
    """Give memory that a task has freed back to the system, as its worker is kept for later ones and others run beside it."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ([] for _ in _SCHEMA)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)


def _batches(rows: Iterator[tuple], most: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[3])
        if size >= most:
            yield _batch(held)
            held, size = [], 0
    yield _batch(held)
    release()


def _groups(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[list[tuple]]:
    """Rows (kind, to, chunk, blob) of each group, from rows sorted by it; only one group's blobs are held."""
    k, at, held = _SCHEMA.names.index(by), None, []
    for batch in batches:
        *small_columns, blobs = batch.columns
        for row in zip(*(c.to_pylist() for c in small_columns), range(len(batch)), strict=True):
            if row[k] != at and held:
                yield held
                held = []
            at = row[k]
            held.append((*row[:3], blobs[row[3]].as_py()))
    if held:
        yield held


def _by(df: DataFrame, column: str, parts: int) -> DataFrame:
    """Rows dealt and sorted by task (to) or chunk: one task, or a chunk of each of its places, to a partition."""
    to = F.col("to") if column == "to" else F.expr(f"cast(pmod(shiftright(chunk, 32) + 7 * (chunk & 4294967295L), {parts}) as int)")
    return df.repartitionById(parts, to).sortWithinPartitions(column, "kind", "chunk")


# ---- tokens ----


def tokens(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the block's tokens, each document's end included, and the document of each."""
    block.words(INK)
    n = block.hi - block.lo
    h, doc = np.empty(len(block.start) + n, U64), np.empty(len(block.start) + n, np.int64)
    at = np.arange(len(block.start)) + block.doc
    end = block.first[1:] + np.arange(n)
    h[at], doc[at] = block.word_hashes(), block.doc
    h[end], doc[end] = END, np.arange(n)
    return h, doc


@dataclass
class Chunk:
    """Some documents' tokens by number of their word, and the distinct pairs among them in the order of asking."""

    number: int
    words: np.ndarray  # distinct hashes, sorted
    at: np.ndarray  # word of each token
    doc: np.ndarray  # document of each token
    ids: np.ndarray  # doc_id of each document
    null: np.ndarray  # whether it is null
    held: np.ndarray  # held out of training

    def pairs(self, heavy: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Context and word (numbers; START is the number after the last word) and part of each pair, by part,
        context and word; and the pair of each token."""
        n = len(self.words) + 1
        ctx = np.full(len(self.at), n - 1)
        inside = self.doc[1:] == self.doc[:-1]
        ctx[1:][inside] = self.at[:-1][inside]
        ctx *= n
        ctx += self.at
        pair, of = np.unique(ctx, return_inverse=True)
        del ctx
        c, w = pair // n, pair % n
        hashes = np.append(self.words, START)
        to = dealt(hashes[c], hashes[w], heavy, parts)
        order = np.argsort(to, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return c[order], w[order], to[order], place[of]


def dealt(context: np.ndarray, word: np.ndarray, heavy: np.ndarray, parts: int) -> np.ndarray:
    """The part of each pair: by its context, or for heavy contexts by both."""
    x = mix(context ^ U64(0xA5A5A5A5A5A5A5A5))
    x = np.where(np.isin(context, heavy), mix(x ^ word), x)
    return (x % U64(parts)).astype(np.int32)


def home(word: np.ndarray, parts: int) -> np.ndarray:
    """The task of each word, told by the bits that pairs keep of it."""
    return (mix((word & _SHORT) ^ U64(0x5A5A5A5A5A5A5A5A)) % U64(parts)).astype(np.int32)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """Chunks of rows (doc_id, text, held_out), of about CHUNK tokens."""
    part, k = TaskContext.get().partitionId() << 32, 0
    parts: list[list[np.ndarray]] = [[], [], [], [], []]
    n = 0

    def emptied() -> Chunk:
        nonlocal n, k
        h, *rest = (np.concatenate(x) for x in parts)
        for x in parts:  # so that a chunk in use isn't held twice
            x.clear()
        words, at = np.unique(h, return_inverse=True)
        n, k = 0, k + 1
        return Chunk(part | (k - 1), words, at.astype(np.int32), *rest)

    for batch in batches:
        ids, out = batch.column(0), batch.column(2).to_numpy(zero_copy_only=False)
        null, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
        for block in blocks(batch.column(1)):
            h, doc = tokens(block)
            own = slice(block.lo, block.hi)
            for x, y in zip(parts, (h, (doc + n).astype(np.int32), ids[own], null[own], out[own]), strict=True):
                x.append(y)
            n += block.hi - block.lo
            if sum(map(len, parts[0])) >= CHUNK:
                yield emptied()
    if n:
        yield emptied()


# ---- seating ----


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of positive numbers, by Stirling's series beyond 8."""
    shift, y = np.zeros_like(x), x.copy()
    for _ in range(8):
        low = y < 8
        if not low.any():
            break
        shift[low] += np.log(y[low])
        y[low] += 1
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y - shift


def _random(key: np.ndarray, *more: int) -> np.ndarray:
    """A uniform number in (0, 1) for each key and some numbers."""
    x = key
    for i in more:
        x = mix(x ^ U64((i + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    return ((x >> U64(11)).astype(np.float64) + 0.5) / float(1 << 53)


@dataclass
class Seats:
    """Tables of words in restaurants: their number for each word, and the customers at each, in a row."""

    tables: np.ndarray
    sizes: np.ndarray

    @classmethod
    def first(cls, c: np.ndarray) -> Seats:
        """All customers of a word at one table."""
        return cls(np.ones(len(c), np.int64), c.astype(np.int64))


@lru_cache(2)
def _kept_seatings(d: float) -> np.ndarray:
    """Logarithm of the number of seatings of c customers (row) at t tables (column), weighted by the discount."""
    out = np.full((KEPT + 1, KEPT + 1), -np.inf)
    out[1, 1] = 0
    for c in range(1, KEPT):
        out[c + 1, 1:] = out[c, :-1]
        stay = out[c, 1 : c + 1] + np.log(c - d * np.arange(1, c + 1))
        out[c + 1, 1 : c + 1] = np.logaddexp(out[c + 1, 1 : c + 1], stay)
    return out


#: Places of the trapezoidal rule, and the steps' weights, where the path is u = width * sinh(v).
_V = np.arange(0, 5, 0.2)
_STEP = np.where(_V == 0, 0.1, 0.2) * np.cosh(_V)
#: Customers that sit with others, at least, where the integral is taken.
_SHARED = 48


def _bisected(lo: np.ndarray, hi: np.ndarray, above, steps: int = 22) -> np.ndarray:
    """Where `above` turns true between lo and hi."""
    for _ in range(steps):
        mid = (lo + hi) / 2
        right = above(mid)
        lo, hi = np.where(right, lo, mid), np.where(right, mid, hi)
    return hi


def _powers(at: np.ndarray, d: float) -> tuple[np.ndarray, ...]:
    """log y, y, 1 - y, y**d and 1 - y**d of at = log(y / (1 - y))."""
    log_y = -np.logaddexp(0, -at)
    return log_y, np.exp(log_y), np.exp(-np.logaddexp(0, at)), np.exp(d * log_y), -np.expm1(d * log_y)


def log_seatings(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """Logarithm of the number of seatings of c customers at t tables, but for what only c decides; c is large.

    It is the coefficient of x**c in (1 - (1 - x)**d)**t / (d**t t!): Cauchy's integral over y = 1 - x along the parabola
    y0 (1 + iu)**2 about the cut, through the saddle point y0; not nearer to 0 than 1/c, where few tables cancel. Near
    as many tables as customers the pole is of low order, and the series is raised to its power instead.
    """
    c, t = c.astype(np.float64), t.astype(np.float64)
    low = c - t < _SHARED
    out = np.empty(len(t))
    if low.any():
        out[low] = _series_power(c[low], t[low], d)
    out[~low] = _integral(c[~low], t[~low], d)
    return out - t * np.log(d) - log_gamma(t + 1.0)


def _series_power(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """Logarithm of the coefficient for t near c: of x**(c - t) in ((1 - (1 - x)**d) / x)**t, whose terms are all positive."""
    g = np.cumprod(np.append(1.0, [(j - d) / (j + 1) for j in range(1, _SHARED)]))
    b = np.zeros((_SHARED, len(t)))  # of x / t, so that none is too large
    b[0] = 1
    for n in range(1, _SHARED):
        for j in range(1, n + 1):
            b[n] += (j * (t + 1) - n) * t**-j * g[j] * b[n - j] / n
    k = c - t
    return t * np.log(d) + np.log(b[k.astype(np.int64), np.arange(len(t))]) + k * np.log(t)


def _log_plus_one(re: np.ndarray, im: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The logarithm of 1 plus complex numbers."""
    return np.log1p(2 * re + re * re + im * im) / 2, np.arctan2(im, 1 + re)


def _integral(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    def past(at: np.ndarray) -> np.ndarray:
        _, _, _, yd, left = _powers(at, d)
        return (c + 1) * np.exp(at) > t * d * yd / left

    log_y, y, rest, yd, left = _powers(_bisected(-np.log(c), 2 * np.log(c) + 5, past), d)
    slope = (c + 1) * y / rest - t * d * yd / left
    bend = (c + 1) * (y / rest) ** 2 + t * d * yd / left * (1 - d - d * yd / left)
    width = 1 / np.sqrt(4 * bend + 2 * slope)
    # of z = 1 + iu: 1 - y0 z**2 and 1 - y0**d z**(2d), as shares of their values at y0
    u = width[:, None] * np.sinh(_V)
    log_size, angle = np.log1p(u * u) / 2, np.arctan(u)
    pole = _log_plus_one((y / rest)[:, None] * u * u, (-2 * y / rest)[:, None] * u)
    size, turn = (yd / left)[:, None] * np.exp(2 * d * log_size), 2 * d * angle
    tables = _log_plus_one((yd / left)[:, None] - size * np.cos(turn), -size * np.sin(turn))
    real = log_size - (c + 1)[:, None] * pole[0]
    turn = angle - (c + 1)[:, None] * pole[1]
    total = (np.exp(real + t[:, None] * tables[0]) * np.cos(turn + t[:, None] * tables[1])) @ _STEP
    # where the path isn't through the saddle point, 1 is left out, whose integral is 0, so that nothing cancels
    few = (slope > 1e-3 * (c + 1) * y / rest) & (t * np.log(left) > -2)
    total[few] -= (np.exp(real[few]) * np.cos(turn[few])) @ _STEP * left[few] ** -t[few]
    total *= width
    return t * np.log(left) - (c + 1) * np.log(rest) + log_y + np.log(np.maximum(total, 1e-300) * 2 / np.pi)


def _tables_of_many(c: np.ndarray, p: np.ndarray, others: np.ndarray, d: float, theta: float, u: np.ndarray) -> np.ndarray:
    """Tables of words of more than KEPT customers each.

    The posterior has one peak, which the saddle point tells; it is summed about the peak as far as it is over e**-36 of
    its top. u: a uniform number for each word.
    """
    base = theta / d + others

    def stretch(at: np.ndarray) -> np.ndarray:
        _, y, rest, yd, left = _powers(at, d)
        return np.clip((c + 1) * y / rest * left / (d * yd), 1, c)

    def past(at: np.ndarray) -> np.ndarray:
        t, left = stretch(at), _powers(at, d)[4]
        return np.log(left) + np.log(p * (base + t) / t) < 0

    top = -4 * np.log(c) / (1 - d)
    peak = np.rint(stretch(_bisected(top, 2 * np.log(c) + 5, past, 60))).astype(np.int64)
    out, todo, reach = np.zeros(len(c), np.int64), np.arange(len(c)), 24 + 9 * np.sqrt(peak).astype(np.int64)
    while len(todo):
        missed = []
        for at in range(0, len(todo), 64):
            own = todo[at : at + 64]
            lo, hi = np.maximum(1, peak[own] - reach[own]), np.minimum(c[own], peak[own] + reach[own])
            n = hi - lo + 1
            of = np.repeat(np.arange(len(own)), n)
            t = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + lo[of]
            i = own[of]
            w = np.concatenate([log_seatings(c[i[k : k + 1024]], t[k : k + 1024], d) for k in range(0, len(t), 1024)])
            w += t * np.log(p[i] * d) + log_gamma(base[i] + t)
            first = np.cumsum(n) - n
            w -= np.maximum.reduceat(w, first)[of]
            short = ((w[first] > -36) & (lo > 1)) | ((w[first + n - 1] > -36) & (hi < c[own]))
            missed.append(own[short])
            for k in np.flatnonzero(~short).tolist():
                up_to = np.cumsum(np.exp(w[first[k] : first[k] + n[k]]))
                out[own[k]] = lo[k] + (up_to[:-1] <= u[own[k]] * up_to[-1]).sum()
        todo = np.concatenate(missed)
        reach[todo] *= 3
    return out


def opening(c: np.ndarray, p: np.ndarray, others: np.ndarray, d: float, theta: float, key: np.ndarray, sweep: int = 0) -> Seats:
    """A seating of each word's c customers given all others, its number of tables drawn; the first table has the most.

    p is the parent's probability of the word, others the tables of other words in its restaurant.
    """
    t, u = np.minimum(c, 1).astype(np.int64), _random(key, 1 << 20, sweep)
    known = _kept_seatings(d)
    width = np.where(c <= 8, c, 1 << np.ceil(np.log2(np.maximum(c, 1))).astype(np.int64))
    width[c > KEPT] = KEPT + 1
    order = np.argsort(width, kind="stable")
    order = order[c[order] > 1]  # one customer has one table
    for w, lo, hi in _slices(width[order]):
        if w > KEPT:
            own = order[lo:hi]
            t[own] = _tables_of_many(c[own], p[own], others[own], d, theta, u[own])
            continue
        for at in range(lo, hi, max(1, (1 << 18) // w)):
            own = order[at : min(hi, at + max(1, (1 << 18) // w))]
            # weights of tables beyond the first
            new = np.log((theta + d * (others[own, None] + np.arange(1, w))) * p[own, None])
            weight = known[c[own], 1 : w + 1]
            weight[:, 1:] += np.cumsum(new, axis=1)
            weight -= weight.max(axis=1, keepdims=True)
            up_to = np.cumsum(np.exp(weight), axis=1)
            t[own] = 1 + (up_to[:, :-1] <= u[own, None] * up_to[:, -1:]).sum(1)
    sizes = np.ones(int(t.sum()), np.int64)
    there = c > 0
    sizes[(np.cumsum(t) - t)[there]] = (c - t + 1)[there]
    return Seats(t, sizes)


def reseat(seats: Seats, c: np.ndarray, p: np.ndarray, restaurant_tables: np.ndarray, d: float, theta: float, key: np.ndarray, sweep: int) -> Seats:
    """One Gibbs sweep: all c customers of each word leave and sit down again together, given all other customers.

    restaurant_tables: all tables of its restaurant in the sweep before.
    """
    others = np.maximum(restaurant_tables - seats.tables, 0).astype(np.float64)
    return opening(c, p, others, d, theta, key, sweep)


# ---- the model's parts ----


@dataclass(frozen=True)
class Sweep:
    """What all tasks know of one sweep: customers and tables of the parent, tables and customers of heavy contexts."""

    parent: float
    parent_tables: float
    heavy: dict[int, tuple[int, int]]


@dataclass(frozen=True)
class Model:
    known: int
    train_tokens: int
    d: float
    d0: float
    theta: float
    sweeps: tuple[Sweep, ...] = ()

    def parent_probability(self, c0: np.ndarray, t0: np.ndarray, sweep: Sweep) -> np.ndarray:
        return (c0 - self.d0 * t0 + (self.theta + self.d0 * sweep.parent_tables) / (self.known + 1)) / (self.theta + sweep.parent)


CORE, CELL, PUT, STATE, ANSWER, ASK, LOAD, WORDS = range(8)


def _cells(chunk: Chunk, heavy: np.ndarray, parts: int) -> Iterator[tuple]:
    """A chunk's pairs for each part: hashes and number of pairs of contexts, words, and counts in training."""
    c, w, to, of = chunk.pairs(heavy, parts)
    count = np.bincount(of, ~chunk.held[chunk.doc], len(c)).astype(np.int64)
    hashes = np.append(chunk.words, START)
    for part, lo, hi in _slices(to):
        own, n = np.unique(c[lo:hi], return_counts=True)
        words, at = np.unique(hashes[w[lo:hi]] & _SHORT, return_inverse=True)
        yield part, pack(steps(hashes[own]), small(n), steps(words), small(at), small(count[lo:hi]))


def _slices(to: np.ndarray) -> Iterator[tuple[int, int, int]]:
    ends = [0, *(np.flatnonzero(np.diff(to)) + 1).tolist(), len(to)]
    return ((int(to[lo]), lo, hi) for lo, hi in zip(ends, ends[1:], strict=False) if hi > lo)


def _merge_cells(part: int, rows: list[tuple], heavy: np.ndarray, parts: int) -> Iterator[tuple]:
    """The cells of a part: its restaurants (core), each chunk's cell as numbers in them, and words for their tasks.

    The core has of each context its customers, pairs met once, and which are heavy; of pairs met again context,
    word and count; and the words of these.
    """
    cells = []
    while rows:  # packed and unpacked cells aren't held together
        _, _, chunk, blob = rows.pop(0)
        cells.append((chunk, unpack(blob)))
    contexts, own = np.unique(np.concatenate([np.cumsum(x[0], dtype=U64) for _, x in cells]), return_inverse=True)
    words, at = np.unique(np.concatenate([np.cumsum(x[2], dtype=U64) for _, x in cells]), return_inverse=True)
    own, at = own.astype(np.int32), at.astype(np.int32)
    key, count, sizes = [], [], []
    c0 = w0 = 0
    for _, (h, n, w, idx, c) in cells:
        key.append(np.repeat(own[c0 : c0 + len(h)].astype(np.int64), n.astype(np.int64)) * len(words) + at[w0 + idx.astype(np.int64)])
        count.append(c.astype(np.int32))
        c0, w0 = c0 + len(h), w0 + len(w)
        sizes.append((len(h), len(idx)))
    chunks_of, cells = [chunk for chunk, _ in cells], None
    key = np.concatenate(key)
    pair, of = np.unique(key, return_inverse=True)
    of, key = of.astype(np.int32), None
    count = np.bincount(of, np.concatenate(count), len(pair)).astype(np.int64)
    ctx, word = pair // len(words), pair % len(words)
    again = count > 1
    number = np.cumsum(again) - 1
    customers = np.bincount(ctx, count, len(contexts)).astype(np.int64)
    once = np.bincount(ctx, count == 1, len(contexts)).astype(np.int64)
    met = np.unique(word[again])
    big = np.flatnonzero(np.isin(contexts, heavy))
    core = (small(customers), small(once), big.astype(np.int64), contexts[big], small(ctx[again]), small(np.searchsorted(met, word[again])), small(count[again]), steps(words[met]))
    yield CORE, part, -1, pack(*core)
    # what words get: pairs met once, and met again
    n1, n2 = (np.bincount(word[x], minlength=len(words)) for x in (count == 1, again))
    seen = np.flatnonzero(n1 + n2)
    to = home(words[seen], parts)
    order = np.argsort(to, kind="stable")
    for q, lo, hi in _slices(to[order]):
        x = seen[order[lo:hi]]
        yield PUT, q, part, pack(steps(words[x]), small(n1[x]), small(n2[x]))
    c0 = p0 = 0
    for chunk, (n_contexts, n_pairs) in zip(chunks_of, sizes, strict=True):
        mine = of[p0 : p0 + n_pairs]
        code = np.minimum(count[mine], 2).astype(np.uint8)
        yield CELL, part, chunk, pack(small(own[c0 : c0 + n_contexts]), code, small(number[mine[code == 2]]))
        c0, p0 = c0 + n_contexts, p0 + n_pairs


class _Core:
    """A part's restaurants."""

    def __init__(self, blob: bytes):
        customers, once, self.big, self.big_hash, ctx, word, c, words = unpack(blob)
        self.customers, self.once, self.ctx, self.word, self.c = (x.astype(np.int64) for x in (customers, once, ctx, word, c))
        self.words = np.cumsum(words, dtype=U64)

    def tables(self, seats: Seats, sweep: Sweep | None) -> tuple[np.ndarray, np.ndarray]:
        """Tables and customers of each context; those of heavy ones are known from all parts."""
        t = self.once + np.bincount(self.ctx, seats.tables, len(self.once)).astype(np.int64)
        c = self.customers.copy()
        for i, h in zip(self.big.tolist(), self.big_hash.tolist(), strict=True):
            if sweep is not None:
                t[i], c[i] = sweep.heavy[h]
        return t, c


def _seats_of(blob: bytes) -> Seats:
    """Seats of pairs, of which only the numbers of tables are kept from sweep to sweep."""
    return Seats(unpack(blob)[0].astype(np.int64), np.zeros(0, np.int64))


def _context_sweep(rows: list[tuple], model: Model, number: int, parts: int) -> Iterator[tuple]:
    """One sweep over a part's restaurants: its new seats, the tables of words, and those of heavy contexts."""
    kinds: dict[int, list[tuple]] = {}
    for row in rows:
        kinds.setdefault(row[0], []).append(row)
    part = rows[0][1]
    core = _Core(kinds[CORE][0][3])
    seats = _seats_of(kinds[STATE][0][3]) if STATE in kinds else Seats.first(core.c)
    before = model.sweeps[-1]
    p = np.zeros(len(core.words))
    homes = home(core.words, parts)
    for _, _, q, blob in kinds.get(ANSWER, ()):
        c0, t0 = unpack(blob)
        p[homes == q] = model.parent_probability(c0.astype(np.float64), t0.astype(np.float64), before)
    t, _ = core.tables(seats, before)
    key = mix(mix(np.arange(len(core.c), dtype=U64)) ^ U64(part + 1))
    seats = reseat(seats, core.c, p[core.word], t[core.ctx], model.d, model.theta, key, number)
    yield STATE, part, number, pack(small(seats.tables))
    given = np.bincount(core.word, seats.tables, len(core.words)).astype(np.int64)
    order = np.argsort(homes, kind="stable")
    for q, lo, hi in _slices(homes[order]):
        x = order[lo:hi]
        yield PUT, q, part, pack(steps(core.words[x]), small(given[x]))
    yield from _heavy_row(core, seats, part)


def _heavy_row(core: _Core, seats: Seats, part: int) -> Iterator[tuple]:
    t, c = core.tables(seats, None)
    if len(core.big):
        yield WORDS, part, -1, pack(core.big_hash, t[core.big], c[core.big])


def _word_sweep(rows: list[tuple], model: Model, number: int) -> Iterator[tuple]:
    """One sweep over a task's words: their seats in the parent, answers to the parts that asked, and sums.

    A state has of each word its hash, training count, pairs met once, customers in the parent, and seats.
    """
    q = rows[0][1]
    state, puts = None, []
    for kind, _, part, blob in rows:
        if kind == WORDS:
            h, c = unpack(blob)
            order = np.argsort(np.cumsum(h, dtype=U64) & _SHORT, kind="stable")
            h = np.cumsum(h, dtype=U64)[order]
            state = [h, c[order].astype(np.int64), np.zeros(len(h), np.int64), np.zeros(len(h), np.int64), Seats.first(np.zeros(len(h)))]
        elif kind == STATE:
            h, c, n1, c0, tables, sizes = unpack(blob)
            state = [np.cumsum(h, dtype=U64), *(x.astype(np.int64) for x in (c, n1, c0)), Seats(tables.astype(np.int64), sizes.astype(np.int64))]
        else:
            puts.append((part, unpack(blob)))
    if state is None:
        return
    h, c, n1, c0, seats = state
    short = h & _SHORT
    c0 = np.zeros(len(h), np.int64) if number == 0 else n1.copy()
    asked = []
    for part, (words, *values) in puts:
        at = np.searchsorted(short, np.cumsum(words, dtype=U64))
        if number == 0:
            n1[at] += values[0].astype(np.int64)
            c0[at] += values[0].astype(np.int64) + values[1].astype(np.int64)
            at = at[values[1] > 0]
        else:
            c0[at] += values[0].astype(np.int64)
        asked.append((part, at))
    # words that agree in the bits of pairs have their customers with the first of them
    there = np.flatnonzero(c0 > 0)
    own = c0[there]
    if number < 2:
        new = Seats.first(own)
    else:
        last = model.sweeps[-1]
        new = _fitted(Seats(seats.tables[there], seats.sizes), own)
        uniform = np.full(len(own), 1 / (model.known + 1))
        new = reseat(new, own, uniform, np.full(len(own), last.parent_tables), model.d0, model.theta, mix(h[there]), number)
    seats = Seats(np.zeros(len(h), np.int64), new.sizes)
    seats.tables[there] = new.tables
    yield STATE, q, number, pack(steps_of_short_order(h), small(c), small(n1), small(c0), small(seats.tables), small(seats.sizes))
    for part, at in asked:
        if len(at):
            yield ANSWER, part, q, pack(small(c0[at]), small(seats.tables[at]))
    contexts = c0 if number == 0 else np.zeros(0)
    yield CORE, q, -1, pack(np.array([c0.sum(), seats.tables.sum(), (contexts == 1).sum(), (contexts == 2).sum()], np.int64))


def steps_of_short_order(h: np.ndarray) -> np.ndarray:
    """Differences of hashes in the order of their short bits; they wrap round, and adding them up wraps back."""
    return np.diff(h, prepend=U64(0))


def _fitted(seats: Seats, c: np.ndarray) -> Seats:
    """Seats for the customers that words have now: those that came or left did so at the greatest tables."""
    word = np.repeat(np.arange(len(c)), seats.tables)
    order = np.lexsort((-seats.sizes, word))
    sizes = seats.sizes[order]
    first = np.cumsum(seats.tables) - seats.tables
    more = c - np.add.reduceat(sizes, first) if len(c) else c
    sizes[first] += np.maximum(more, 0)
    # who left goes in order of tables, each of which keeps one while others have more
    spare = np.cumsum(sizes - 1) - np.repeat((np.cumsum(sizes - 1) - (sizes - 1))[first], seats.tables)
    left = np.repeat(np.maximum(-more, 0), seats.tables)
    gone = np.minimum(spare, left) - np.minimum(spare - (sizes - 1), left)
    sizes -= gone
    # where fewer are left than tables, the last tables close
    rank = np.arange(len(word)) - np.repeat(first, seats.tables)
    stay = rank < np.repeat(c, seats.tables)
    return Seats(np.bincount(word[stay], minlength=len(c)).astype(np.int64), sizes[stay])


# ---- scores ----


def _answer_cells(rows: list[tuple]) -> Iterator[tuple]:
    """To each chunk, of its pairs in a part: code 0 (not met), 1 (once) or 2, count and tables of those met again,
    and customers and tables of their contexts; tables of each sample."""
    core = next(_Core(blob) for kind, _, _, blob in rows if kind == CORE)
    samples = [_seats_of(blob) for kind, _, _, blob in rows if kind == STATE]
    sums = [core.tables(s, None)[0] for s in samples]
    for kind, part, chunk, blob in rows:
        if kind == CELL:
            own, code, number = (x.astype(np.int64) for x in unpack(blob))
            big = np.full(len(core.once), -1)
            big[core.big] = np.arange(len(core.big))
            which = big[own]
            at = np.flatnonzero(which >= 0)
            yield ANSWER, part, chunk, pack(code.astype(np.uint8), small(core.c[number]), *(small(s.tables[number]) for s in samples), small(core.customers[own]), *(small(t[own]) for t in sums), small(at), core.big_hash[which[at]])


def _answer_words(rows: list[tuple]) -> Iterator[tuple]:
    """To each chunk, of its words in a task: training count, and customers and tables in the parent of each sample."""
    samples = []
    for kind, _, _, blob in rows:
        if kind == STATE:
            h, c, _, c0, tables, _ = unpack(blob)
            samples.append((np.cumsum(h, dtype=U64), c.astype(np.int64), c0.astype(np.int64), tables.astype(np.int64)))
    order = np.argsort(samples[0][0], kind="stable") if samples else np.zeros(0, np.int64)
    for kind, q, chunk, blob in rows:
        if kind == ASK:
            asked = np.cumsum(unpack(blob)[0], dtype=U64)
            if not samples or not len(order):
                yield ASK, q, chunk, pack(*[np.zeros(len(asked), np.uint8)] * (1 + 2 * SAMPLES))
                continue
            h = samples[0][0][order]
            at = np.minimum(np.searchsorted(h, asked), len(h) - 1)
            there, at = h[at] == asked, order[at]
            yield ASK, q, chunk, pack(*(small(np.where(there, x[at], 0)) for x in (samples[0][1], *(y for s in samples for y in s[2:]))))


def _load(chunk: Chunk) -> bytes:
    """A chunk's documents and tokens. Small numbers for frequent words, which pack well."""
    by_count = np.argsort(-np.bincount(chunk.at, minlength=len(chunk.words)), kind="stable")
    number = np.empty(len(by_count), np.int64)
    number[by_count] = np.arange(len(by_count))
    n = np.bincount(chunk.doc, minlength=len(chunk.ids))
    return pack(chunk.ids.astype(np.int64), chunk.null.astype(np.uint8), chunk.held.astype(np.uint8), small(n), small(number[chunk.at]), small(by_count), steps(chunk.words))


def _loaded(number: int, blob: bytes) -> Chunk:
    ids, null, held, n, at, by_count, words = unpack(blob)
    doc = np.repeat(np.arange(len(ids), dtype=np.int32), n.astype(np.int64))
    return Chunk(number, np.cumsum(words, dtype=U64), by_count.astype(np.int64)[at], doc, ids, null > 0, held > 0)


def _score(rows: list[tuple], model: Model, heavy: np.ndarray, parts: int) -> pa.RecordBatch:
    """A chunk's documents, from what parts and words answered."""
    chunk = next(_loaded(n, blob) for kind, _, n, blob in rows if kind == LOAD)
    ctx, word, to, of = chunk.pairs(heavy, parts)
    cells, words = ({row[1]: row[3] for row in rows if row[0] == k} for k in (ANSWER, ASK))
    count = np.zeros(len(chunk.words), np.int64)
    parent = np.zeros((SAMPLES, len(chunk.words)))
    for q, own in _homes(chunk.words, parts):
        c, *rest = unpack(words[q])
        count[own] = c
        for s, sweep in enumerate(model.sweeps[-SAMPLES:]):
            parent[s, own] = model.parent_probability(rest[2 * s].astype(np.float64), rest[2 * s + 1].astype(np.float64), sweep)
    probability = np.zeros(len(ctx))
    for part, lo, hi in _slices(to):
        code, again, *rest = (x.astype(np.float64) if x.dtype.itemsize < 8 else x for x in unpack(cells[part]))
        tables_again, customers, tables, at, hashes = rest[:SAMPLES], rest[SAMPLES].astype(np.float64), rest[SAMPLES + 1 : -2], rest[-2].astype(np.int64), rest[-1]
        _, of_ctx = np.unique(ctx[lo:hi], return_inverse=True)
        c = code.copy()
        c[code == 2] = again
        for s, sweep in enumerate(model.sweeps[-SAMPLES:]):
            t, total, seated = code.copy(), customers.copy(), tables[s].astype(np.float64)
            t[code == 2] = tables_again[s]
            for i, h in zip(at.tolist(), hashes.tolist(), strict=True):
                seated[i], total[i] = sweep.heavy[h]
            total, seated = total[of_ctx], seated[of_ctx]
            probability[lo:hi] += (np.maximum(c - model.d * t, 0) + (model.theta + model.d * seated) * parent[s, word[lo:hi]]) / (model.theta + total) / SAMPLES
    total = lambda x: np.bincount(chunk.doc, x, len(chunk.ids))
    n, own = total(None), count[chunk.at]
    score = total(np.log10(probability[of]))
    base = total(np.log10((own + 0.5) / (model.train_tokens + 0.5 * (model.known + 1))))
    kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
    cols = (chunk.ids, chunk.held, n, total(own > 0), np.full(len(n), model.train_tokens), base, score, 10 ** (-score / n))
    arrays = [pa.array(x, k, mask=chunk.null if i == 0 else None) for i, (x, k) in enumerate(zip(cols, kinds, strict=True))]
    return pa.RecordBatch.from_arrays([arrays[0], *(a.cast(k) for a, k in zip(arrays[1:], kinds[1:], strict=True))], [x.split()[0] for x in _OUT.split(", ")])


_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def _homes(words: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    to = home(words, parts)
    order = np.argsort(to, kind="stable")
    return ((q, order[lo:hi]) for q, lo, hi in _slices(to[order]))


def _discount(once: int, twice: int) -> float:
    """From the numbers of customers met once and twice."""
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


def _mapped(df: DataFrame, by: str, parts: int, f) -> DataFrame:
    """f over the rows of each group, which meet in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(row for rows in _groups(batches, by) for row in f(rows))

    return _by(df, by, parts).mapInArrow(run, _ROW)


def _collected(df: DataFrame, kind: int) -> list[list[np.ndarray]]:
    """Sums: one small row of each part."""
    return [unpack(r.blob) for r in df.where(f"kind = {kind}").select("blob").collect()]


def score_texts(docs: DataFrame, theta: float = CONCENTRATION, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Learns from documents whose crc32(doc_id as text) mod 5 isn't 1. Tokens are lower-cased words that white
    space separates, then one end. score is the log10 probability of the text under the model; base_score that
    of counts plus a half; perplexity is 10 ** (-score / n_tokens). A null or empty text is an end alone; a null
    doc_id counts as the empty string. Repeated rows stay. Other columns are not read. Without training
    documents all words are unknown. theta is the concentration; discounts follow from numbers of pairs and words
    met once and twice.
    """
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # from the text, as a chunk has a row for each part: many parts of little text would be all rows and no pairs
    parts = max(1, -(-n_bytes // PART))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), held.alias("held_out"))
    source = source.coalesce(max(1, -(-n_bytes // READ)))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches((LOAD, chunk.number % parts, chunk.number, _load(chunk)) for chunk in chunks(batches))

    # texts are read once; all that follows reads the chunks, which are the same each time
    loads = cut(source.mapInArrow(load, _ROW), "loads")

    def loaded(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
        return (_loaded(n.as_py(), blob.as_py()) for batch in batches for n, blob in zip(batch.column(2), batch.column(3), strict=True))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for chunk in loaded(batches):
                n = np.bincount(chunk.at, ~chunk.held[chunk.doc], len(chunk.words)).astype(np.int64)
                for q, own in _homes(chunk.words, parts):
                    own = own[n[own] > 0]
                    yield WORDS, q, chunk.number, pack(steps(chunk.words[own]), small(n[own]))

        yield from _batches(rows())

    def add(rows: list[tuple]) -> Iterator[tuple]:
        h, n = zip(*(unpack(row[3]) for row in rows), strict=True)
        h, at = np.unique(np.concatenate([np.cumsum(x, dtype=U64) for x in h]), return_inverse=True)
        n = np.bincount(at, np.concatenate(n), len(h)).astype(np.int64)
        yield WORDS, rows[0][1], -1, pack(steps(h), small(n))
        yield CORE, rows[0][1], -1, pack(np.array([len(h), n.sum()], np.int64))

    words = cut(_mapped(loads.mapInArrow(count, _ROW), "to", parts, add), "words")
    sums = np.array([x[0] for x in _collected(words, CORE)]).reshape(-1, 2).sum(0)
    known, n_train = int(sums[0]), int(sums[1])
    words = words.where(f"kind = {WORDS}")

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(3).to_pylist():
                h, n = unpack(blob)
                h = np.cumsum(h, dtype=U64)
                yield pa.RecordBatch.from_arrays([pa.array(h[(n >= max(1, heavy_share * n_train)) & (h != END)].view(np.int64))], ["h"])

    found = words.mapInArrow(frequent, "h long").collect()  # at most 1 / heavy_share
    heavy = np.sort(np.append(np.array([r.h for r in found], np.int64).view(U64), START))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for chunk in loaded(batches):
                for part, blob in _cells(chunk, heavy, parts):
                    yield CELL, part, chunk.number, blob
                for q, own in _homes(chunk.words, parts):
                    yield ASK, q, chunk.number, pack(steps(chunk.words[own]))

        yield from _batches(rows())

    def land(rows: list[tuple]) -> Iterator[tuple]:
        yield from (row for row in rows if row[0] != CELL)
        rows[:] = [row for row in rows if row[0] == CELL]
        if rows:
            yield from _merge_cells(rows[0][1], rows, heavy, parts)

    landed = cut(_mapped(loads.mapInArrow(send, _ROW), "to", parts, land), "landed")
    of = lambda df, *kinds: df.where(F.col("kind").isin(*kinds))

    def first(rows: list[tuple]) -> Iterator[tuple]:
        """Each word at one table: counts of counts, and what heavy contexts have in each part."""
        core = _Core(rows[0][3])
        yield CORE, rows[0][1], -1, pack(np.array([core.once.sum(), (core.c == 2).sum()], np.int64))
        yield from _heavy_row(core, Seats.first(core.c), rows[0][1])

    opening = cut(_mapped(of(landed, CORE), "to", parts, first), "opening")
    once, twice = np.array([x[0] for x in _collected(opening, CORE)]).reshape(-1, 2).sum(0).tolist()
    model = Model(known, n_train, _discount(once, twice), 0.5, theta)

    def heavies(df: DataFrame) -> dict[int, tuple[int, int]]:
        """Tables and customers of heavy contexts in all parts."""
        out: dict[int, tuple[int, int]] = {}
        for r in df.where(f"kind = {WORDS}").select("blob").toLocalIterator():
            for h, t, c in zip(*(x.tolist() for x in unpack(r.blob)), strict=True):
                a, b = out.get(h, (0, 0))
                out[h] = (a + t, b + c)
        return out

    seated, answers = heavies(opening), None
    states: list[tuple[DataFrame, DataFrame]] = []
    for number in range(1 + BURN_IN + SAMPLES):
        fixed = model
        if number == 0:
            asked, before = of(landed, PUT), words
        else:
            rows = of(landed, CORE).union(of(answers, ANSWER))
            rows = rows.union(states[-1][0]) if number > 1 else rows
            swept = cut(_mapped(rows, "to", parts, lambda r, m=fixed, n=number: _context_sweep(r, m, n, parts)), "contexts")
            asked, before, seated = of(swept, PUT), of(states[-1][1], STATE), heavies(swept)
        answers = cut(_mapped(asked.union(before), "to", parts, lambda r, m=fixed, n=number: _word_sweep(r, m, n)), "parents")
        sums = np.array([x[0] for x in _collected(answers, CORE)]).reshape(-1, 4).sum(0)
        if number == 0:
            model = replace(model, d0=_discount(int(sums[2]), int(sums[3])))
        model = replace(model, sweeps=(*model.sweeps, Sweep(float(sums[0]), float(sums[1]), seated)))
        states.append((of(swept, STATE) if number else None, of(answers, STATE)))
        if 2 <= number <= BURN_IN + 2:  # of burn-in, and the next sweep has read it
            for old in states[number - 2]:
                discard(old)
    samples = states[-SAMPLES:]
    from_parts, from_words = of(landed, CORE, CELL), of(landed, ASK)
    for in_context, in_parent in samples:
        from_parts, from_words = from_parts.union(in_context), from_words.union(in_parent)
    replies = [cut(_mapped(df, "to", parts, f), "replies") for df, f in ((from_parts, _answer_cells), (from_words, _answer_words))]
    for old in (landed, words, *(x for pair in samples for x in pair)):
        discard(old)
    final = model

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, "chunk"):
            yield _score(rows, final, heavy, parts)
        release()

    met = loads.union(replies[0]).union(replies[1])
    return _by(met, "chunk", parts).mapInArrow(score, _OUT)
