"""The hierarchical Pitman-Yor model: seating against its posterior, probabilities against the formula, mass."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.test_llm_operators import frame
from tramaline.llm import pitman_yor as py
from tramaline.llm.textblock import U64


def crowded(n, d):
    """Of n customers, the weights of 1..n tables: generalised Stirling numbers."""
    w = {1: 1.0}
    for c in range(1, n):
        w = {t: w.get(t, 0) * (c - d * t) + w.get(t - 1, 0) for t in range(1, c + 2)}
    return w


@pytest.mark.parametrize("c", [2, 5, 40])
def test_seating_follows_the_posterior(c):
    # P(t tables) is the Stirling number times the product of the new tables' weights
    d, theta, p, others, n = 0.6, 0.8, 0.4, 3.0, 30_000
    weight = crowded(c, d)
    weight = {t: x * math.prod((theta + d * (others + i)) * p for i in range(t)) for t, x in weight.items()}
    n = 20_000 if c > 10 else n
    full, key = lambda x: np.full(n, x), np.arange(n, dtype=U64)
    seats = py.opening(full(c), full(p), full(others), d, theta, key)
    assert seats.tables.sum() == len(seats.sizes) and seats.sizes.sum() == c * n and seats.sizes.min() > 0
    for sweep in range(150 if c > 10 else 10):
        seats = py.reseat(seats, full(c), full(p), others + seats.tables, d, theta, key, sweep)
        assert seats.sizes.sum() == c * n and seats.sizes.min() > 0 and len(seats.sizes) == seats.tables.sum()
    total = sum(weight.values())
    for t, x in weight.items():
        assert (seats.tables == t).mean() == pytest.approx(x / total, abs=0.012)


@pytest.mark.parametrize(("c", "p", "others"), [(300, 0.4, 5.0), (3000, 0.02, 900.0), (2100, 0.9, 1e7)])
def test_a_sweep_seats_all_customers(c, p, others):
    # all customers at one table: a single sweep gives the posterior, told by the recurrence of numbers of seatings
    d, theta = 0.7, 1.0
    n, most = (300, c) if others > c else (3000, min(c, 400))
    t = np.arange(1, most + 1)
    log_w = np.full(most, -np.inf)
    log_w[0] = 0
    new = np.log((theta + d * (others + np.arange(most))) * p)
    with np.errstate(invalid="ignore", divide="ignore"):
        for k in range(1, c):
            stay = np.where(t <= k, log_w + np.log(np.maximum(k - d * t, 1e-9)), -np.inf)
            log_w = np.logaddexp(stay, np.append(-np.inf, log_w[:-1] + new[1:]))
    w = np.exp(log_w - log_w.max())
    w /= w.sum()
    full, key = lambda x: np.full(n, x), np.arange(n, dtype=U64)
    seats = py.reseat(py.Seats.first(full(c)), full(c), full(p), full(others + 1), d, theta, key, 1)
    assert seats.sizes.sum() == c * n and len(seats.sizes) == seats.tables.sum()
    mean = (w * t).sum()
    sd = math.sqrt((w * (t - mean) ** 2).sum())
    assert seats.tables.mean() == pytest.approx(mean, abs=5 * sd / math.sqrt(n))
    assert seats.tables.std() == pytest.approx(sd, rel=0.15)


@pytest.mark.parametrize("d", [0.05, 0.5, 0.95])
def test_numbers_of_seatings(d):
    # by integral and series as by recurrence, but for a constant
    c, t = 500, np.arange(1, 501)
    off = py.log_seatings(np.full(500, c), t, d) - py._kept_seatings(d)[c, 1 : c + 1]
    assert np.ptp(off) < 2e-5
    one = py.log_seatings(np.array([10**9]), np.array([1]), d)[0]  # closed form of one table, without log c!
    assert one == pytest.approx(-(1 + d) * math.log(10**9) - math.lgamma(1 - d), abs=1e-4)


def test_customers_come_and_go():
    seats = py.Seats(np.array([1, 3, 2, 4]), np.array([5, 1, 4, 2, 3, 1, 1, 1, 1, 1]))
    for c in ([7, 9, 4, 4], [1, 2, 3, 2], [5, 1, 1, 1], [2, 4, 2, 3]):
        new = py._fitted(seats, np.array(c))
        assert len(new.sizes) == new.tables.sum() and new.sizes.min() > 0 and (new.tables > 0).all()
        assert np.add.reduceat(new.sizes, np.cumsum(new.tables) - new.tables).tolist() == c


def test_log_gamma():
    x = np.array([1e-3, 0.2, 1.0, 2.5, 7.9, 30.0, 1e6])
    assert py.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-10, abs=1e-10)


def grouped(rows, f):
    out, by = [], defaultdict(list)
    for row in rows:
        by[row[1]].append(row)
    for to in sorted(by):
        out += f(sorted(by[to], key=lambda r: (r[0], r[2])))
    return out


def test_mass_and_probabilities():
    """The tasks' functions over a small corpus: each sample's probabilities from its seats, by the formula."""
    rng, parts = np.random.default_rng(3), 3
    vocabulary = (rng.integers(1 << 50, 1 << 63, 25, dtype=np.uint64)).tolist()
    texts = [[vocabulary[min(24, int(rng.geometric(0.15)) - 1)] for _ in range(int(rng.integers(0, 30)))] for _ in range(90)]
    held = np.array([i % 5 == 1 for i in range(90)])

    def chunk(number, own):
        h = np.array([x for i in own for x in [*texts[i], 1]], U64)
        doc = np.array([k for k, i in enumerate(own) for _ in range(len(texts[i]) + 1)], np.int32)
        words, at = np.unique(h, return_inverse=True)
        return py.Chunk(number, words, at, doc, np.array(own), np.zeros(len(own), bool), held[own])

    chunks = [chunk(k, list(range(30 * k, 30 * k + 30))) for k in range(3)]
    heavy = np.sort(np.array([vocabulary[0], 2], U64))  # one word and the start are dealt by pair
    cells = [(py.CELL, part, c.number, blob) for c in chunks for part, blob in py._cells(c, heavy, parts)]
    landed = grouped(cells, lambda rows: list(py._merge_cells(rows[0][1], list(rows), heavy, parts)))
    cores = [r for r in landed if r[0] == py.CORE]
    train = Counter(x for i in range(90) if not held[i] for x in [*texts[i], 1])
    words = []
    for q in range(parts):
        own = np.array(sorted(w for w in train if py.home(np.array([w], U64), parts)[0] == q), U64)
        words.append((py.WORDS, q, -1, py.pack(py.steps(own), np.array([train[int(w)] for w in own], np.int64))))
    asks = [(py.ASK, q, c.number, py.pack(py.steps(c.words[own]))) for c in chunks for q, own in py._homes(c.words, parts)]
    model = py.Model(len(train), sum(train.values()), 0.7, 0.4, 1.0)
    seated = defaultdict(lambda: (0, 0))

    def count_heavy(rows):
        seated.clear()
        for r in rows:
            if r[0] == py.WORDS:
                for h, t, c in zip(*(x.tolist() for x in py.unpack(r[3])), strict=True):
                    seated[h] = (seated[h][0] + t, seated[h][1] + c)

    count_heavy([row for r in cores for row in py._heavy_row(py._Core(r[3]), py.Seats.first(py._Core(r[3]).c), r[1])])
    answers, states = [], []
    for number in range(1 + py.BURN_IN + py.SAMPLES):
        if number == 0:
            asked, before = [r for r in landed if r[0] == py.PUT], words
        else:
            rows = cores + [r for r in answers if r[0] == py.ANSWER] + (states[-1][0] if number > 1 else [])
            swept = grouped(rows, lambda r, n=number: list(py._context_sweep(r, model, n, parts)))
            asked, before = [r for r in swept if r[0] == py.PUT], states[-1][1]
            count_heavy(swept)
        answers = grouped([*asked, *before], lambda r, n=number: list(py._word_sweep(r, model, n)))
        sums = np.array([py.unpack(r[3])[0] for r in answers if r[0] == py.CORE]).sum(0)
        model = py.replace(model, sweeps=(*model.sweeps, py.Sweep(float(sums[0]), float(sums[1]), dict(seated))))
        states.append(([r for r in swept if r[0] == py.STATE] if number else [], [r for r in answers if r[0] == py.STATE]))

    # the model's tables, out of the packed states
    pairs = defaultdict(Counter)
    for i in range(90):
        if not held[i]:
            for u, w in zip([2, *texts[i]], [*texts[i], 1], strict=True):
                pairs[u][w] += 1
    short = {w & int(py._SHORT): w for w in [*train, 2]}
    probability = []
    for (in_context, in_parent), sweep in zip(states[-py.SAMPLES :], model.sweeps[-py.SAMPLES :], strict=True):
        again = Counter()
        for _, part, _, blob in in_context:
            core = py._Core(next(r[3] for r in cores if r[1] == part))
            tables = py._seats_of(blob).tables
            for w, t in zip(core.words[core.word].tolist(), tables.tolist(), strict=True):
                again[short[w]] += t
        c0, t0 = {}, {}
        for _, _, _, blob in in_parent:
            h, c, n1, n, tables, _ = (x.astype(np.int64) if k else x for k, x in enumerate(py.unpack(blob)))
            for w, a, b, x in zip(np.cumsum(h, dtype=U64).tolist(), n.tolist(), tables.tolist(), c.tolist(), strict=True):
                c0[w], t0[w] = a, b
                assert x == train[w]
        once = Counter(w for u in pairs for w in pairs[u] if pairs[u][w] == 1)
        assert {w: once[w] + again[w] for w in train} == c0  # customers of the parent are tables of the contexts
        top = (1.0 + model.d0 * sum(t0.values())) / (len(train) + 1) / (1.0 + sum(c0.values()))
        parent = {w: (c0[w] - model.d0 * t0[w]) / (1.0 + sum(c0.values())) + top for w in train}
        assert sum(parent.values()) + top == pytest.approx(1, abs=1e-12)
        assert (sum(c0.values()), sum(t0.values())) == (sweep.parent, sweep.parent_tables)
        probability.append((parent, top))


    from_parts = cores + [r for r in landed if r[0] == py.CELL] + [r for s, _ in states[-py.SAMPLES :] for r in s]
    cell_replies = grouped(from_parts, lambda rows: list(py._answer_cells(rows)))
    word_replies = grouped(asks + [r for _, s in states[-py.SAMPLES :] for r in s], lambda rows: list(py._answer_words(rows)))
    got = {}
    for c in chunks:
        rows = [(py.LOAD, 0, c.number, py._load(c)), *(r for r in [*cell_replies, *word_replies] if r[2] == c.number)]
        got |= {r["doc_id"]: r for r in py._score(rows, model, heavy, parts).to_pylist()}

    # tables of each pair, to hold scores against the formula and to add up each context's mass
    tables = [defaultdict(dict) for _ in range(py.SAMPLES)]
    for s, (in_context, _) in enumerate(states[-py.SAMPLES :]):
        of_part = {part: py._seats_of(blob).tables for _, part, _, blob in in_context}
        for c in chunks:
            ctx, word, to, _ = c.pairs(heavy, parts)
            hashes = np.append(c.words, U64(2))
            for part, lo, hi in py._slices(to):
                core_row = next(r[3] for r in cores if r[1] == part)
                core, cell = py._Core(core_row), py.unpack(next(r[3] for r in landed if r[:3] == (py.CELL, part, c.number)))
                code, number = cell[1], iter(cell[2].tolist())
                for u, w, k in zip(hashes[ctx[lo:hi]].tolist(), hashes[word[lo:hi]].tolist(), code.tolist(), strict=True):
                    if k:
                        i = next(number) if k == 2 else None
                        tables[s][u][w] = 1 if k == 1 else int(of_part[part][i])
                        assert pairs[u][w] == (1 if k == 1 else core.c[i])

    def p(u, w, s):
        parent, top = probability[s]
        c, t = sum(pairs[u].values()), sum(tables[s][u].values())
        own = max(pairs[u][w] - model.d * tables[s][u].get(w, 0), 0)
        return (own + (1.0 + model.d * t) * parent.get(w, top)) / (1.0 + c)

    for s in range(py.SAMPLES):
        for u in pairs:
            assert sum(p(u, w, s) for w in [*train, -1]) == pytest.approx(1, abs=1e-6)
    for i, text in enumerate(texts):
        want = sum(math.log10(sum(p(u, w, s) for s in range(py.SAMPLES)) / py.SAMPLES) for u, w in zip([2, *text], [*text, 1], strict=True))
        assert got[i]["score"] == pytest.approx(want, rel=1e-9)


def test_copies_are_told(spark):
    """A held-out text that training text repeats is far likelier than one that it doesn't; order of words counts."""
    import zlib

    out = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 5 == 1]
    train = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 5 != 1]
    rng = np.random.default_rng(4)
    docs = [(i, " ".join(f"w{k}" for k in rng.integers(0, 400, 60))) for i in train[:150]]
    words = docs[3][1].split()
    docs += [(out[0], " ".join(words)), (out[1], " ".join(np.random.default_rng(1).permutation(words))), (out[2], "never seen before")]
    got = {r.doc_id: r for r in py.score_texts(frame(spark, docs)).collect()}
    assert got[out[0]].score > got[out[1]].score + 3
    assert got[out[0]].base_score == pytest.approx(got[out[1]].base_score)
