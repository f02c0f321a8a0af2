"""The pipeline's near copies against brute force: Jaccard of five-word shingles."""

from __future__ import annotations

import numpy as np

import corpus_pipeline
from tests.llm.test_llm_operators import frame
from tramaline.llm.simhash import simhash


def edited(rng, words, n):
    out = list(words)
    for i in rng.choice(len(out), n, replace=False):
        out[i] = f"new{rng.integers(1 << 30)}"
    return " ".join(out)


def brute(docs):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}
    near = [(a, b) for a in sets for b in sets if a < b and (len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8 if sets[a] | sets[b] else True)]
    for _ in sets:
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
    return {i for i in sets if label[i] == i}, near


def test_near_copies_at_08(spark):
    rng = np.random.default_rng(11)
    docs, n = [], 0
    for size in (4, 9, 60, 150, 400, 1200):
        for _ in range(8):
            words = [f"w{x}" for x in rng.integers(0, 5000, size)]
            docs.append((n, " ".join(words)))
            for k in range(5):
                docs.append((n + 1 + k, edited(rng, words, min(size, k * size // 60))))
            n += 10
    # copies of copies, the text they come from missing; a text that links two groups only by itself
    base = [f"v{x}" for x in rng.integers(0, 5000, 200)]
    docs += [(5000 + k, edited(rng, base, 3)) for k in range(40)]
    docs += [(6000 + k, " ".join([*base[: 190 - 8 * k], *(f"c{j}" for j in range(8 * k))])) for k in range(12)]
    docs += [(7000, None), (7001, ""), (7002, "  "), (7003, docs[0][1].upper())]
    kept, near = brute(docs)
    text = dict(docs)
    far = sum((simhash((text[a] or "").encode()) ^ simhash((text[b] or "").encode())).bit_count() > 2 for a, b in near)
    assert far > 50  # most lie outside two bits
    got = corpus_pipeline.drop_near_duplicates(spark, frame(spark, [*docs, (None, docs[0][1]), (None, docs[0][1]), (5000, docs[-5][1])]), "")
    assert got.columns == frame(spark, []).columns
    ids = [r.doc_id for r in got.collect()]
    assert ids.count(None) == 2
    # doc_id 5000 stands for one of its two rows, whichever stayed
    own = {i for i in ids if i is not None}
    assert len(own) == len(ids) - 2
    other = brute([(i, docs[-5][1] if i == 5000 else t) for i, t in docs])[0]
    assert own in (kept, other)
    assert corpus_pipeline.drop_near_duplicates(spark, frame(spark, []), "").count() == 0
