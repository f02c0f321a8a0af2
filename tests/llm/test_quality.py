"""Importance resampling against counts of words themselves, in plain Python."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.test_llm_operators import ODD, frame, lower, prose
from tramaline.llm import quality
from tramaline.session import table

TOKEN = re.compile(r"[0-9a-z\x80-\U0010ffff]+|[!-/:-@\[-`{-~]+")
LABELS = "doc_id bigint, quality int, toxic int"


def plain_features(text):
    words = TOKEN.findall(lower(text))
    kept = [w for i, w in enumerate(words) if not i or words[i - 1] != w]
    out = Counter(kept)
    share = (len(words) - len(kept)) / max(len(words), 1)
    out.update(("tenths", k) for k in range(1, 10) if share * 10 >= k)
    return out


def plain_weights(docs, good):
    """Log weight of each row of docs, from the rule alone; good: doc_ids of target text."""
    rows = [(plain_features(t), i in good) for i, t in docs]
    raw, target, raw_docs, target_docs = Counter(), Counter(), Counter(), Counter()
    for f, own in rows:
        raw.update(f)
        raw_docs.update(f.keys())
        if own:
            target.update(f)
            target_docs.update(f.keys())
    up, share = 0, 0.0
    for w in sorted(raw, key=lambda w: target[w] / raw[w]):
        up, share = up + raw[w], target[w] / raw[w]
        if up >= sum(raw.values()) / 2:
            break
    out = []
    for f, own in rows:
        total = 0.0
        for w, c in f.items():
            ratio = math.log((target[w] - c * own + 1) / ((raw[w] - c) * share + 1))
            expected = (raw_docs[w] - 1) * share
            if abs(target_docs[w] - own - expected) > 2 * math.sqrt(expected + 1) and abs(ratio) > math.log(5):
                total += c * ratio
        out.append(total)
    return out


@pytest.fixture(scope="module")
def case():
    good = [(i, prose(400 + i, 80)) for i in range(300)]
    bad = [(1000 + i, prose(800 + i, 30) + " rotten vilest!!! " * 4 + prose(900 + i, 30)) for i in range(90)]
    stuffed = [(2000 + i, "buy " * 50 + prose(1200 + i, 10)) for i in range(40)]
    docs = [*good, *bad, *stuffed, *((5000 + (i or 0), t) if i else (i, t) for i, t in ODD), (6000, prose(7, 9) + " rotten" + " word" * 300_000)]
    labels = [(i, 1, None) for i, _ in good[:220]] + [(i, 1, 1) for i, _ in bad[:60]] + [(i, 0, 0) for i, _ in stuffed[:30]] + [(99999, 0, 0), (None, 1, 0), (5, None, 0)]
    return docs, labels, {i for i, _ in good[:220]}


def test_weights_follow_the_rule(spark, case):
    docs, labels, good = case
    got = quality.classify(frame(spark, docs), spark.createDataFrame(labels, LABELS)).toPandas()
    want = sorted(((-1 if i is None else i), round(w, 6)) for (i, _), w in zip(docs, plain_weights(docs, good), strict=True))
    assert sorted((int(i), round(w, 6)) for i, w in zip(got.doc_id.fillna(-1), got.log_weight, strict=True)) == want
    ids = got.doc_id.fillna(-(1 << 63)).astype(np.int64).to_numpy()
    assert np.allclose(got.gumbel_key, got.log_weight + quality.gumbel(ids, 42))
    # selected are the top k
    assert got.gumbel_key[got.selected].min() > got.gumbel_key[~got.selected].max()
    for lo, hi, share in ((0, 299, 1.0), (1000, 1089, 0.0), (2000, 2039, 0.0)):
        assert abs(got[got.doc_id.between(lo, hi)].selected.mean() - share) <= 0.03


@pytest.mark.parametrize("fraction", [0.0, 0.25, 0.5, 1.0])
def test_gumbel_top_k(spark, case, fraction):
    docs, labels, _ = case
    got = quality.classify(frame(spark, docs), spark.createDataFrame(labels, LABELS), fraction).toPandas()
    k = round(fraction * len(docs))
    keys = sorted(got.gumbel_key, reverse=True)
    assert sorted(got.gumbel_key[got.selected], reverse=True) == (([x for x in keys if x >= keys[k - 1]]) if k else [])


def test_kept_rows_keep_their_columns(spark, case):
    docs, labels, _ = case
    clash = "doc_id bigint, text string, log_weight string, selected string, gumbel_key bigint"
    df = spark.createDataFrame([(i, t, "mine", "too", 7) for i, t in docs], clash)
    labels = spark.createDataFrame(labels, LABELS)
    kept = quality.keep_selected(df, labels)
    assert kept.columns == df.columns and {(r[2], r[3], r[4]) for r in kept.collect()} == {("mine", "too", 7)}
    want = quality.classify(df, labels).where("selected")
    key = lambda r: -1 if r.doc_id is None else r.doc_id
    assert sorted(map(key, kept.select("doc_id").collect())) == sorted(map(key, want.collect()))


def test_empty_tables(spark, case):
    docs, labels, _ = case
    none = spark.createDataFrame([], LABELS)
    assert quality.keep_selected(frame(spark, docs), none).count() == len(docs)
    assert quality.classify(frame(spark, []), spark.createDataFrame(labels, LABELS)).count() == 0
    assert quality.classify(frame(spark, []), none, 0.5).count() == 0


def test_labelled_documents(spark):
    """On the given tables: bad words, shouting, stuffing and marks are found, good documents stay."""
    docs, labels = (table(spark, "/root/testdata/sf0.01", n) for n in ("documents", "labels"))
    got = quality.classify(docs, labels).join(labels, "doc_id").toPandas()
    assert got[(got.quality == 1) & (got.toxic == 0)].selected.mean() >= 0.99
    bad_words = re.compile(r"\b(trash|idiot|clown|scum|worthless|moron|pathetic|loser|disgusting|stupid)\b")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    told = got[(got.quality == 0) | ((got.toxic == 1) & got.doc_id.map(lambda i: bool(bad_words.search(lower(text[i])))))]
    assert 1 - told.selected.mean() >= 0.9
