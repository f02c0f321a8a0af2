"""The numbered operators against brute force, and in odd cases: nulls, empties, ties, repeats, no rows, more columns."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tramaline.llm import decontaminate, license_scan, mixing, pitman_yor, preferences, secret_scan, simhash, suffix_repeats, weighted_sampling
from tramaline.llm.textblock import ALNUM, blocks

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, m bigint, fp string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def frame(spark, rows, schema=SCHEMA):
    """Rows of (doc_id, text), with columns whose names clash with those inside the operators."""
    n = schema.count(",") + 1
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 2}", len(t or ""), "k", 7, "x")[:n] for i, t in rows], schema)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def prose(seed, words):
    r = np.random.default_rng(seed)
    return " ".join(r.choice(["alpha", "beta", "gamma", "delta", "élan", "zeta", "eta", "theta", "iota", "kappa"], words))


LONG = prose(1, 90)
ODD = [(1, None), (2, ""), (3, "   "), (4, LONG), (5, LONG), (5, LONG), (6, LONG[:200] + " new words " + LONG[200:]), (7, "Ab" * 400), (None, LONG), (None, "short"), (8, "日本語 テキスト " * 30), (9, "x")]
ODD_KEYED = [r for r in ODD if r[0] is not None]


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# ---- 1 ----


def removed_brute(docs, n):
    order = sorted(range(len(docs)), key=lambda i: docs[i][0])
    seen, out = set(), {}
    for i in order:
        b = (docs[i][1] or "").encode()
        mark = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if b[p : p + n] in seen:
                mark[p : p + n] = b"\1" * n
            seen.add(b[p : p + n])
        spans = sum(1 for k in range(len(b)) if mark[k] and (k == 0 or not mark[k - 1]))
        out[docs[i][0]] = (len(b), sum(mark), spans, hashlib.sha256(bytes(x for x, m in zip(b, mark, strict=True) if not m)).hexdigest())
    return out


@pytest.mark.parametrize("hot", [20_000, 1])
def test_repeats(spark, hot):
    texts = [prose(s, 60) for s in range(4)]
    docs = [(10 * i + 1, t) for i, t in enumerate([*texts, texts[0] + " tail", "head " + texts[1][50:300] + texts[2][10:200], "Ab" * 300, texts[3], "é" * 120, "日" * 90, "x" * 99, None, ""])]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_repeats.remove_repeats(frame(spark, docs), hot=hot).collect()}
    assert got == removed_brute(docs, 100)


def test_repeats_odd(spark):
    got = rows_of(suffix_repeats.remove_repeats(frame(spark, ODD)).select("doc_id", "n_bytes", "n_removed"))
    assert len(got) == len(ODD)
    assert [x[2] for x in got if x[0] == 5] == [len(LONG.encode())] * 2  # both rows of a repeated document
    assert sorted(x[2] for x in got if x[0] is None) == [0, len(LONG.encode())]  # without a doc_id: last
    assert suffix_repeats.remove_repeats(frame(spark, [])).count() == 0


def test_maximal_repeats():
    a, b = prose(3, 30).encode(), prose(4, 30).encode()
    shared = prose(5, 25).encode()[:120]
    found, home, where = suffix_repeats.repeats_of([a + b"<" + shared + b">" + b, b"..(" + shared + b")"], np.array([1, 2]), np.array([0, 0]), 100)
    assert [(n, [(home[i], where[i]) for i in (first, *rest)]) for n, first, rest in found] == [(120, [(1, len(a) + 1), (2, 3)])]


# ---- 2 ----


def test_licenses(spark):
    docs = [(1, "All rights reserved. cc by CC-BY"), (2, "Relased under the MIT Licence!"), (3, "general public license"), (4, None), (5, ""), (6, "small rights reserved"), (7, "xall rights reserved all"), (8, "é all rights reserved"), (8, "é all rights reserved")]
    got = {r.doc_id: r for r in license_scan.scan_licenses(frame(spark, docs)).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels, got[1].score) == (3, 0, 5, "cc-by,reserved", 1.0)
    assert got[2].n_base == 0 and got[2].labels == "mit" and 0.8 < got[2].score < 1
    assert got[3].base_labels == "gpl"
    for k in (4, 5):
        assert tuple(got[k])[1:] == (0, 0, None, None, "", "", 0.0, "")
    assert got[7].n_base == 0 and got[8].spans.startswith("reserved:2:21:0")
    assert license_scan.scan_licenses(frame(spark, [])).count() == 0
    assert license_scan.scan_licenses(frame(spark, docs)).count() == len(docs)


def test_seeds_lose_no_match():
    import regex

    notices = tuple(license_scan.NOTICES)
    r = np.random.default_rng(5)
    for _ in range(60):
        k = int(r.integers(len(notices)))
        t = list(notices[k])
        for _ in range(len(t) // license_scan.CHARS_PER_EDIT):
            i = int(r.integers(len(t)))
            t[i : i + int(r.integers(2))] = [chr(97 + int(r.integers(26)))] * int(r.integers(2))
        text = f"{prose(6, 20)} {''.join(t)} {prose(7, 20)}".encode()
        block = next(iter(blocks(pa.array([text], pa.binary()))))
        edits = len(notices[k]) // license_scan.CHARS_PER_EDIT
        want = regex.search(rb"(?:" + regex.escape(notices[k].encode()) + b"){e<=" + str(edits).encode() + b"}", text.lower())
        found = {x[3] for x in license_scan.fuzzy_spans(block, notices, license_scan.CHARS_PER_EDIT)}
        assert want is None or k in found


# ---- 3 ----


def test_preferences(spark):
    turns = [(2, 0, "user", "hi"), (2, 1, "assistant", "yes"), (3, 0, "user", "hi"), (3, 1, "assistant", "no"), (4, 0, None, None), (6, 0, "user", "q"), (6, 0, "user", "q")]
    convs = preferences.conversations(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string"))
    got = {r.pair_id: r for r in preferences.format_preferences(preferences.paired_with_neighbour(convs)).collect()}
    r = got[2]
    assert (r.n_prefix, r.prompt) == (1, "<|user|>\nhi<|end|>\n")
    assert (r.chosen, r.rejected) == ("<|assistant|>\nyes<|end|>\n", "<|assistant|>\nno<|end|>\n")
    a, b = map(int, r.chosen_mask.split(":"))
    assert r.chosen[a:b] == "yes<|end|>\n"
    assert got[4].n_prefix == 0 and got[4].rejected == "" and got[4].chosen_mask == ""
    same = spark.createDataFrame([(1, [("user", "a")], [("user", "a")]), (2, None, None)], "pair_id bigint, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")
    got = {r.pair_id: r for r in preferences.format_preferences(same).collect()}
    assert got[1].n_prefix == 1 and got[1].chosen == got[1].rejected == "" and got[2].n_prefix == 0
    assert preferences.conversations(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


# ---- 4 ----


def contaminated_brute(text, items):
    w = WORD.findall(lower(text))
    hit, found = set(), set()
    for item, t in items:
        v = WORD.findall(lower(t))
        n = min(10, len(v))
        if item is None or not n:
            continue
        windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)}
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_decontamination(spark, most):
    item = prose(11, 30)
    items = [(1, item), (2, "Élan VITAL"), (3, None), (4, ""), (None, item), (10, prose(12, 10)), (1, item)]
    w = item.split()
    docs = [*ODD, (20, "x " + " ".join(w[3:14]) + ", y"), (21, " ".join(w[:9])), (22, prose(12, 10).upper()), (23, "élan; vital élan"), (24, " ".join(w[5:16]) + " z " + " ".join(w[0:11])), (25, item + item)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted(map(str, rows_of(decontaminate.decontaminate(frame(spark, docs), bench, max_broadcast_bytes=most))))
    assert got == sorted(str((i, *contaminated_brute(t, items))) for i, t in docs)
    kept = decontaminate.drop_contaminated(frame(spark, docs), bench, max_broadcast_bytes=most)
    assert kept.columns == frame(spark, docs).columns
    assert kept.count() == sum(not contaminated_brute(t, items)[-1] for _, t in docs)
    assert decontaminate.decontaminate(frame(spark, []), bench, max_broadcast_bytes=most).count() == 0
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert {r.n_hit for r in decontaminate.decontaminate(frame(spark, docs), none).collect()} == {0}


# ---- 5 ----


def test_language_model(spark):
    docs = [(i, prose(100 + i, 40 + i)) for i in range(60)] + [(70, None), (71, ""), (72, "Unseen WORDS"), (3, prose(103, 43))]
    got = pitman_yor.score_texts(frame(spark, docs)).toPandas()
    assert len(got) == len(docs)
    c, tok = Counter(), lambda t: [*(t or "").encode().lower().split(), None]
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    for i, t in docs:
        if not out(i):
            c.update(tok(t))
    n, v = sum(c.values()), len(c)
    text = dict(docs)
    for r in got.itertuples():
        t = tok(text[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out(r.doc_id), len(t), sum(x in c for x in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t))
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum() * 1.05  # the model predicts no worse than counts, within noise
    again = pitman_yor.score_texts(frame(spark, docs).repartition(3)).toPandas()
    assert again.sort_values(["doc_id"]).score.to_numpy() == pytest.approx(got.sort_values(["doc_id"]).score.to_numpy(), rel=1e-6)
    assert pitman_yor.score_texts(frame(spark, [])).count() == 0
    only_held = [(i, "a b") for i in range(40) if out(i)]
    assert (pitman_yor.score_texts(frame(spark, only_held)).toPandas().n_known == 0).all()


# ---- 6 ----


def test_fingerprints(spark):
    texts = [prose(200 + i, 120) for i in range(30)]
    docs = [*enumerate(texts), (40, None), (41, ""), (42, "one"), (42, "one"), (43, texts[0]), (None, texts[1])]
    got = weighted_sampling.edited_fingerprints(frame(spark, docs)).collect()
    assert len(got) == len(docs)
    order = sorted({(i, t or "") for i, t in docs}, key=lambda x: -math.inf if x[0] is None else x[0], reverse=True)
    errors, prints = [], {}
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        q = len(t) // 3
        edited = t[: len(t) - q] + after[:q]
        r = next(r for r in got if r.doc_id == i and r.n_chars == len(t))
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = Counter(t.split()), Counter(edited.split())
        errors.append(r.near_edited - (sum((a & b).values()) / sum((a | b).values()) if a | b else 1))
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint  # equal texts
    assert abs(np.mean(errors)) < 0.06 and np.std(errors) < 0.12
    assert weighted_sampling.edited_fingerprints(frame(spark, [])).count() == 0
    assert weighted_sampling.edited_fingerprints(frame(spark, [(1, "a b")])).first().near_next == 1.0


# ---- 7 ----


def test_simhash(spark):
    base = [prose(300 + i, 60) for i in range(25)]
    docs = [*enumerate(base), *((100 + i, t + " tail") for i, t in enumerate(base)), (200, None), (201, ""), (202, base[0]), (202, base[0]), (203, "zz" * 500), (None, base[1]), (None, "alone here now")]
    got = rows_of(simhash.near_duplicates(frame(spark, docs)).withColumn("hex", simhash.hex_fingerprint()).select("doc_id", "hex", "component_id"))

    def brute(t):
        w = lower(t).encode().split()
        g = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in g]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fp = {(i, t): brute(t) for i, t in docs}
    root = {v: min((i for (i, _), x in fp.items() if x == v and i is not None), default=None) for v in fp.values()}
    label = {v: r for v, r in root.items() if r is not None}
    for _ in range(len(label)):
        for a in label:
            for b in label:
                if (a ^ b).bit_count() <= 2 and label[b] < label[a]:
                    label[a] = label[b]
    want = [(i, f"{fp[i, t]:016x}", label.get(fp[i, t])) for i, t in docs]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    kept = simhash.keep_one(frame(spark, docs))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(label.values()))
    assert kept.columns == frame(spark, docs).columns


def test_gray_index():
    r = np.random.default_rng(0)
    x = np.concatenate([r.integers(0, 1 << 63, 500, dtype=np.uint64), (r.integers(0, 1 << 63, 1, dtype=np.uint64) ^ (np.uint64(1) << r.integers(0, 63, 300).astype(np.uint64)))])
    pairs = {(int(a), int(b)) for who, item in simhash.GrayIndex(x, x).search(x, 2) for a, b in zip(who, item, strict=True)}
    assert pairs == {(a, b) for a in range(len(x)) for b in range(len(x)) if int(x[a] ^ x[b]).bit_count() <= 2}


# ---- 8 ----


def test_secrets(spark):
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.abcdefghijkl"
    docs = [
        (1, "é PassWord = 'abcdef' token:tok token=ab token:abcdefg"), (2, "AKIA" + "A" * 16 + " AKIA" + "B" * 15), (3, "0" * 24 + "g" + "f" * 23), (4, None), (5, ""), (6, "api-key: no, apikey:yes123 API_KEY=\"zzzzzz\""),
        (7, f"-----BEGIN RSA PRIVATE KEY----- {jwt} https://me:pw@host/ ghp_" + "a" * 36), (8, "toke n secre"), (8, "toke n secre"), (9, "ſecret=abcdef toKen=abcdef"),
    ]
    got = {r.doc_id: r for r in secret_scan.find_secrets(frame(spark, docs)).collect()}
    rules = [(re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 2, 6, "assign"), (re.compile("AKIA[A-Z0-9]+"), 0, 20, "access"), (re.compile("[0-9a-f]+"), 0, 24, "hex")]
    for i, t in docs:
        spans = sorted((m.start(), k, m.end()) for k, (x, g, n, _) in enumerate(rules) for m in x.finditer(t or "") if len(m.group(g)) >= n)
        said = ",".join(f"{rules[k][3]}:{a}:{b}" for a, k, b in spans)
        assert (got[i].base_sha256, got[i].n_assign, got[i].n_access, got[i].n_hex) == (hashlib.sha256(said.encode()).hexdigest(), *(sum(s[1] == k for s in spans) for k in range(3)))
    assert {x.split(":")[0] for x in got[7].spans.split(",")} >= {"private_key", "jwt", "url_login", "github"}
    clean = {r.doc_id: r for r in secret_scan.redact_secrets(frame(spark, docs)).collect()}
    assert clean[1].text == "é [ASSIGN]' token:tok token=ab [ASSIGN]" and clean[1].n_chars == len(clean[1].text)
    assert clean[4].text is None and clean[8].text == "toke n secre" and len(clean) == 9
    assert secret_scan.find_secrets(frame(spark, [])).count() == 0


def test_queries_hold_for_all_matches():
    r = np.random.default_rng(2)
    for pattern, samples in ((rb"ab+c[de]f(gh|ijk)?", [b"abbcdfgh", b"ABCEF", b"abcefijk"]), (rb"(?:foo|barr)[0-9]+baz", [b"foo1baz", b"barr22baz"]), (rb"x[a-z]y", [b"xqy"])):
        query = secret_scan.trigram_query(pattern, re.I)
        for s in samples:
            t = (bytes(r.integers(97, 123, 5).astype(np.uint8)) + s).lower()
            assert re.search(pattern, t, re.I) and any(all(g in t for g in every) for every in query)


# ---- 10 ----


def test_mixing(spark):
    docs = [(i, "t") for i in range(1, 4001)] + [(None, None)]
    out = mixing.mix_sources(frame(spark, docs), {"s0": 3.0, "s1": 1.0}, total=8000)
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert n["s0"] == pytest.approx(6000, rel=0.05) and n["s1"] == pytest.approx(2000, rel=0.1)
    counts = Counter(r.n_copies for r in out.where("source = 's0' and copy = 1").collect())
    assert counts[3] / 2000 == pytest.approx(math.exp(-3) * 27 / 6, abs=0.03)
    again = mixing.mix_sources(frame(spark, docs).repartition(7), {"s0": 3.0, "s1": 1.0}, total=8000)
    assert sorted(map(str, rows_of(again))) == sorted(map(str, rows_of(out)))
    assert mixing.mix_sources(frame(spark, docs), {"s0": 1.0}).where("source = 's1'").count() == 0
    assert mixing.mix_sources(frame(spark, [])).count() == 0
    assert mixing.mix_sources(frame(spark, [(1, "a"), (1, "a")]), total=2000).count() == pytest.approx(2000, rel=0.1)


def test_words_of_blocks():
    texts = ["", "a", "A1 b.c", "é\tü", "x" * 5000, "end"]
    for block in blocks(pa.array([t.encode() for t in texts], pa.binary()), 8):
        block.words(ALNUM)
        for d in range(block.hi - block.lo):
            own = range(block.first[d], block.first[d + 1])
            assert [bytes(block.bytes[block.start[i] : block.end[i]]).decode() for i in own] == WORD.findall(lower(texts[block.lo + d]))
