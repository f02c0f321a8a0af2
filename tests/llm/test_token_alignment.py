"""Cross-tokenizer alignment: the monoid's laws, words and ranges against whole texts, brute force, odd cases."""

from __future__ import annotations

from collections import Counter, defaultdict
from functools import reduce
from hashlib import sha256
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.test_llm_operators import LONG, ODD, frame
from tramaline.llm import queries
from tramaline.llm import token_alignment as ta

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(ta.TOKENIZERS).exists(), reason="needs the vocabulary files")
TEXTS = st.text(st.sampled_from(list("aeinst  \n\t\r.'s,19é日 ▁　\x1c\x85<|>#A")), max_size=60)


@pytest.fixture(scope="module")
def tools():
    return ta.Tokenizers(Path(ta.TOKENIZERS, ta.A_FILE).read_text(), Path(ta.TOKENIZERS, ta.B_FILE).read_bytes())


def tokens_of(tools, text):
    """Both tokenizers' (id, end) over space+text, or None where their bytes are others."""
    whole, out = (" " + text).encode(), []
    for ids, of in ((tools.a.encode(" " + text, add_special_tokens=False).ids, tools.a_bytes), (tools.b.encode(text), tools.b_bytes)):
        ends, n = [], 0
        for i in ids:
            n += len(of[i])
            ends.append((i, n))
        if b"".join(of[i] for i in ids) != whole:
            return None
        out.append(ends)
    return out


def brute(tools, docs):
    """Rows of the operator by dictionaries of ends, text by text."""
    rows, count = [], Counter()
    for doc_id, text in docs:
        both = tokens_of(tools, text) if text else None
        if not both:
            rows.append((doc_id, 0, 0, [], ""))
            continue
        a, b = both
        groups, links, i, j = [], [], 0, 0
        for end in sorted({e for _, e in a} & {e for _, e in b}):
            x, y = [t for t in a[i:] if t[1] <= end], [t for t in b[j:] if t[1] <= end]
            i, j = i + len(x), j + len(y)
            groups.append(",".join(str(t[0]) for t in x) + "|" + ",".join(str(t[0]) for t in y))
            links.append((x[-1][0], y[-1][0]))
        count.update(links)
        rows.append((doc_id, len(a), len(b), links, ";".join(groups)))
    most = defaultdict(int)
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    return Counter((d, a, b, len(x), len(x), sum(count[k] == most[k[1]] for k in x), sum(count[k] for k in x), sha256(g.encode()).hexdigest() if g else "") for d, a, b, x, g in rows)


def result(df):
    return Counter(tuple(r)[:8] for r in df.collect())


STREAM = st.lists(st.integers(1, 4), max_size=12).map(lambda x: [(k % 3, sum(x[: k + 1])) for k in range(len(x))])


@given(STREAM, STREAM, st.lists(st.integers(0, 12), max_size=4), st.lists(st.integers(0, 12), max_size=4), st.randoms())
def test_fragments_are_a_monoid(a, b, cuts_a, cuts_b, random):
    """However the two streams are cut, apart from each other, and in whatever order parts are composed: the same whole."""
    n = max(len(cuts_a), len(cuts_b)) + 1
    bounds = lambda c, x: [0, *sorted(min(k, len(x)) for k in c), *[len(x)] * (n - len(c))]
    p, q = bounds(cuts_a, a), bounds(cuts_b, b)
    parts = [ta.fragment(a[p[k] : p[k + 1]], b[q[k] : q[k + 1]]) for k in range(n)]
    whole = ta.fragment(a, b)
    assert reduce(ta.Fragment.__mul__, parts) == whole == ta._tree(parts)
    while len(parts) > 1:
        k = random.randrange(len(parts) - 1)
        parts[k : k + 2] = [parts[k] * parts[k + 1]]
    assert parts[0] == whole == ta.Fragment() * whole == whole * ta.Fragment()


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_words_and_ranges_are_the_whole_text(tools, text):
    both = tokens_of(tools, text) if text else None
    if not both:
        return
    assert tools.by_word
    for k in (0, 1):
        ids = [i for i, _ in both[k]]
        words = tools.parts(text)
        one = [i for w in words for i in (tools.a.encode(" " + w, add_special_tokens=False).ids if k == 0 else tools.b.encode(w))]
        assert one == ids
        found = [r[2 * k + 1] for r in ta.ranges(text, 7, True)]
        assert "".join(found) == " " + text
        assert [i for r in found if r for i in (tools.a.encode(r, add_special_tokens=False).ids if k == 0 else tools.b.encode(r[1:]))] == ids


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the given tables")
def test_given_documents(spark, tools):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute(tools, docs)
    out = queries.QUERIES["op12_token_alignment"](spark, SF)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert result(out) == want
    assert result(ta.align_tokens(frame(spark, docs), chunk=300, block=20_000)) == want


@pytest.mark.parametrize("chunk", [1 << 16, 40])
def test_odd_rows(spark, tools, chunk):
    nasty = ["▁ a", "x ▁y z", "<|endoftext|> <s> </s>", "a\x00b  c", "don't  stop\n\nnow 42nd's", " " * 90 + "x", "x" * 3000, "日本語 テキスト" * 60, "é" * 200, "\n" * 120, "ab12" * 80 + "\nword\nword", "  　 \x85y", "tail ", LONG + " ▁ " + LONG]
    docs = [*ODD, *((100 + k, t) for k, t in enumerate(nasty))]
    assert result(ta.align_tokens(frame(spark, docs), chunk=chunk)) == brute(tools, docs)


def test_words_are_forgotten(spark, tools, monkeypatch):
    docs = [(k, " ".join(f"w{k * 7 + j}" for j in range(12))) for k in range(30)]
    w = ta.Words(tools)
    monkeypatch.setattr(ta, "WORDS", 20)
    for _, text in docs:
        w.learn(set(tools.parts(text)))
        assert len(w.index) <= 20 and set(tools.parts(text)) <= w.index.keys()
    rows = [r for d, t in docs for r in ta.Aligner(spark, ta.TOKENIZERS, ta.CHUNK, ta.BLOCK, True).results([d], [t], w)]
    assert [r[5].count("|") for r in rows] == [len(ta.fragment(*tokens_of(tools, t)).links) for _, t in docs]


def test_groups_are_kept_if_asked(spark, tools):
    text = "internationalization of words"
    row = ta.align_tokens(frame(spark, [(1, text)]), keep_groups=True).first()
    f = ta.fragment(*tokens_of(tools, text))
    assert row.groups == ";".join([ta._group(*f.head), *f.closed]) and row.n_groups == row.groups.count(";") + 1


def test_no_rows(spark):
    assert ta.align_tokens(frame(spark, [(1, "a")]).limit(0)).count() == 0
