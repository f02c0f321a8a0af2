"""Cross-tokenizer alignment by an associative monoid of fragments.

Two tokenizers split a text into tokens that end at byte offsets; offsets where a token of either ends cut the text
into groups. A fragment holds the tokens of a stretch of text as an open prefix up to its first such cut, closed groups,
and an open suffix after its last. Neighbouring fragments compose to the fragment of both, in any bracketing, so that a
very long document is cut into byte ranges that tasks tokenize by themselves, and its fragments are put together as a
tree over shuffles. Short documents are fragments of their words: both tokenizers part before a space between two
other characters, so that a word that was met before in a task is tokenized once.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tramaline.session import cut

TOKENIZERS = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Longer texts (in characters) are cut into ranges of about this size. Fragments composed by one task in a round.
CHUNK, FAN = 1 << 16, 8
#: Bytes of link counts in a block of documents; characters tokenized at a time; words and characters of a word kept.
BLOCK, SLICE, WORDS, WORD = 8 << 20, 1 << 20, 400_000, 64
#: Both tokenizers part before a space between two other characters, the first also at these places.
_BOTH = r"(?<=\S)(?= \S)"
_FIRST = re.compile(rf"{_BOTH}|(?<=\S[\t\n\r])(?=\S)|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
_SECOND, _SPACE = re.compile(_BOTH), re.compile(r"(?<=\S) (?=\S)")
#: A token: its id and the byte offset at which it ends.
Token = tuple[int, int]


@dataclass
class Fragment:
    """Tokens of a stretch of text: head up to its first cut (without one: all), closed groups, tail after its last."""

    head: tuple[list[Token], list[Token]] = field(default_factory=lambda: ([], []))
    cut: bool = False
    closed: list[str] = field(default_factory=list)
    links: list[Token] = field(default_factory=list)  # the ids whose tokens end at each cut
    tail: tuple[list[Token], list[Token]] = field(default_factory=lambda: ([], []))

    def open_end(self) -> tuple[list[Token], list[Token]]:
        return self.tail if self.cut else self.head

    def __mul__(self, other: Fragment) -> Fragment:
        """The fragment of this stretch and the next one. Cuts appear where a tail's tokens end with those of the next head."""
        (a, b), (c, d) = self.open_end(), other.head
        middle = fragment(a + c, b + d)
        if not middle.cut:
            return Fragment(self.head, True, self.closed, self.links, middle.head) if self.cut else middle
        joined = [*self.closed, _group(*middle.head)] if self.cut else []
        found = middle.links[:-1] if other.cut else middle.links  # the last one is the first of other
        return Fragment(
            self.head if self.cut else middle.head, True, [*joined, *middle.closed, *other.closed],
            [*self.links, *found, *other.links], other.tail if other.cut else middle.tail,
        )


def _group(a: list[Token], b: list[Token]) -> str:
    return ",".join(str(x[0]) for x in a) + "|" + ",".join(str(x[0]) for x in b)


def fragment(a: list[Token], b: list[Token]) -> Fragment:
    """The fragment of the tokens of one stretch, each list by ascending ends."""
    out, i, j, i0, j0 = Fragment(), 0, 0, 0, 0
    while i < len(a) and j < len(b):
        if a[i][1] < b[j][1]:
            i += 1
        elif a[i][1] > b[j][1]:
            j += 1
        else:
            i, j = i + 1, j + 1
            if out.cut:
                out.closed.append(_group(a[i0:i], b[j0:j]))
            else:
                out.head, out.cut = (a[:i], b[:j]), True
            out.links.append((a[i - 1][0], b[j - 1][0]))
            i0, j0 = i, j
    if out.cut:
        out.tail = (a[i0:], b[j0:])
    else:
        out.head = (a, b)
    return out


class Tokenizers:
    """Both tokenizers with the bytes of their tokens, from the contents of their files."""

    def __init__(self, a_json: str, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        spec = json.loads(a_json)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level vocabularies show as they are
        byte = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(sorted(set(range(256)) - set(shown)))}
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [b"" if self.b.is_control(i) else bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        first = spec["normalizer"] is None and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        same = ("a  b ÅＡ", "▁a▁▁b ÅＡ")
        second = self.b.normalize(same[0]) == same[1] and not any("▁" in p.lstrip("▁") for p in pieces)
        #: Words can be tokenized by themselves: no text is normalized, and no token goes on past a space.
        self.by_word = first and second

    def parts(self, text: str) -> list[str]:
        """The words of space+text, without the spaces that they begin with, or all of it as one."""
        return _SPACE.split(text) if self.by_word else [text]

    def tokens(self, text: str, begin: int = 0) -> tuple[list[Token], list[Token], bool]:
        """Both tokenizers' tokens of space+text, and whether their bytes are those of the text."""
        first, second, whole = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text), (" " + text).encode()
        return self.ends(first, self.a_bytes, begin), self.ends(second, self.b_bytes, begin), self.gives(first, self.a_bytes, whole) and self.gives(second, self.b_bytes, whole)

    def many(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For either tokenizer the tokens of many space+texts: text, id and end of each, and whether a text's bytes are given."""
        wholes = [(" " + x).encode() for x in texts]
        sizes, out = np.array([len(x) for x in wholes], np.int64), []
        first = (e.ids for e in self.a.encode_batch_fast([" " + x for x in texts], add_special_tokens=False))
        for ids, of in ((list(first), self.a_bytes), (self.b.encode(texts, num_threads=1), self.b_bytes)):
            n = np.array([len(x) for x in ids], np.int64)
            flat = np.fromiter(chain.from_iterable(ids), np.int64, n.sum())
            ends = np.cumsum(np.array([len(x) for x in of])[flat])
            last = np.concatenate([[0], ends])[np.cumsum(n)]
            begins = np.concatenate([[0], last[:-1]])
            # as far as sizes agree, one comparison is that of each text with its own bytes
            right = last - begins == sizes
            if not right.all() or b"".join([of[i] for i in flat.tolist()]) != b"".join(wholes):
                right = np.array([self.gives(x, of, w) for x, w in zip(ids, wholes, strict=True)], bool)
            out.append((np.repeat(np.arange(len(texts)), n), flat, ends - np.repeat(begins, n), right))
        return out

    @staticmethod
    def ends(ids: list[int], of: list[bytes], begin: int) -> list[Token]:
        out = []
        for i in ids:
            begin += len(of[i])
            out.append((i, begin))
        return out

    @staticmethod
    def gives(ids: list[int], of: list[bytes], whole: bytes) -> bool:
        return b"".join([of[i] for i in ids]) == whole


class Words:
    """What is known of words: numbers of tokens and groups, the groups as text, and links; kept until there are too many.

    A word begins and ends with a cut, so that it is a fragment of closed groups only, and composing is joining.
    """

    def __init__(self, tools: Tokenizers):
        self.tools, self.n_b = tools, len(tools.b_bytes)
        most = max(len(tools.a_bytes), self.n_b)
        self.shown = [np.array([c + str(i) for i in range(most)], object) for c in ";,|"]
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.texts: list[str] = []
        self.chunks: list[tuple[np.ndarray, np.ndarray]] = []
        self.tables: tuple[np.ndarray, np.ndarray] | None = None

    def known(self) -> tuple[np.ndarray, np.ndarray]:
        """By word: tokens of either tokenizer, groups (0: its bytes are others) and where its links begin; and all links."""
        if self.tables is None:
            rows, links = (np.concatenate(x) for x in zip(*self.chunks, strict=True))
            self.chunks, self.tables = [(rows, links)], (np.column_stack([rows, np.cumsum(rows[:, 2]) - rows[:, 2]]), links)
        return self.tables

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.index]
        if len(self.index) + len(new) > WORDS:
            self.forget()
            new = list(words)
        if not new:
            return
        (word_a, id_a, end_a, right_a), (word_b, id_b, end_b, right_b) = self.tools.many(new)
        key_a, key_b = (np.where(right[word], word << 20 | end, -1 - side) for side, word, end, right in ((0, word_a, end_a, right_a & right_b), (1, word_b, end_b, right_a & right_b)))
        keep_a, keep_b = key_a >= 0, key_b >= 0
        word_a, id_a, key_a, word_b, id_b, key_b = word_a[keep_a], id_a[keep_a], key_a[keep_a], word_b[keep_b], id_b[keep_b], key_b[keep_b]
        cuts = np.intersect1d(key_a, key_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, key_a), np.searchsorted(cuts, key_b)
        # tokens in the order in which groups name them: those of a, then those of b
        text = np.empty(len(key_a) + len(key_b), object)
        for group, ids, at, mark in ((group_a, id_a, np.arange(len(id_a)) + np.searchsorted(group_b, group_a), 0), (group_b, id_b, np.arange(len(id_b)) + np.searchsorted(group_a, group_b, "right"), 2)):
            begins = np.diff(group, prepend=-1) > 0
            text[at[begins]], text[at[~begins]] = self.shown[mark][ids[begins]], self.shown[1][ids[~begins]]
        counts = np.column_stack([np.bincount(x, minlength=len(new)) for x in (word_a, word_b, cuts >> 20)])
        edges, flat = [0, *np.cumsum(counts[:, 0] + counts[:, 1]).tolist()], text.tolist()
        self.texts += ["".join(flat[lo:hi])[1:] for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
        self.chunks.append((counts, id_a[np.searchsorted(key_a, cuts)] * self.n_b + id_b[np.searchsorted(key_b, cuts)]))
        self.tables = None


def packed(links: np.ndarray, count: np.ndarray, wide: bool) -> tuple[bytes, bytes]:
    """Links of a document, each once, and how often each occurs."""
    return links.astype(np.uint64 if wide else np.uint32).tobytes(), count.astype(np.uint8 if len(count) == 0 or count.max() < 256 else np.uint32).tobytes()


def unpacked(links: bytes, count: bytes, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    keys = np.frombuffer(links, np.uint64 if wide else np.uint32)
    return keys.astype(np.int64), np.frombuffer(count, np.uint8 if len(count) == len(keys) else np.uint32).astype(np.int64)


_RESULT = "block long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, groups string, links binary, counts binary"
_PIECES = "uid long, idx int, a_begin long, a_text string, b_begin long, b_text string"
_FRAGMENT = "uid long, doc_id long, idx int, ok boolean, n_a long, n_b long, is_cut boolean, head_a binary, head_b binary, tail_a binary, tail_b binary, closed string, n_closed long, links binary"
_NONE = ("", None, b"", b"")


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    names, types = zip(*(f.strip().split(" ") for f in schema.split(",")), strict=True)
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], list(names))


def ranges(text: str, size: int, by_word: bool) -> Iterator[tuple[int, str, int, str]]:
    """space+text in ranges: the byte offset and text for the first tokenizer, and for the second.

    Each begins at the first place at or after a multiple of size where its tokenizer parts; a stretch without one
    stays whole, and the ranges of the two needn't be the same.
    """
    whole = " " + text
    marks = [[0], [0]]
    for found, places in zip(marks, (_FIRST, _SECOND), strict=True):
        for at in range(size, len(whole), size):
            if found[-1] < at:
                m = places.search(whole, at) if by_word else None
                found.append(m.start() if m else len(whole))
            else:
                found.append(found[-1])
        found.append(len(whole))
    byte = [0, 0]
    for k in range(len(marks[0]) - 1):
        out = []
        for s, found in enumerate(marks):
            part = whole[found[k] : found[k + 1]]
            out += [byte[s], part]
            byte[s] += len(part.encode())
        yield tuple(out)


class Aligner:
    """The operator's steps over Arrow batches, for two tokenizers whose files are broadcast."""

    def __init__(self, spark: SparkSession, folder: str, chunk: int, block: int, keep_groups: bool):
        files = spark.sparkContext.broadcast((_read(f"{folder}/{A_FILE}").decode(), _read(f"{folder}/{B_FILE}")))  # fixed vocabularies
        tools = Tokenizers(*files.value)
        self.n_b, self.wide = len(tools.b_bytes), len(tools.a_bytes) * len(tools.b_bytes) > 1 << 32
        self.chunk, self.block, self.keep, self.tools = chunk, block, keep_groups, lambda: Tokenizers(*files.value)

    def short_and_ranges(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents' own results, in blocks; of longer documents the ranges, in the same table."""
        tools = self.tools()
        words, task = Words(tools), TaskContext.get().partitionId() << 32
        block, held, uid = 0, 0, 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            lo = 0
            while lo < len(ids):
                hi, n = lo, 0
                while hi < len(ids) and (hi == lo or n + len(texts[hi] or "") <= SLICE) and n <= SLICE:
                    n += len(texts[hi] or "")
                    hi += 1
                long = [k for k in range(lo, hi) if len(texts[k] or "") > self.chunk]
                short = [k for k in range(lo, hi) if len(texts[k] or "") <= self.chunk]
                rows = self.results([ids[k] for k in short], [texts[k] or "" for k in short], words)
                out = []
                for r in rows:
                    out.append((2 * (task + block), *r, None, None, None, None, None, None))
                    held += len(r[-1]) + len(r[-2]) + 64
                    if held > self.block:
                        block, held = block + 1, 0
                if out:
                    yield _table(out, f"{_RESULT}, {_PIECES}")
                for k in long:
                    pieces = ranges(texts[k], self.chunk, tools.by_word)
                    yield _table([(None, ids[k], *[None] * 7, task + uid, i, *p) for i, p in enumerate(pieces)], f"{_RESULT}, {_PIECES}")
                    uid += 1
                lo = hi

    def results(self, ids: list, texts: list[str], words: Words) -> list[tuple]:
        """The columns of _RESULT after block of some short documents."""
        parts = [words.tools.parts(t) if t else [] for t in texts]
        words.learn({w for p in parts for w in p if len(w) <= WORD})
        rows: list[tuple | None] = [None] * len(ids)
        whole = []
        for k, p in enumerate(parts):
            at = [words.index.get(w, -1) for w in p]
            if not p:
                rows[k] = (ids[k], 0, 0, 0, *_NONE)
            elif min(at) >= 0 and (words.known()[0][at, 2] > 0).all():
                whole.append((k, at))
            else:  # words that are too long to keep, or whose bytes aren't those of the text
                rows[k] = self.one(ids[k], texts[k], p, words.tools)
        for k, at, links, count, sums in self.counted(whole, words):
            text = ";".join([words.texts[i] for i in at])
            rows[k] = (ids[k], *sums, sha256(text.encode()).hexdigest(), text if self.keep else None, *packed(links, count, self.wide))
        return rows

    def counted(self, docs: list[tuple[int, list[int]]], words: Words) -> Iterator[tuple]:
        """Tokens, groups and links of documents whose words are all known, counted for all documents at once."""
        if not docs:
            return
        table, flat = words.known()
        sizes = [len(x) for _, x in docs]
        at = table[np.fromiter(chain.from_iterable(x for _, x in docs), np.int64, sum(sizes))]
        sums = np.add.reduceat(at[:, :3], np.cumsum([0, *sizes[:-1]]), axis=0).tolist()
        n = at[:, 2]
        place = np.repeat(at[:, 3] - np.cumsum(n) + n, n) + np.arange(n.sum())
        span = int(flat.max()) + 1
        keys, count = np.unique(np.repeat(np.repeat(np.arange(len(docs)), sizes), n) * span + flat[place], return_counts=True)
        edges = np.searchsorted(keys, np.arange(len(docs) + 1) * span).tolist()
        for d, (k, x) in enumerate(docs):
            lo, hi = edges[d], edges[d + 1]
            yield k, x, keys[lo:hi] - d * span, count[lo:hi], sums[d]

    def one(self, doc_id: int | None, text: str, parts: list[str], tools: Tokenizers) -> tuple:
        """A document by itself: from its words, or from its whole text where a word's bytes are others."""
        pieces, begin, n = [], 0, [0, 0]
        for word in parts:
            a, b, ok = tools.tokens(word, begin)
            if not ok:
                a, b, ok = tools.tokens(text)
                return self.finished(doc_id, ok, len(a), len(b), fragment(a, b) if ok else Fragment())
            begin, n = begin + 1 + len(word.encode()), [n[0] + len(a), n[1] + len(b)]
            pieces.append(fragment(a, b))
        return self.finished(doc_id, True, *n, _tree(pieces))

    def finished(self, doc_id: int | None, ok: bool, n_a: int, n_b: int, f: Fragment) -> tuple:
        """The result of a document's whole fragment."""
        if not ok or not f.cut or any(f.tail):
            return (doc_id, 0, 0, 0, *_NONE)
        text = ";".join([_group(*f.head), *f.closed])
        links, count = np.unique(np.array([x * self.n_b + y for x, y in f.links], np.int64), return_counts=True)
        return (doc_id, n_a, n_b, len(f.links), sha256(text.encode()).hexdigest(), text if self.keep else None, *packed(links, count, self.wide))

    def range_fragments(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each range of a long document as a fragment of its own."""
        tools = self.tools()
        for batch in batches:
            for r in batch.to_pylist():
                first = tools.a.encode(r["a_text"], add_special_tokens=False).ids if r["a_text"] else []
                # the second tokenizer adds the space that its range begins with
                second = tools.b.encode(r["b_text"][1:]) if r["b_text"] else []
                ok = tools.gives(first, tools.a_bytes, r["a_text"].encode()) and tools.gives(second, tools.b_bytes, r["b_text"].encode())
                f = fragment(tools.ends(first, tools.a_bytes, r["a_begin"]), tools.ends(second, tools.b_bytes, r["b_begin"])) if ok else Fragment()
                yield _table([(r["uid"], r["doc_id"], r["idx"], ok, len(first), len(second), *_stored(f))], _FRAGMENT)

    def composed(self, group: pa.Table) -> pa.Table:
        """Neighbouring fragments of one document, in order, as one."""
        rows = sorted(group.to_pylist(), key=lambda r: r["idx"])
        f = _tree([_loaded(r) for r in rows])
        ok = all(r["ok"] for r in rows)
        out = (rows[0]["uid"], rows[0]["doc_id"], rows[0]["idx"] // FAN, ok, sum(r["n_a"] for r in rows), sum(r["n_b"] for r in rows), *_stored(f if ok else Fragment()))
        return pa.Table.from_batches([_table([out], _FRAGMENT)])

    def roots(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Results of the documents whose fragments are whole, a block for each."""
        for batch in batches:
            for r in batch.to_pylist():
                yield _table([(2 * r["uid"] + 1, *self.finished(r["doc_id"], r["ok"], r["n_a"], r["n_b"], _loaded(r)))], _RESULT)

    def block_links(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """block, link and n: the links of each block, counted within a batch."""
        for batch in batches:
            blocks = np.asarray(batch.column(0))
            for block in np.unique(blocks):
                rows = np.flatnonzero(blocks == block).tolist()
                both = [unpacked(batch.column(1)[k].as_py(), batch.column(2)[k].as_py(), self.wide) for k in rows]
                links, where = np.unique(np.concatenate([x for x, _ in both]), return_inverse=True)
                n = np.bincount(where, np.concatenate([y for _, y in both]), len(links)).astype(np.int64)
                if len(links):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(links), block)), pa.array(links), pa.array(n)], ["block", "link", "n"])

    def answered(self, docs: pa.Table, known: pa.Table) -> pa.Table:
        """A block's documents with the corpus-wide counts of their links."""
        order = np.argsort(np.asarray(known.column("link")), kind="stable")
        link, n, best = (np.asarray(known.column(c))[order] for c in ("link", "n", "best"))
        n_best, count_sum = [], []
        for x, y in zip(docs.column("links"), docs.column("counts"), strict=True):
            own, times = unpacked(x.as_py(), y.as_py(), self.wide)
            at = np.searchsorted(link, own)
            n_best.append(int(times[best[at]].sum()) if len(own) else 0)
            count_sum.append(int((times * n[at]).sum()) if len(own) else 0)
        columns = {"doc_id": docs.column("doc_id"), "n_a": docs.column("n_a"), "n_b": docs.column("n_b"), "n_groups": docs.column("n_groups"), "n_links": docs.column("n_groups")}
        columns |= {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64()), "groups_sha256": docs.column("groups_sha256"), "groups": docs.column("groups")}
        return pa.table(columns)


_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _tree(parts: list[Fragment]) -> Fragment:
    """Fragments in order, composed in pairs of neighbours, and these again."""
    while len(parts) > 1:
        parts = [parts[k] * parts[k + 1] if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0] if parts else Fragment()


def _stored(f: Fragment) -> tuple:
    ints = lambda x: np.array(x, np.int64).tobytes()
    return (f.cut, *map(ints, (*f.head, *f.tail)), ";".join(f.closed), len(f.closed), ints(f.links))


def _loaded(r: dict) -> Fragment:
    pairs = lambda c: list(map(tuple, np.frombuffer(r[c], np.int64).reshape(-1, 2).tolist()))
    return Fragment((pairs("head_a"), pairs("head_b")), r["is_cut"], r["closed"].split(";") if r["n_closed"] else [], pairs("links"), (pairs("tail_a"), pairs("tail_b")))


def link_counts(links: DataFrame, n_b: int) -> DataFrame:
    """link, n, best of link and n per block: n over the corpus; best: no link of the same id of the second has more.

    A link is its first id times n_b, and its second. An id of the second has at most as many links as the first has ids.
    """
    total = links.groupBy("link").agg(F.sum("n").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.col("link") % n_b))
    return total.select("link", "n", (F.col("n") == most).alias("best"))


def align_tokens(docs: DataFrame, folder: str = TOKENIZERS, chunk: int = CHUNK, block: int = BLOCK, keep_groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and groups (null unless keep_groups) per row.

    Space+text is tokenized by both tokenizers, whose files folder holds; groups end where a token of either ends, and
    the tokens of both that end there are linked. n_best: links that are the most frequent ones in the corpus of their
    second id; count_sum: corpus-wide counts, summed over links. groups names the ids of each group. A text that is
    null or empty, or that isn't what the bytes of either tokenizer's tokens give, has no tokens: zeros, and an empty
    groups_sha256. Repeated rows and null keys stay as they are and count each; other columns aren't read. An empty
    table gives no rows.

    Texts longer than chunk are tokenized range by range and composed over log(ranges) shuffles; a stretch without a
    place to part stays in one range. Link counts of documents go in blocks that ask for the corpus-wide counts of
    their links; a block's counts take about block bytes, or are one document's.
    """
    spark = docs.sparkSession
    step = Aligner(spark, folder, chunk, block, keep_groups)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(step.short_and_ranges, f"{_RESULT}, {_PIECES}")
    found = cut(found, "tokens")
    names = [f.name for f in T.StructType.fromDDL(_RESULT)]
    done, last = found.where("block is not null").select(*names), found.agg(F.max("idx")).first()[0]
    if last is not None:
        pieces = found.where("uid is not null").select("uid", "doc_id", "idx", "a_begin", "a_text", "b_begin", "b_text")
        whole = pieces.repartition(parts, "uid", "idx").mapInArrow(step.range_fragments, _FRAGMENT)
        while last > 0:
            whole, last = whole.groupBy("uid", F.floor(F.col("idx") / FAN)).applyInArrow(lambda group: step.composed(group), _FRAGMENT), last // FAN
        done = done.unionByName(cut(whole.mapInArrow(step.roots, _RESULT), "roots"))
    links = cut(done.select("block", "links", "counts").mapInArrow(step.block_links, "block long, link long, n long"), "links")
    asked = links.select("block", "link").join(link_counts(links, step.n_b), "link")
    return done.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(lambda rows, known: step.answered(rows, known), _ALIGNED)
