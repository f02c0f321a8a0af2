"""Secret scans with a trigram inverted index.

Each rule's regex is turned into a Boolean query over trigrams that any match must hold. Documents are
indexed block by block (an inverted index dealt by document): the postings of every trigram that some rule
asks for. A rule's postings are intersected and united as its query says, and the regex verifies only the
candidates. A rule without mandatory trigrams scans all documents.
"""

from __future__ import annotations

import hashlib
import re
import re._constants as C
import re._parser as parser
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramaline.llm.textblock import Block, blocks

#: A query is an OR of ANDs of trigrams; {frozenset()} asks for nothing.
Query = frozenset[frozenset[bytes]]
ANY: Query = frozenset([frozenset()])
MOST_STRINGS, MOST_CLASS, MOST_TERMS = 64, 8, 64


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: bytes
    flags: int = 0
    group: int = 0
    least: int = 0  # characters that the group has at least; shorter matches are dropped after matching
    base: bool = False


#: Fixed patterns of the base kinds, in the order in which they are listed.
BASE = (
    Rule("assign", rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I, 2, 6, True),
    Rule("access", rb"AKIA[A-Z0-9]+", 0, 0, 20, True),
    Rule("hex", rb"[0-9a-f]+", 0, 0, 24, True),
)
#: A private key from its head through the next END line; where that is missing, through its header and base64 lines.
#: Line ends may be escaped, and lines quoted. Shorter runs of base64 belong to the key if they fill a line or end in =.
_BETWEEN = rb"(?:\\[nrt]|[\s\"'>#*|,])*+"
_KEY_BODY = (
    rb"(?:(?:(?!-----BEGIN )[\s\S])*?-----END (?:[A-Z]+ )*PRIVATE KEY-----"
    rb"|(?:" + _BETWEEN + rb"(?:[A-Z][A-Za-z]*-[A-Za-z-]+:[^\r\n\\]*|[A-Za-z0-9+/=]{16,}+|[A-Za-z0-9+/]++=)=*"
    rb"|[\x20\t\"']*(?:\\[nr]|[\r\n])" + _BETWEEN + rb"[A-Za-z0-9+/]++(?=[\x20\t]*(?:[\r\n\\\"'<]|\Z)))*)"
)
#: Fixed patterns of further kinds, after public formats of tokens.
EXTRA = (
    Rule("private_key", rb"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----" + _KEY_BODY),
    Rule("github", rb"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", rb"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", rb"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", rb"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", rb"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("age", rb"AGE-SECRET-KEY-1[A-Z0-9]{50,}"),
    Rule("azure", rb"AccountKey=[A-Za-z0-9+/]{60,}={0,2}"),
    Rule("databricks", rb"dapi[a-f0-9]{32}"),
    Rule("digitalocean", rb"do[opr]_v1_[a-f0-9]{64}"),
    Rule("docker", rb"dckr_pat_[A-Za-z0-9_-]{20,}"),
    Rule("gitlab", rb"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("huggingface", rb"hf_[A-Za-z0-9]{30,}"),
    Rule("mailgun", rb"key-[0-9a-f]{32}"),
    Rule("npm", rb"npm_[A-Za-z0-9]{36}"),
    Rule("pypi", rb"pypi-AgEI[A-Za-z0-9_-]{50,}"),
    Rule("sendgrid", rb"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}"),
    Rule("shopify", rb"shp(?:at|ca|pa|ss)_[A-Fa-f0-9]{32}"),
    Rule("slack_hook", rb"hooks\.slack\.com/services/[A-Za-z0-9/_-]{20,}"),
    Rule("square", rb"sq0(?:atp|csp)-[A-Za-z0-9_-]{22,}"),
    Rule("telegram", rb"[0-9]{8,10}:AA[A-Za-z0-9_-]{33}"),
    Rule("url_login", rb"[a-z][a-z0-9+.-]{1,15}://[^\s/:@]++:[^\s/:@]++@"),
)
RULES = BASE + EXTRA


def _least(q: set[frozenset[bytes]]) -> Query:
    """Without alternatives that ask for more than another; asks for nothing if there are too many."""
    kept = [a for a in q if not any(b < a for b in q)]
    return frozenset(kept) if len(kept) <= MOST_TERMS else ANY


def _all_of(a: Query, b: Query) -> Query:
    return _least({x | y for x in a for y in b}) if len(a) * len(b) <= 16 * MOST_TERMS else min(a, b, key=len)


def _of_strings(strings: set[bytes]) -> Query:
    return _least({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


def _walk(tokens) -> tuple[set[bytes] | None, Query]:
    """The exact (lower-cased) strings of a piece of regex if they are few, and the query it implies."""
    exact: set[bytes] = {b""}
    whole, query = True, ANY
    for op, arg in tokens:
        got, asked = _one(op, arg)
        if got is not None and len(got) * len(exact) <= MOST_STRINGS:
            exact = {a + b for a in exact for b in got}
            continue
        query = _all_of(query, _of_strings(exact))
        query = _all_of(query, asked if got is None else _of_strings(got))
        exact, whole = {b""}, False
    if whole:
        return exact, ANY
    return None, _all_of(query, _of_strings(exact))


def _one(op, arg) -> tuple[set[bytes] | None, Query]:
    if op is C.LITERAL:
        return {bytes([arg]).lower()}, ANY
    if op in (C.AT, C.ASSERT, C.ASSERT_NOT):
        return {b""}, ANY
    if op is C.SUBPATTERN:
        return _walk(arg[-1])
    if op is C.IN and all(k in (C.LITERAL, C.RANGE) for k, _ in arg):
        chars = {bytes([c]).lower() for k, v in arg for c in ((v,) if k is C.LITERAL else range(v[0], v[1] + 1))}
        return (chars if len(chars) <= MOST_CLASS else None), ANY
    if op is C.BRANCH:
        parts = [_walk(x) for x in arg[1]]
        if all(s is not None for s, _ in parts):
            return set().union(*(s for s, _ in parts)), ANY
        return None, _least(set().union(*(q if s is None else _of_strings(s) for s, q in parts)))
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        low, high, inner = arg
        got, asked = _walk(inner)
        if (low, high) == (0, 1) and got is not None:
            return got | {b""}, ANY
        if got is not None and low == high and low <= 4 and len(got) ** low <= MOST_STRINGS:
            out = {b""}
            for _ in range(low):
                out = {a + b for a in out for b in got}
            return out, ANY
        return None, ANY if low == 0 else (asked if got is None else _of_strings(got))
    return None, ANY


def trigram_query(pattern: bytes, flags: int = 0) -> Query:
    """What lower-cased trigrams a match of the regex must hold, as an OR of ANDs."""
    exact, query = _walk(parser.parse(pattern, flags))
    return query if exact is None else _of_strings(exact)


@lru_cache(maxsize=4)
def _compiled(rules: tuple[Rule, ...]) -> tuple[list[re.Pattern[bytes]], list[Query], dict[bytes, int], np.ndarray]:
    queries = [trigram_query(r.pattern, r.flags) for r in rules]
    grams = {g: i + 1 for i, g in enumerate(sorted({g for q in queries for a in q for g in a}))}
    place = np.zeros(1 << 24, np.uint16)  # a fixed table from trigram to its number, 0 if no rule asks for it
    for g, i in grams.items():
        place[g[0] | g[1] << 8 | g[2] << 16] = i
    return [re.compile(r.pattern, r.flags) for r in rules], queries, grams, place


def postings(block: Block, place: np.ndarray) -> dict[int, np.ndarray]:
    """Of each trigram number, the sorted documents of the block that hold it."""
    b = block.bytes.astype(np.uint32)
    if len(b) < 3:
        return {}
    number = place[b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)]
    at = np.flatnonzero(number)
    doc = np.searchsorted(block.offsets, at, "right") - 1
    own = at + 3 <= block.offsets[doc + 1]
    n = block.hi - block.lo
    pairs = np.unique(number[at[own]].astype(np.int64) * n + doc[own])
    number, doc = pairs // n, pairs % n
    cut = np.flatnonzero(np.diff(number)) + 1
    return {int(k[0]): d for k, d in zip(np.split(number, cut), np.split(doc, cut), strict=True) if len(k)}


def candidates(query: Query, index: dict[int, np.ndarray], grams: dict[bytes, int], n: int) -> np.ndarray:
    """Documents whose trigrams satisfy the query."""
    none = np.zeros(0, np.int64)
    found = []
    for every in query:
        lists = sorted((index.get(grams[g], none) for g in every), key=len)
        if not lists:
            return np.arange(n)
        docs = lists[0]
        for other in lists[1:]:
            docs = np.intersect1d(docs, other, assume_unique=True)
        found.append(docs)
    return np.unique(np.concatenate(found))


def _places(data: bytes, rule: Rule, regex: re.Pattern[bytes]) -> list[tuple[int, int]]:
    return [m.span() for m in regex.finditer(data) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def block_spans(block: Block, rules: tuple[Rule, ...]) -> list[list[tuple[int, int, int]]]:
    """Per document of the block: (start, rule number, end) of each match, in bytes, sorted."""
    regexes, queries, grams, place = _compiled(rules)
    n, raw, off = block.hi - block.lo, block.raw.tobytes(), block.offsets.tolist()
    index = postings(block, place)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    for k, (rule, regex, query) in enumerate(zip(rules, regexes, queries, strict=True)):
        for d in candidates(query, index, grams, n).tolist():
            out[d] += [(a, k, b) for a, b in _places(raw[off[d] : off[d + 1]], rule, regex)]
    return [sorted(x) for x in out]


def _in_characters(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte offsets as code points."""
    if not spans or text.isascii():
        return spans
    lead = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [(int(lead[a]), k, int(lead[b])) for a, k, b in spans]


def _run(rules: tuple[Rule, ...], per_doc: Callable[[bytes, list[tuple[int, int, int]]], tuple], types: list[pa.DataType], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for block in blocks(batch.column(1)):
                raw, off = block.raw.tobytes(), block.offsets.tolist()
                rows += [per_doc(raw[off[i] : off[i + 1]], s) for i, s in enumerate(block_spans(block, rules))]
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", *names])

    return run


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    spans lists all matches as kind:start:end (code points, end exclusive) by start, then kind as listed in
    rules; base_sha256 is the SHA-256 of the base kinds' part of that list. A null text counts as empty and
    gives zero counts. Keys may be null or repeat; other columns are not read.
    """
    base = [k for k, r in enumerate(rules) if r.base]

    def per_doc(text: bytes, spans: list[tuple[int, int, int]]) -> tuple:
        spans = _in_characters(text, spans)
        said = [f"{rules[k].kind}:{a}:{b}" for a, k, b in spans]
        own = ",".join(x for x, (_, k, _) in zip(said, spans, strict=True) if rules[k].base)
        counts = [sum(s[1] == k for s in spans) for k in base]
        return *counts, hashlib.sha256(own.encode()).hexdigest(), ",".join(said)

    names = [f"n_{rules[k].kind}" for k in base]
    run = _run(rules, per_doc, [pa.int64()] * len(base) + [pa.string()] * 2, [*names, "base_sha256", "spans"])
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return docs.mapInArrow(run, f"doc_id long, {''.join(f'{x} long, ' for x in names)}base_sha256 string, spans string")


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[{}]") -> DataFrame:
    """docs with each secret in text replaced by its kind in brackets; every row is kept.

    Overlapping matches are replaced as one, under the kind that starts first. Texts without a match, and
    null texts, come back as they are. n_chars, if there, follows the new text. Other columns are carried
    along, whatever their names.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, new = batch.column(at), {}
            for block in blocks(column):
                raw, off = block.raw.tobytes(), block.offsets.tolist()
                for i, spans in enumerate(block_spans(block, rules)):
                    if spans:
                        new[block.lo + i] = _replaced(raw[off[i] : off[i + 1]], spans)
            if new:
                values = column.to_pylist()
                for i, text in new.items():
                    values[i] = text
                batch = batch.set_column(at, batch.schema.field(at), pa.array(values, column.type))
            yield batch

    def _replaced(text: bytes, spans: list[tuple[int, int, int]]) -> str:
        out, done = [], 0
        for a, k, b in spans:
            if a >= done:
                out += [text[done:a], mark.format(rules[k].kind.upper()).encode()]
            done = max(done, b)
        return b"".join([*out, text[done:]]).decode("utf-8", "replace")

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
