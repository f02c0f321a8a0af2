"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints are sorted by Gray rank, so that neighbours in the order share long bit patterns. A node
of the index stands for a run of neighbours; it keeps the bits on which all of them agree. Upper nodes
factor the shared bits out: a child adds only the differences on bits that its parent has not fixed,
and a whole group is pruned as soon as the differences added up so far exceed the radius.

Over a cluster the sorted distinct fingerprints are range partitions, one index each. The partitions'
own shared patterns form the top of the index (one row per partition of a million fingerprints); each fingerprint visits the partitions that the top doesn't prune. Partitions link what
they hold into forests, and connected_components joins these.

For near copies by the similarity of their shingles, as in keep_dissimilar, a text gets a wide fingerprint whose tables
are indexed alike; pairs found are told by the whole fingerprint, or else verified on their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramaline.llm.textblock import U64, binary, mix
from tramaline.operators.graph import connected_components
from tramaline.session import cut

FAN_OUT = 8
#: Distinct fingerprints in one partition of the index, and the least number of partitions.
PER_PARTITION, LEAST_PARTITIONS = 1_000_000, 32
#: Near copies: words of a shingle and Jaccard similarity.
SHINGLE, SIMILARITY = 5, 0.8
#: A wide fingerprint has WORDS 64-bit words, read as TABLES codes of TABLE_BITS bits. Texts of similarity 0.8 differ
#: in 15 % of all bits: in a table in at most TABLE_RADIUS bits in 18 % of cases, in no table in 0.7 % of cases.
WORDS, TABLES, TABLE_BITS, TABLE_RADIUS = 11, 25, 28, 2
#: Of all 704 bits 107 differ on average at 0.8, with a deviation of 9.5. At most SURE: taken as near, as 1 in 1,000 of
#: pairs at 0.8 have so few. More than FAR: taken as not near, as 1 in 200 of them have so many. Between: verified.
SURE, FAR = 76, 132
#: Nodes in a block that are compared in one task, and in a part of a table.
PER_BLOCK, PER_TABLE = 1024, 250_000
_SALT = mix(np.arange(1, 8 * WORDS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))


def simhash(text: bytes, shingle: int = 3) -> int:
    """Fingerprint of one text: bit by bit, whether over half of its shingles' XXH64 have it set."""
    words = text.lower().split()
    if not words:
        return 0
    k = min(shingle, len(words))
    joined = map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False))
    h = np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(42)), U64, len(words) - k + 1)
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(U64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and fp (the fingerprint's 64 bits as a long) of each row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = binary(batch.column(1))
            data = data.tobytes()
            out = np.array([simhash(data[a:b], shingle) for a, b in zip(off, off[1:], strict=False)], U64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def gray_rank(fp: str) -> F.Column:
    """Place of a fingerprint in Gray-code order, as a long whose signed order is that order."""
    x = F.col(fp)
    for k in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, k))
    return x.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


class GrayIndex:
    """Levels of nodes over items in Gray order; an item stands for all words between its all and any bits."""

    def __init__(self, all_bits: np.ndarray, any_bits: np.ndarray):
        self.levels = []
        lo, hi = all_bits, any_bits
        while True:
            self.levels.append((lo, ~(lo ^ hi)))  # pattern and mask of the bits that the node's members share
            if len(lo) <= FAN_OUT:
                break
            at = np.arange(0, len(lo), FAN_OUT)
            lo, hi = np.bitwise_and.reduceat(lo, at), np.bitwise_or.reduceat(hi, at)

    def search(self, query: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, item) whose differences on shared bits are within the radius, some at a time."""
        for base in range(0, len(query), 2048):
            q = query[base : base + 2048]
            top, mask = self.levels[-1]
            who, node = np.repeat(np.arange(len(q)), len(top)), np.tile(np.arange(len(top)), len(q))
            diff = np.bitwise_count((q[who] ^ top[node]) & mask[node])
            stack = [(len(self.levels) - 1, who, node, diff)]
            while stack:
                level, who, node, diff = stack.pop()
                keep = diff <= radius
                who, node, diff = who[keep], node[keep], diff[keep]
                if not len(who):
                    continue
                if level == 0:
                    yield who + base, node
                    continue
                if len(who) > 1 << 17:  # bounds the memory of a search in dense groups
                    for lo in range(0, len(who), 1 << 17):
                        stack.append((level, who[lo : lo + (1 << 17)], node[lo : lo + (1 << 17)], diff[lo : lo + (1 << 17)]))
                    continue
                low, fixed = self.levels[level - 1]
                child = (node[:, None] * FAN_OUT + np.arange(FAN_OUT)).ravel()
                real = child < len(low)
                rest = np.repeat(~self.levels[level][1][node], FAN_OUT)[real]
                who, child = np.repeat(who, FAN_OUT)[real], child[real]
                diff = np.repeat(diff, FAN_OUT)[real] + np.bitwise_count((q[who] ^ low[child]) & fixed[child] & rest)
                stack.append((level - 1, who, child, diff))


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets that pairs a, b link; label[i] is the least member that i is known to be linked with."""
    while True:
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(up := label[label], label):
            label[:] = up


def _link(radius: int):
    """Of one partition, home rows first: its own fingerprints and those that visit it, to a forest of links.

    The home rows are indexed once and visitors stream through the index, so that a task holds no visitors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for home, visitors in partitions(batches):
            order = np.argsort(home.column("gray").to_numpy(), kind="stable")
            fp, root = home.column("fp").to_numpy()[order].view(U64), home.column("root").to_numpy()[order]
            index, label = GrayIndex(fp, fp), np.arange(len(fp))
            for who, item in index.search(fp, radius):
                merge(label, who, item)
            for batch in visitors:
                for who, item in index.search(batch.column("fp").to_numpy().view(U64), radius):
                    # each visitor joins the items that it finds, and is linked to one of them
                    _, first = np.unique(who, return_index=True)
                    own = np.zeros(len(batch), np.int64)
                    own[who[first]] = item[first]
                    merge(label, own[who], item)
                    yield _links(batch.column("root").to_numpy()[who[first]], root[item[first]])
            own = np.flatnonzero(label != np.arange(len(fp)))
            yield _links(root[own], root[label[own]])

    return run


def _links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def partitions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, Iterator[pa.RecordBatch]]]:
    """Home rows and a stream of visitors of each part, from rows sorted by part, home rows first."""
    pending: list[pa.RecordBatch] = []

    def pieces() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.column("part").to_numpy() * 2 + ~batch.column("home").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(kind)) + 1).tolist(), len(kind)]
            yield from (batch.slice(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:], strict=False) if hi > lo)

    stream = pieces()

    def following(part: int, home: bool) -> Iterator[pa.RecordBatch]:
        for piece in stream:
            if piece.column("part")[0].as_py() != part or piece.column("home")[0].as_py() != home:
                pending.append(piece)
                return
            yield piece

    while True:
        first = pending.pop() if pending else next(stream, None)
        if first is None:
            return
        part = first.column("part")[0].as_py()
        if not first.column("home")[0].as_py():
            continue  # visitors of a part without home rows find nothing
        home = pa.Table.from_batches([first, *following(part, True)]).combine_chunks()
        rest = pending.pop() if pending else None
        if rest is not None and rest.column("part")[0].as_py() != part:
            pending.append(rest)
            rest = None
        visitors = chain([rest], following(part, False)) if rest is not None else iter(())
        yield home, visitors
        for _ in visitors:
            pass


def near_links(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """Forest of links a, b (roots) among distinct fingerprints: nodes has fp and root.

    Two fingerprints within the radius end in one tree of the links. Work in a partition follows the
    number of its nodes and true neighbours; rows out are at most one per node and partition visited.
    """
    # few, large partitions: a fingerprint visits more of them the more there are
    parts = max(LEAST_PARTITIONS, -(-nodes.count() // PER_PARTITION))
    sorted_nodes = nodes.select(gray_rank("fp").alias("gray"), "fp", "root").repartitionByRange(parts, "gray")
    sorted_nodes = cut(sorted_nodes.select(F.spark_partition_id().alias("part"), "gray", "fp", "root"), "gray")
    # one row per partition: bound by the number of partitions, not by the data
    top = sorted(sorted_nodes.groupBy("part").agg(F.bit_and("fp"), F.bit_or("fp")).collect())
    ids = np.array([r[0] for r in top], np.int32)
    low, high = (np.array([r[i] for r in top], np.int64).view(U64) for i in (1, 2))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = GrayIndex(low, high)
        for batch in batches:
            part, fp = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for who, item in index.search(fp.view(U64), radius):
                later = ids[item] >= part[who]  # each pair of partitions meets once
                who, item = who[later], item[later]
                take = pa.array(who)
                yield pa.RecordBatch.from_arrays([pa.array(ids[item]), pa.array(ids[item] == part[who]), *(batch.column(i).take(take) for i in (1, 2, 3))], ["part", "home", "gray", "fp", "root"])

    routed = sorted_nodes.mapInArrow(route, "part int, home boolean, gray long, fp long, root long")
    return routed.repartition(parts, "part").sortWithinPartitions("part", F.desc("home")).mapInArrow(_link(radius), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fp (long) and component_id, the least doc_id linked with it.

    Texts link when their SimHash fingerprints differ in at most `radius` bits, and through others.
    Null text counts as empty; a text without words has fingerprint zero. A row whose key is null has
    a fingerprint, but takes part in links only if another row with the same fingerprint has a key;
    else its component is null. Repeated rows stay. Other columns are not read. An empty table gives
    an empty result.
    """
    fps = cut(fingerprints(docs, shingle, key, text), "simhash")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("root"))
    links = near_links(nodes.where("root is not null"), radius)
    parts = connected_components(links, "a", "b")
    named = nodes.join(parts, nodes.root == parts.node, "left").select("fp", F.coalesce("component", "root").alias("component_id"))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: str = "fp") -> F.Column:
    """A 64-bit fingerprint as 16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """docs without near duplicates: of each component the row with the least doc_id stays, with all its columns.

    Of rows that repeat one doc_id, one stays. Rows without a doc_id can't be named as copies and stay.
    """
    near = cut(near_duplicates(docs.select("doc_id", "text"), shingle, radius), "components")
    kept = near.where("doc_id = component_id").select("doc_id").distinct()
    out = docs.join(kept, "doc_id", "left_semi")
    n = near.where("doc_id is not null").agg(F.count("*"), F.countDistinct("doc_id")).first()
    if n[0] != n[1]:
        out = out.dropDuplicates(["doc_id"])
    if n[0] != near.count():
        out = out.unionByName(docs.where("doc_id is null"))
    return out.select(*docs.columns)


def shingles(text: bytes, k: int = SHINGLE) -> set[bytes]:
    """Runs of k words, lower-cased; of fewer words, the one run of all; of none, nothing."""
    words = text.lower().split()
    if not words:
        return set()
    k = min(k, len(words))
    return set(map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False)))


def wide(hashes: np.ndarray) -> np.ndarray:
    """A fingerprint of WORDS words from the hashes of distinct shingles.

    Bit by bit, whether the mean over all shingles of a number in 0..255 is above the middle. Numbers, not bits,
    so that the difference of small sets, too, follows their similarity.
    """
    total = np.zeros(64 * WORDS, np.int64)
    for lo in range(0, len(hashes), 255):
        total += mix(hashes[lo : lo + 255, None] ^ _SALT).view(np.uint8).sum(0, dtype=np.uint16)
    return np.packbits(2 * total > 255 * len(hashes), bitorder="little").view(U64)


def wide_fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, the identity of its set of shingles (128 bits) and its wide fingerprint; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = binary(batch.column(1))
            data, same, prints = data.tobytes(), [], []
            for a, b in zip(off, off[1:], strict=False):
                own = shingles(data[a:b], shingle)
                h = np.sort(np.fromiter(map(xxhash.xxh64_intdigest, own), U64, len(own)))
                same.append(xxhash.xxh128_digest(h.tobytes()))
                prints.append(wide(h).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same, pa.binary()), pa.array(prints, pa.binary())], ["doc_id", "same", "print"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, same binary, print binary")


def _prints(column: pa.Array) -> np.ndarray:
    data, off = binary(column)
    return data[off[0] : off[-1]].view(U64).reshape(-1, WORDS) if len(column) else np.zeros((0, WORDS), U64)


def table_codes(prints: np.ndarray) -> np.ndarray:
    """Of each wide fingerprint, its TABLES windows of TABLE_BITS bits."""
    bits = np.unpackbits(prints.view(np.uint8), axis=1, bitorder="little")[:, : TABLES * TABLE_BITS].reshape(-1, TABLES, TABLE_BITS)
    whole = np.zeros((len(prints), TABLES, 32), np.uint8)
    whole[:, :, :TABLE_BITS] = bits
    return np.packbits(whole, axis=2, bitorder="little").view(np.uint32)[:, :, 0]


def gray_order(codes: np.ndarray) -> np.ndarray:
    """Places that sort codes by Gray rank."""
    x = codes.copy()
    for k in (1, 2, 4, 8, 16, 32):
        x ^= x >> U64(k)
    return np.argsort(x, kind="stable")


def _tables(prefix: int):
    """Rows (part, home, code, root, print) of each node in each table; a part is a table and the code's first bits.

    A node visits the parts whose first bits differ in at most TABLE_RADIUS, those of greater number only, so that
    each pair of parts meets once.
    """
    near = [np.array([v], np.int64) for v in range(1 << prefix)]
    for v in range(1 << prefix):
        near[v] = np.array([u for u in range(v, 1 << prefix) if (u ^ v).bit_count() <= TABLE_RADIUS], np.int64)
    most = max(map(len, near))
    padded = np.array([np.concatenate([x, np.full(most - len(x), -1)]) for x in near])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), 1024):
                batch = whole.slice(lo, 1024)
                codes = table_codes(_prints(batch.column("print")))
                first = (codes >> np.uint32(TABLE_BITS - prefix)).astype(np.int64)
                to = padded[first]  # node, table, visit
                node, table, visit = np.nonzero(to >= 0)
                v = to[node, table, visit]
                cols = [(table << prefix | v).astype(np.int32), v == first[node, table], codes[node, table].astype(np.int64)]
                take = pa.array(node)
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), batch.column("root").take(take), batch.column("print").take(take)], ["part", "home", "code", "root", "print"])

    return run


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two forests of links a, b among nodes that one table finds: of pairs that are near for certain (sure), and, as
    far as these don't join them, of pairs that may be near."""
    for home, visitors in partitions(batches):
        code = home.column("code").to_numpy().view(U64)
        order = gray_order(code)
        code, root, prints = code[order], home.column("root").to_numpy()[order], _prints(home.column("print").combine_chunks())[order]
        index, label = GrayIndex(code, code), np.arange(len(code))
        may = np.arange(len(code))
        for who, item in _some(index.search(code, TABLE_RADIUS)):
            own = (who < item) & (label[who] != label[item])
            who, item = who[own], item[own]
            d = np.bitwise_count(prints[who] ^ prints[item]).sum(1)
            merge(label, who[d <= SURE], item[d <= SURE])
            merge(may, who[d <= FAR], item[d <= FAR])
        for known, sure in ((label, True), (may, False)):
            own = np.flatnonzero((known != np.arange(len(code))) & (sure | (label != label[known])))
            yield _pairs(root[own], root[known[own]], sure)
        for batch in visitors:
            theirs, names = _prints(batch.column("print")), batch.column("root").to_numpy()
            for who, item in _some(index.search(batch.column("code").to_numpy().view(U64), TABLE_RADIUS)):
                d = np.bitwise_count(theirs[who] ^ prints[item]).sum(1)
                for near, known, sure in ((d <= SURE, label, True), ((d > SURE) & (d <= FAR), may, False)):
                    own = np.flatnonzero(near)
                    # one link for each tree of the forest
                    _, once = np.unique(np.stack([who[own], known[item[own]]]), axis=1, return_index=True)
                    yield _pairs(names[who[own[once]]], root[item[own[once]]], sure)


def _some(found: Iterator[tuple[np.ndarray, np.ndarray]], most: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """What is found, at most so many pairs at a time."""
    for who, item in found:
        for lo in range(0, len(who), most):
            yield who[lo : lo + most], item[lo : lo + most]


def _pairs(a: np.ndarray, b: np.ndarray, sure: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), sure))], ["a", "b", "sure"])


def _verify(shingle: int, similarity: float):
    """Of two blocks of a cluster's nodes, sorted by cluster and blocks: links between components, verified on texts.

    A pair of nodes of different components is held against its similarity if its fingerprints allow for it, nearest
    first, unless other links have joined the two by then.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != at and held:
                    yield links(held)
                    held = []
                at = row[:3]
                held.append(row[3:])
        if held:
            yield links(held)

    def links(rows: list[tuple]) -> pa.RecordBatch:
        block, component, prints, texts = zip(*rows, strict=True)
        block, prints, sets = np.array(block), _prints(pa.array(prints, pa.binary())), {}
        names, own = np.unique(np.array(component, np.int64), return_inverse=True)
        label = np.arange(len(names))
        found: list[tuple[int, int]] = []
        crossed = len(np.unique(block)) > 1  # pairs within a block are those of another task
        for x in range(len(block)):
            d = np.bitwise_count(prints[x + 1 :] ^ prints[x]).sum(1)
            near = np.flatnonzero((d <= FAR) & (label[own[x + 1 :]] != label[own[x]]) & ((block[x + 1 :] != block[x]) | (not crossed)))
            for y in (near[np.argsort(d[near], kind="stable")] + x + 1).tolist():
                if label[own[x]] == label[own[y]]:
                    continue
                for k in (x, y):
                    if k not in sets:
                        sets[k] = shingles(texts[k], shingle)
                a, b = sets[x], sets[y]
                if min(len(a), len(b)) >= similarity * max(len(a), len(b)) - 1e-6 and (both := len(a & b)) / (len(a) + len(b) - both) >= similarity:
                    found.append((own[x], own[y]))
                    merge(label, own[[x]], own[[y]])
        a, b = (names[np.array(k, np.int64)] for k in (zip(*found, strict=True) if found else ((), ())))
        return _links(a, b)

    return run


def similar_links(nodes: DataFrame, docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Links a, b among nodes (root, print), whose components are those of all pairs with the similarity.

    docs has the text of each root. Pairs that are near for certain join nodes into components, and pairs that may be
    near join these into clusters. Of a cluster with one component no text is read. Others are cut into blocks of
    PER_BLOCK nodes; each two blocks meet in one task. Work is quadratic in the nodes of such a cluster only.
    """
    spark = nodes.sparkSession
    n = nodes.count()
    prefix = min(10, max(0, (-(-n // PER_TABLE) - 1).bit_length()))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), TABLES)
    rows = nodes.mapInArrow(_tables(prefix), "part int, home boolean, code long, root long, print binary")
    rows = rows.repartition(parts, "part").sortWithinPartitions("part", F.desc("home"))
    found = cut(rows.mapInArrow(_close, "a long, b long, sure boolean"), "pairs")
    links = found.where("sure").select("a", "b")
    components = cut(connected_components(links, "a", "b"), "components")
    doubtful = found.where("not sure").select("a", "b")
    for x in ("a", "b"):
        named = components.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
        doubtful = doubtful.join(named, x, "left").withColumn(x, F.coalesce(f"c{x}", x)).select("a", "b")
    clusters = connected_components(cut(doubtful.where("a <> b").distinct(), "doubtful"), "a", "b")
    clusters = cut(clusters.select(F.col("node").alias("c"), F.col("component").alias("cluster")), "clusters")
    named = components.select(F.col("node").alias("root"), "component")
    members = nodes.join(named, "root", "left").withColumn("c", F.coalesce("component", "root")).join(clusters, "c")
    members = cut(members.select("cluster", "c", "root", "print"), "clustered")
    blocks_of = members.groupBy("cluster").agg(F.expr(f"1 + (count(*) - 1) div {PER_BLOCK}").alias("n"))
    dealt = members.join(blocks_of, "cluster").withColumn("block", F.expr("pmod(xxhash64(root), n)"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    dealt = dealt.select("cluster", "c", "root", "print", "block", other.alias("other"))
    dealt = dealt.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "c", "print", "root")
    texts = docs.select(F.col("doc_id").cast("long").alias("root"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    rows = dealt.join(texts, "root").select("cluster", "i", "j", "block", "c", "print", "text")
    rows = rows.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    verified = cut(rows.mapInArrow(_verify(shingle, similarity), "a long, b long"), "verified")
    return links.union(verified)


def keep_dissimilar(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """docs without near copies: of each component the row with the least doc_id stays, with all its columns.

    Texts link when the Jaccard similarity of their sets of shingles is at least `similarity` (0.8 or more, for
    which the tables are made), and through others. Texts without words are copies of each other; null counts as
    empty. Of rows that repeat one doc_id, one stays. Rows without a doc_id can't be named as copies and stay.
    """
    named, n = docs.where("doc_id is not null"), docs.agg(F.count("*"), F.count("doc_id"), F.countDistinct("doc_id")).first()
    if n[1] != n[2]:
        named = cut(named.dropDuplicates(["doc_id"]), "once")  # written, as the row that stays may be any
    prints = cut(wide_fingerprints(named.select("doc_id", "text"), shingle), "prints")
    # equal sets have equal fingerprints, so any row's will do
    nodes = cut(prints.groupBy("same").agg(F.min("doc_id").alias("root"), F.any_value("print").alias("print")).select("root", "print"), "nodes")
    links = similar_links(nodes, named, shingle, similarity)
    copies = connected_components(links, "a", "b").where("node <> component").select(F.col("node").alias("root"))
    kept = cut(nodes.select("root").join(copies, "root", "left_anti"), "kept")
    out = named.join(kept.withColumnRenamed("root", "doc_id"), "doc_id", "left_semi")
    if n[0] != n[1]:
        out = out.unionByName(docs.where("doc_id is null"))
    return out.select(*docs.columns)
