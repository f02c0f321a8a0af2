"""Sharding into pieces of near equal bytes by histogram sort, with DataFrame functions only.

Rows are ordered by a key of three numbers (hashes of the text, doc_id, other columns), so that equal texts are
neighbours. Splitters are found by counting: a pass over the rows counts exact bytes and rows between candidate
boundaries (probes) in all partitions; where no boundary is within the tolerance of a shard's ideal end, the next pass
puts new probes between the two about that end. Then all rows are exchanged once, each to the piece that its key is in.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from dataclasses import dataclass, field
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tramaline.session import cut, discard

SHARDS = 40
#: How far a splitter may be from its ideal place before probes are refined: for shards in bytes of a shard, for the
#: ends of the pieces within a shard in bytes of a piece.
TOLERANCE, LOOSE = 0.01, 0.25
#: Probes between the two boundaries about a splitter in a pass; in the first pass, at least.
PROBES, FIRST_PROBES = 64, 4096
#: Bytes of a row besides its text. Copies of one row that a list names at most.
HEAD, RUN = 16, 4096
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
_KEY = ("h", "d", "r")


@dataclass(frozen=True)
class Splitter:
    """Where a piece begins: a key, the copy among rows of that key, and the exact bytes and rows before it."""

    key: tuple[int, ...]
    copy: int
    n_bytes: int
    n_rows: int


@dataclass
class Cell:
    """Rows whose first components of the key are fixed and the next is from low to high; what is below and in it."""

    fixed: tuple[int, ...]
    low: int
    high: int
    before: tuple[int, int]
    n_bytes: int
    n_rows: int
    targets: list[int] = field(default_factory=list)

    @classmethod
    def of(cls, found: Row, before: tuple[int, int]) -> Cell:
        """Of counted rows, known by the least and greatest of each component: what they have in common is fixed."""
        fixed = [found[f"low_{c}"] for c in _KEY]
        varies = next((i for i, c in enumerate(_KEY) if found[f"low_{c}"] != found[f"high_{c}"]), len(_KEY))
        c = _KEY[min(varies, len(_KEY) - 1)]
        return cls(tuple(fixed[: min(varies, len(_KEY) - 1)]), found[f"low_{c}"], found[f"high_{c}"], before, found["n_bytes"], found["n_rows"])

    def alike(self) -> bool:
        """Nothing in the key tells these rows apart."""
        return self.low == self.high

    def bound(self, value: int, rest: int) -> tuple[int, ...]:
        return (*self.fixed, value, *[rest] * (len(_KEY) - 1 - len(self.fixed)))

    def shift(self) -> int:
        """By so many bits values are shortened, as the difference of two longs may not fit a long."""
        return 0 if self.high - self.low < 1 << 62 else 2

    def width(self, probes: int) -> int:
        return -(-((self.high >> self.shift()) - (self.low >> self.shift()) + 1) // probes)


def text_size() -> Column:
    """UTF-8 bytes of the text, and HEAD; of a null text HEAD."""
    return (F.coalesce(F.octet_length("text"), F.lit(0)) + HEAD).cast("long")


def key_columns(docs: DataFrame) -> dict[str, Column]:
    """h: a hash of the text, null counting as empty; d: doc_id, null as the least; r: a hash of all else that a row has."""
    rest = [F.col("doc_id").isNull(), F.col("text").isNull()]
    for f in docs.schema:
        if f.name not in ("text", "doc_id"):
            name = "`" + f.name.replace("`", "``") + "`"
            odd = any(kind in f.dataType.simpleString() for kind in ("map<", "variant"))
            rest.append(F.to_json(F.struct(name)) if odd else F.col(name))
    return {"h": F.xxhash64(F.coalesce("text", F.lit(""))), "d": F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)), "r": F.xxhash64(*rest)}


def _constant(rows: list[tuple[int, ...]]) -> Column:
    """Rows of numbers as a constant array of structs k0, k1, ..., read from one literal."""
    n = len(rows[0])
    text = json.dumps([{f"k{i}": x for i, x in enumerate(r)} for r in rows])
    return F.from_json(F.lit(text), f"array<struct<{', '.join(f'k{i}: bigint' for i in range(n))}>>")


def _rank(key: Column, ascending: list[tuple[int, ...]]) -> Column:
    """How many of some ascending rows of numbers aren't above the struct key, by halving."""
    rows = _constant(ascending)

    def halve(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["low"] + s["high"], 1)
        up = F.get(rows, mid) <= key
        return F.struct(F.when(up, F.least(mid + 1, s["high"])).otherwise(s["low"]).alias("low"), F.when(up, s["high"]).otherwise(mid).alias("high"))

    begin = F.struct(F.lit(0).alias("low"), F.lit(len(ascending)).alias("high"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(ascending).bit_length())), begin, halve, lambda s: s["low"])


def _extremes() -> list[Column]:
    return [F.sum("size").alias("n_bytes"), F.count("*").alias("n_rows"), *(f(c).alias(f"{n}_{c}") for c in _KEY for f, n in ((F.min, "low"), (F.max, "high")))]


def _counted(keys: DataFrame, cells: list[Cell], probes: int) -> list[list[Row]]:
    """The rows of each cell, counted between its probes; probes without rows are left out.

    Sums are made within each partition before they are sent; the driver gets as many rows as there are probes at most.
    """
    own = F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(_KEY)))
    cell = F.get(_constant([(*c.bound(c.high, _MOST), len(c.fixed), c.low >> c.shift(), c.shift(), c.width(probes)) for c in cells]), F.col("cell"))
    last = F.struct(*(F.col("of")[f"k{i}"].alias(f"k{i}") for i in range(3)))
    inside = keys.withColumn("cell", _rank(own, [c.bound(c.low, _LEAST) for c in cells]) - 1).where("cell >= 0").withColumn("of", cell).where(own <= last)
    value = F.call_function("shiftright", F.get(F.array(*_KEY), F.col("of")["k3"].cast("int")), F.col("of")["k5"].cast("int"))
    probe = F.call_function("div", value - F.col("of")["k4"], F.col("of")["k6"])
    out: list[list[Row]] = [[] for _ in cells]
    for r in inside.groupBy("cell", probe.alias("probe")).agg(*_extremes()).collect():
        out[r["cell"]].append(r)
    return [sorted(found, key=lambda r: r["probe"]) for found in out]


def splitters(keys: DataFrame, targets: list[tuple[int, float]]) -> list[Splitter]:
    """For each (ideal bytes before, tolerance), ascending: a boundary of rows within the tolerance, or the nearest there is.

    keys has longs h, d, r and size. A boundary between texts is taken where one is within the tolerance; else rows of
    a text are parted by doc_id, then by their other columns, and equal rows by number. A pass narrows an interval to a
    PROBES-th part at most or goes on to the next component: two to four passes as a rule, some thirty at worst.
    """
    total = keys.agg(*_extremes()).first()
    if not total["n_rows"]:
        return []
    found: dict[int, Splitter] = {}
    cells, probes = [Cell.of(total, (0, 0))], max(FIRST_PROBES, 16 * len(targets))
    cells[0].targets = list(range(len(targets)))
    while cells:
        narrower = []
        for cell, counts in zip(cells, [[]] if cells[0].alike() and len(cells) == 1 else _counted(keys, cells, probes), strict=True):
            narrower += _narrowed(cell, counts, targets, found)
        cells, probes = narrower, PROBES
    return [found[t] for t in range(len(targets))]


def _narrowed(cell: Cell, counts: list[Row], targets: list[tuple[int, float]], found: dict[int, Splitter]) -> list[Cell]:
    """Splitters that a cell's counts decide go to found; the cells between probes where the others are."""
    if cell.alike():
        for t in cell.targets:
            found[t] = _copy(cell, targets[t][0])
        return []
    n_bytes = list(accumulate((r["n_bytes"] for r in counts), initial=cell.before[0]))
    n_rows = list(accumulate((r["n_rows"] for r in counts), initial=cell.before[1]))
    inner: dict[int, Cell] = {}
    for t in cell.targets:
        ideal, tolerance = targets[t]
        j = min(max(bisect_right(n_bytes, ideal) - 1, 0), len(counts) - 1)
        near = j + (n_bytes[j + 1] - ideal < ideal - n_bytes[j])
        if abs(n_bytes[near] - ideal) <= tolerance or counts[j]["n_rows"] == 1:
            c = _KEY[len(cell.fixed)]
            key, copy = (cell.bound(counts[near][f"low_{c}"], _LEAST), 0) if near < len(counts) else (cell.bound(cell.high, _MOST), _MOST)
            found[t] = Splitter(key, copy, n_bytes[near], n_rows[near])
        else:
            inner.setdefault(j, Cell.of(counts[j], (n_bytes[j], n_rows[j]))).targets.append(t)
    return [inner[j] for j in sorted(inner)]


def _copy(cell: Cell, ideal: int) -> Splitter:
    """The nearest boundary among equal rows."""
    size = cell.n_bytes // cell.n_rows
    copy = min(max(round((ideal - cell.before[0]) / size), 0), cell.n_rows) if size else 0
    return Splitter(cell.bound(cell.low, 0), copy, cell.before[0] + copy * size, cell.before[1] + copy)


def shard(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, pieces: int | None = None) -> DataFrame:
    """docs with size, shard and slot: shards of near equal bytes, in the order of the key; slots count from 0 without gaps.

    size is the text's UTF-8 bytes and HEAD. A shard begins within tolerance of its ideal place, or at the nearest
    boundary of rows where the row there is larger than that. Equal texts are neighbours and in one shard, unless a
    shard begins among them as no boundary beside them is within the tolerance: a text with a third of all rows is
    spread over a third of the shards. A shard is sorted in pieces, about as many in all as shuffle partitions, each of near equal
    bytes too, so that no task holds a shard. Columns size, shard and slot of docs are replaced; all others stay.

    Null texts count as empty and as copies of empty ones, null doc_ids come first; rows that are equal in all columns are numbered
    where a splitter falls among them. Equal in all means: in three 64-bit hashes. Fewer rows than shards leave some
    shards empty. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    columns = [c for c in docs.columns if c not in ("size", "shard", "slot")]
    docs = docs.select(*columns)
    key, copy, piece = (_free(columns, x) for x in ("key", "copy", "piece"))
    names = key_columns(docs)
    per_shard = pieces or -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // shards)
    keys = cut(docs.select(*(c.alias(n) for n, c in names.items()), text_size().alias("size")), "keys")
    total, n = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0], shards * per_shard
    targets = [(total * i // n, total / n * (LOOSE if i % per_shard else tolerance * per_shard)) for i in range(1, n)]
    found = sorted(splitters(keys, targets), key=lambda s: (s.key, s.copy))
    discard(keys)
    rows = docs.select(*columns, text_size().alias("size"), F.struct(*(c.alias(f"k{i}") for i, c in enumerate(names.values()))).alias(key))
    if not found:
        return rows.select(*columns, "size", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    rows = _numbered(rows, key, copy, sorted({s.key for s in found if 0 < s.copy < _MOST}))
    whole = F.struct(*(F.col(key)[f"k{i}"].alias(f"k{i}") for i in range(3)), F.col(copy).alias("k3"))
    rows = rows.withColumn(piece, _rank(whole, [(*s.key, s.copy) for s in found]))
    starts = [0, *(s.n_rows for s in found)]
    before = F.get(_constant([(starts[i] - starts[i // per_shard * per_shard],) for i in range(n)]), F.col(piece))["k0"]
    slot = F.row_number().over(Window.partitionBy(piece).orderBy(key, copy)) - 1 + before
    return rows.repartitionById(n, F.col(piece)).select(*columns, "size", F.floor(F.col(piece) / per_shard).cast("int").alias("shard"), slot.alias("slot"))


def _numbered(rows: DataFrame, key: str, copy: str, split: list[tuple[int, ...]]) -> DataFrame:
    """rows with the column copy: 0, but where a splitter falls among rows of a key these are counted and numbered."""
    plain = rows.withColumn(copy, F.lit(0).cast("long"))
    if not split:
        return plain
    among = F.array_contains(_constant(split), F.col(key))
    runs = rows.where(among).groupBy(key).agg(F.count("*").alias(copy), F.first(F.struct(*(c for c in rows.columns if c != key))).alias("row"))
    # in runs of RUN copies that are dealt out first, as one task can't write all copies of a frequent row
    runs = runs.select(key, "row", F.col(copy).alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("div", F.col(copy) - 1, F.lit(RUN).cast("long")))).alias(copy))
    runs = runs.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key, copy)
    copies = runs.select(key, "row", F.explode(F.sequence(F.col(copy) * RUN, F.least((F.col(copy) + 1) * RUN, F.col("n")) - 1)).alias(copy))
    return plain.where(~among).unionByName(copies.select(*(F.col("row")[c].alias(c) for c in rows.columns if c != key), key, copy))


def _free(columns: list[str], name: str) -> str:
    """A column name that isn't taken."""
    while name in columns or name in ("size", "shard", "slot"):
        name += "_"
    return name
