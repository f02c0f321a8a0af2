"""Keyed state with timers: payments that settle, bounds per page, digests of errors, exact sliding counts.

Each operator takes a stream with a watermark on its time column and appends rows as they become sure. Rows of a key go
in order of time within a batch; the same rows in several batches give the same result if no row comes after one of a
later time. State is kept by RocksDB, and a timer drops what nothing can need any more.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from datetime import timedelta

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SECOND = 10**6
HOUR = 3600 * SECOND


def keyed(stream: DataFrame, keys: list[str], processor: Timed, out: str) -> DataFrame:
    """keys and the columns `out` of the processor's rows; stream has the columns that the processor reads."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # the only one with timers
    schema = ", ".join(f"`{k}` {stream.schema[k].dataType.simpleString()}" for k in keys)
    processor.columns = [*keys, *(c.split()[0] for c in out.split(","))]
    return stream.groupBy(*keys).transformWithState(processor, f"{schema}, {out}", "append", "eventTime")


class Timed(StatefulProcessor):
    """A processor with one timer per key, moved at will. Times are microseconds since the epoch."""

    columns: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.timer = handle.getValueState("timer", "ms long")

    def wake(self, micros: int | None) -> None:
        """Have the key's timer at this time instead of when it was set for; None: not at all."""
        old, new = self.timer.get()[0] if self.timer.exists() else None, None if micros is None else -(-micros // 1000)
        if old == new:
            return
        if old is not None:
            self.handle.deleteTimer(old)
        if new is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(new)
            self.timer.update((new,))

    def row(self, key: tuple, *values) -> Row:
        return Row(**dict(zip(self.columns, (*key, *values), strict=True)))

    def close(self) -> None:
        pass


class _Settlement(Timed):
    def __init__(self, pending: str, credit: str, keep: int):
        self.pending, self.credit, self.keep = pending, credit, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("payment", "settled boolean, last long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        settled, last = self.state.get() if self.state.exists() else (False, None)
        for at, _, status in sorted((r.at, r.n, r.status) for r in rows):
            if last is not None and at > last + self.keep:  # its timer would have gone off before this row
                if not settled:
                    yield self.row(key, last, self.pending, False)
                settled = False
            last = max(last or at, at)
            if status != self.pending and not settled:
                settled = True
                yield self.row(key, at, status, status == self.credit)
        self.state.update((settled, last))
        self.wake(last + self.keep)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        settled, last = self.state.get()
        if not settled:
            yield self.row(key, last, self.pending, False)
        self.state.clear()
        self.timer.clear()


def settled_payments(stream: DataFrame, key: str, status: str, order: str, time: str = "ts", pending: str = "PENDING", credit: str = "SUCCESSFUL", keep: timedelta = timedelta(days=2)) -> DataFrame:
    """key, ts, status, credited: one row per payment, when its first terminal status comes, or when it is given up.

    A status other than pending is terminal and stays, whatever follows; it wins over pending ones in any order, and a
    repeated notice gives no second row: credited is true once at most. A payment without news for `keep` is given
    up: its state goes, and if it was still pending it is given as that; what comes later is a payment anew. A null status counts as pending.
    """
    rows = stream.select(key, time, F.unix_micros(time).alias("at"), F.col(order).alias("n"), F.coalesce(F.col(status), F.lit(pending)).alias("status"))
    out = keyed(rows, [key], _Settlement(pending, credit, _micros(keep)), "at long, status string, credited boolean")
    return out.select(key, F.timestamp_micros("at").alias("ts"), "status", "credited")


class _PageBounds(Timed):
    def __init__(self, bounds: dict[str, int], idle: int, pages: int):
        self.kinds, self.bounds, self.idle, self.pages = list(bounds), list(bounds.values()), idle, pages

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.seen = handle.getMapState("pages", "page string", "used array<long>, seen long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        # a key's pages are held for the length of a batch: `pages` at most
        pages = {k[0]: (list(v[0]), v[1]) for k, v in self.seen.iterator()} if self.seen.exists() else {}
        before, newest = dict(pages), 0
        for at, n, page, kind, amount in _Calls(rows):
            newest = max(newest, at)
            used, seen = pages.get(page, ([0] * len(self.kinds), None))
            if seen is None or at - seen > self.idle:
                used = [0] * len(self.kinds)
                self.make_room(pages, page, at)
            i = self.kinds.index(kind) if kind in self.kinds else None
            refused = i is not None and used[i] >= self.bounds[i]
            if not refused:
                pages[page] = ([u + amount * (k == i) for k, u in enumerate(used)], at)
            yield self.row(key, n, kind if refused else None)
        pages = {p: v for p, v in pages.items() if newest - v[1] <= self.idle}
        for p in before.keys() - pages.keys():
            self.seen.removeKey((p,))
        for p, v in pages.items():
            if before.get(p) != v:
                self.seen.updateValue((p,), v)
        self.wake(newest + self.idle + 1)

    def make_room(self, pages: dict, page: str, at: int) -> None:
        """A new page comes: forgotten ones go, and the longest unseen where there are still too many."""
        for p in [p for p, v in pages.items() if at - v[1] > self.idle or p == page]:
            del pages[p]
        while len(pages) >= self.pages:
            del pages[min(pages, key=lambda p: (pages[p][1], p))]

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        self.seen.clear()
        self.timer.clear()
        yield from ()


class _Calls:
    """A batch's calls of one key in order of (at, n, page, kind, amount), held as numbers instead of a tuple each."""

    def __init__(self, rows: Iterator[Row]):
        self.at, self.amount, self.pages, self.kinds = (array("q") for _ in range(4))
        self.ns: array | list = array("q")
        self.names: dict[str, int] = {}
        for r in rows:
            if isinstance(self.ns, array) and type(r.n) is not int:
                self.ns = self.ns.tolist()
            self.at.append(r.at)
            self.amount.append(r.amount)
            self.pages.append(self.names.setdefault(r.page, len(self.names)))
            self.kinds.append(self.names.setdefault(r.kind, len(self.names)))
            self.ns.append(r.n)

    def __iter__(self) -> Iterator[tuple]:
        of = lambda x: np.frombuffer(x, np.int64)
        names = list(self.names)
        rank = np.argsort(np.array(sorted(range(len(names)), key=names.__getitem__), np.int64))
        n = of(self.ns) if isinstance(self.ns, array) else self.ranked()
        order = np.lexsort((of(self.amount), rank[of(self.kinds)], rank[of(self.pages)], n, of(self.at)))
        for i in map(int, order):
            yield self.at[i], self.ns[i], names[self.pages[i]], names[self.kinds[i]], self.amount[i]

    def ranked(self) -> np.ndarray:
        """Places of what isn't a whole number, null first."""
        place = {x: i for i, x in enumerate(sorted(set(self.ns), key=lambda x: (x is not None, x)))}
        return np.array([place[x] for x in self.ns], np.int64)


#: What a page may ask for while it is open: batches of texts, analyses of images, captures of video.
BOUNDS = {"batch": 100, "analysis": 120, "capture": 20}


def page_bounds(stream: DataFrame, user: str, page: str, kind: str, order: str, amount: str | None = None, time: str = "ts", bounds: dict[str, int] | None = None, idle: timedelta = timedelta(hours=6), pages: int = 50_000) -> DataFrame:
    """user, order, refused: for each call the bound that the page had reached, or null; refused calls don't count.

    A page that had no call that was let through for longer than `idle` begins anew. A user has so many `pages` at
    most; the one that is unseen for longest makes room for a new one. Kinds that bounds doesn't name aren't bounded.
    A null page is one page. State of a user goes once all its pages are forgotten.
    """
    n = F.lit(1) if amount is None else F.coalesce(F.col(amount), F.lit(0))
    rows = stream.select(user, time, F.unix_micros(time).alias("at"), F.col(order).alias("n"), F.coalesce(F.col(page).cast("string"), F.lit("")).alias("page"), F.coalesce(F.col(kind), F.lit("")).alias("kind"), n.cast("long").alias("amount"))
    out = keyed(rows, [user], _PageBounds(bounds or BOUNDS, _micros(idle), pages), f"n {stream.schema[order].dataType.simpleString()}, refused string")
    return out.select(user, F.col("n").alias(order), "refused")


class _Digest(Timed):
    def __init__(self, pause: int, top: int):
        self.pause, self.top = pause, top

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.sent = handle.getValueState("sent", "at long")
        self.held = handle.getMapState("held", "fingerprint string", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        sent = self.sent.get()[0] if self.sent.exists() else None
        held = {k[0]: v[0] for k, v in self.held.iterator()} if self.held.exists() else {}
        for at, fingerprint in sorted((r.at, r.fingerprint) for r in rows):
            while sent is not None and at >= sent + self.pause:
                sent = sent + self.pause if held else None
                if held:
                    yield self.digest(key, sent, held)
                    held = {}
            if sent is None:
                sent = at
                yield self.digest(key, at, {fingerprint: 1})
            else:
                held[fingerprint] = held.get(fingerprint, 0) + 1
        self.keep(sent, held)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        sent, held = self.sent.get()[0] + self.pause, {k[0]: v[0] for k, v in self.held.iterator()} if self.held.exists() else {}
        self.timer.clear()
        if held:
            yield self.digest(key, sent, held)
        self.keep(sent if held else None, {})

    def digest(self, key: tuple, at: int, held: dict[str, int]) -> Row:
        first = sorted(held.items(), key=lambda x: (-x[1], x[0]))[: self.top]
        return self.row(key, at, sum(held.values()), ",".join(f"{k}:{n}" for k, n in first))

    def keep(self, sent: int | None, held: dict[str, int]) -> None:
        self.held.clear()
        for k, n in held.items():
            self.held.updateValue((k,), (n,))
        if sent is None:
            self.sent.clear()
        else:
            self.sent.update((sent,))
        self.wake(None if sent is None else sent + self.pause)


def error_digests(stream: DataFrame, source: str, fingerprint: str, time: str = "ts", pause: timedelta = timedelta(hours=1), top: int = 3) -> DataFrame:
    """source, ts, errors, most: the first error at once, then what came since in one digest per `pause`, as long as any came.

    A digest is due a pause after the row before it, and a timer gives it even if no error follows; most has the
    most frequent fingerprints with their counts, ties by name. After a pause without errors the next one is given at
    once again, and no state is left. Counts by fingerprint are held, not errors. A null fingerprint is an empty one.
    """
    rows = stream.select(source, time, F.unix_micros(time).alias("at"), F.coalesce(F.col(fingerprint).cast("string"), F.lit("")).alias("fingerprint"))
    out = keyed(rows, [source], _Digest(_micros(pause), top), "at long, errors long, most string")
    return out.select(source, F.timestamp_micros("at").alias("ts"), "errors", "most")


class _Balance(Timed):
    def __init__(self, low: float, spend: float, span: int):
        self.low, self.spend, self.span = low, spend, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.flags = handle.getValueState("flags", "low boolean, told long")
        self.readings = handle.getValueState("readings", "times array<long>, balances array<double>")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        low, told = self.flags.get() if self.flags.exists() else (False, None)
        times, balances = map(list, self.readings.get()) if self.readings.exists() else ([], [])
        first = 0  # the last reading before the span, from which its first drop is counted
        for at, _, balance in sorted((r.at, r.n, r.balance) for r in rows):
            times.append(at)
            balances.append(balance)
            while first + 1 < len(times) and times[first + 1] < at - self.span:
                first += 1
            if balance < self.low and not low:
                yield self.row(key, at, "low", balance)
            low = balance < self.low
            drops = (max(0.0, b - c) for b, c, t in zip(balances[first:], balances[first + 1 :], times[first + 1 :], strict=False) if t >= at - self.span)
            spent = round(sum(drops), 4)
            if spent > self.spend and (told is None or at - told >= self.span):
                told = at
                yield self.row(key, at, "spend", spent)
        self.flags.update((low, told))
        self.readings.update((times[first:], balances[first:]))
        self.wake(times[-1] + self.span + 1)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        times, balances = self.readings.get()
        self.readings.update((list(times)[-1:], list(balances)[-1:]))  # the next drop is counted from it
        self.timer.clear()
        yield from ()


def balance_watch(stream: DataFrame, key: str, balance: str, order: str, low: float = 2.0, spend: float = 3.0, time: str = "ts", span: timedelta = timedelta(hours=24)) -> DataFrame:
    """key, ts, alert, amount: a balance that falls below `low`, and drops that add up to more than `spend` in the span.

    low is told once, and again after a reading that isn't low. spend is told once in a span; what is paid in counts
    as no drop. State is the span's readings and the one before; a key without news keeps its last one. Null readings are left out.
    """
    rows = stream.where(F.col(balance).isNotNull()).select(key, time, F.unix_micros(time).alias("at"), F.col(order).alias("n"), F.col(balance).cast("double").alias("balance"))
    out = keyed(rows, [key], _Balance(low, spend, _micros(span)), "at long, alert string, amount double")
    return out.select(key, F.timestamp_micros("at").alias("ts"), "alert", "amount")


class _Sliding(Timed):
    def __init__(self, span: int):
        self.span = span

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.times = handle.getValueState("times", "times array<long>")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        ring, first = list(self.times.get()[0]) if self.times.exists() else [], 0
        for at, n in sorted((r.at, r.n) for r in rows):
            ring.append(at)
            while ring[first] < at - self.span:
                first += 1
            yield self.row(key, n, len(ring) - first)
        self.times.update((ring[first:],))
        self.wake(ring[-1] + self.span + 1)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        self.times.clear()
        self.timer.clear()
        yield from ()


def sliding_counts(stream: DataFrame, key: str, order: str, time: str = "ts", span: timedelta = timedelta(seconds=600)) -> DataFrame:
    """key, order, within: for each row how many rows of its key lie in the span up to it, itself included; exact.

    Of rows at one time the later by `order` counts the earlier. State is the times within the span, and goes after it.
    """
    rows = stream.select(key, time, F.unix_micros(time).alias("at"), F.col(order).alias("n"))
    out = keyed(rows, [key], _Sliding(_micros(span)), f"id {stream.schema[order].dataType.simpleString()}, within long")
    return out.select(key, F.col("id").alias(order), "within")


def busy_minutes(stream: DataFrame, key: str, most: int, time: str = "ts", span: str = "1 minute") -> DataFrame:
    """key, start, n, refused: whole minutes in which a key has more than its `most` requests; the rest is refused.

    A minute is given once the watermark has passed it, and its state goes.
    """
    n = stream.groupBy(key, F.window(time, span)).agg(F.count("*").alias("n")).where(F.col("n") > most)
    return n.select(key, F.col("window.start").alias("start"), "n", (F.col("n") - most).alias("refused"))


def _micros(span: timedelta) -> int:
    return span // timedelta(microseconds=1)
