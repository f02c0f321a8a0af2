"""Budgets of pages: characters and images granted per page, pages begun per day, what is given back."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramaline.operators.folds import fold_rows


class Allowance(NamedTuple):
    """Characters and images of a page, for all time, and pages begun in a day; None: no bound."""

    chars: int | None
    images: int | None
    pages: int


#: What each plan allows. Companies and administrators have the last; an unknown plan has the first.
PLANS = {"free": Allowance(30_000, 30, 30), "starter": Allowance(100_000, 80, 150), "pro": Allowance(None, None, 500)}
SAME_AS = {"enterprise": "pro", "admin": "pro"}


class _Pages:
    """A user's pages as their requests go by: what each has used, and the day it was begun."""

    def __init__(self) -> None:
        self.used: dict[str, list[int]] = {}
        self.day: dict[str, object] = {}
        self.begun: dict[object, int] = {}

    def take(self, page: str, day: object, asked: tuple[int, int], bounds: Allowance) -> tuple[int, int, str | None]:
        if page not in self.used and self.begun.get(day, 0) >= bounds.pages:
            return 0, 0, "pages"
        used = self.used.get(page, [0, 0])
        given = [n if most is None else max(0, min(n, most - u)) for n, u, most in zip(asked, used, bounds[:2], strict=True)]
        if any(given):
            if page not in self.used:
                self.day[page], self.begun[day] = day, self.begun.get(day, 0) + 1
            self.used[page] = [u + g for u, g in zip(used, given, strict=True)]
        short = next((name for name, g, n in zip(("chars", "images"), given, asked, strict=True) if g < n), None)
        return given[0], given[1], short

    def give_back(self, page: str, unused: tuple[int, int]) -> None:
        """What wasn't used; a page that has nothing left isn't begun any more."""
        if page in self.used:
            self.used[page] = [max(0, u - n) for u, n in zip(self.used[page], unused, strict=True)]
            if not any(self.used[page]):
                del self.used[page]
                self.begun[self.day.pop(page)] -= 1


def page_limits(requests: DataFrame, user: str, page: str, day: str, order: list[str], chars: str, images: str, plan: str, returns: str | None = None, plans: dict[str, Allowance] | None = None, same_as: dict[str, str] | None = None) -> DataFrame:
    """user, order, chars_granted, images_granted, refused: what each request gets of its page's budgets, in order.

    A grant is partial where a bound falls within what is asked; refused names the first bound that was short: pages
    (a page that isn't begun yet, on a day that has begun as many as it may), chars, images, or null. A page is begun
    by its first grant, on that day, and stays so. Rows whose column `returns` is true give back; they are granted nothing.
    Null amounts are 0, a null page is one page, a null plan is the first. Requests of a user go through one task as
    a stream; a user's pages are held, not its requests. An empty table gives no rows.
    """
    plans, same_as = plans or PLANS, SAME_AS if same_as is None else same_as
    least = next(iter(plans.values()))
    amount = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    back = F.lit(False) if returns is None else F.coalesce(F.col(returns), F.lit(False))
    rows = requests.select(F.col(user).alias("user"), *(F.col(o).alias(f"o{i}") for i, o in enumerate(order)), F.coalesce(F.col(page).cast("string"), F.lit("")).alias("page"), F.col(day).alias("day"), amount(chars).alias("chars"), amount(images).alias("images"), F.col(plan).alias("plan"), back.alias("back"))
    places = [f"o{i}" for i in range(len(order))]

    def fold(stream: Iterator[tuple]) -> Iterator[tuple]:
        pages = _Pages()
        for *place, at, on, n, m, name, returned in stream:
            if returned:
                pages.give_back(at, (n, m))
                yield (*place, 0, 0, None)
            else:
                yield (*place, *pages.take(at, on, (n, m), plans.get(same_as.get(name, name), least)))

    out = ", ".join(f"{p} {rows.schema[p].dataType.simpleString()}" for p in places) + ", chars_granted bigint, images_granted bigint, refused string"
    done = fold_rows(rows, ["user"], places, [*places, "page", "day", "chars", "images", "plan", "back"], out, fold)
    return done.select(F.col("user").alias(user), *(F.col(p).alias(o) for p, o in zip(places, order, strict=True)), "chars_granted", "images_granted", "refused")
