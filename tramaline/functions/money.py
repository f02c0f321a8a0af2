"""Fixed values and column functions of plans, zones, prices and fees. Money is in minor units, as whole numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Countries with a reduced zone; any other country is in zone C.
ZONE_COUNTRIES = {
    "A": ["CM", "GA", "TD", "CF", "CG", "GQ", "SN", "CI", "BF", "ML", "NE", "TG", "BJ", "GW", "NG", "GH", "KE", "TZ", "UG", "RW", "CD", "MG", "ET", "ZM"],
    "B": ["MA", "DZ", "TN", "EG", "IN", "PK", "BD", "ID", "PH", "VN", "TH", "BR", "MX", "CO", "AR", "PE", "TR", "UA", "RO", "BG", "RS"],
}
#: Fixed values: (zone, plan, monthly, annual per month); null is by quote.
PRICES = [("A", "free", 0, 0), ("A", "starter", 1500, 1200), ("A", "pro", 4500, 3500), ("B", "free", 0, 0), ("B", "starter", 490, 390), ("B", "pro", 1190, 890), ("C", "free", 0, 0), ("C", "starter", 790, 590), ("C", "pro", 1990, 1490)]
#: Price of one page, currency, least payment by mobile money and by card, card's fixed fee, by zone.
ZONES = [("A", 75, "XAF", 100, 427, 309), ("B", 12, "USD", 0, 70, 50), ("C", 19, "EUR", 0, 65, 47)]
FEE_PERCENT, CARD_PERCENT = 3, 5
#: Plan, storage in bytes, pages a month (null: unlimited), priority, label, rank.
PLANS = [("free", 0, 5, 0, "Gratuit", 0), ("starter", 2147483648, 100, 1, "Starter", 1), ("pro", 21474836480, 500, 2, "Pro", 2), ("enterprise", 214748364800, None, 3, "Enterprise", None), ("admin", 214748364800, None, 3, "Admin", None)]


def lookup(pairs: dict | list, key: Column) -> Column:
    """Value of a small fixed table, null if absent."""
    items = list(pairs.items() if isinstance(pairs, dict) else pairs)
    return F.element_at(F.create_map(*(F.lit(x) for pair in items if pair[1] is not None for x in pair)), key)


def zone_for_country(country: Column) -> Column:
    code = F.upper(F.trim(country))
    return F.when(code.isin(ZONE_COUNTRIES["A"]), "A").when(code.isin(ZONE_COUNTRIES["B"]), "B").otherwise("C")


def ceil_div(a: Column, b: Column | int) -> Column:
    """Quotient rounded up, in whole numbers."""
    n = a.cast("long") + b - 1
    return (n - F.pmod(n, F.lit(b) if isinstance(b, int) else b)) / b


def plan_price(zone: Column, plan: Column, annual: Column) -> Column:
    key = F.concat_ws(":", zone, plan)
    monthly, yearly = (lookup({f"{p[0]}:{p[1]}": p[i] for p in PRICES}, key) for i in (2, 3))
    return F.when(annual, yearly).otherwise(monthly).cast("long")


def page_price(zone: Column) -> Column:
    return lookup({z[0]: z[1] for z in ZONES}, zone).cast("long")


def currency(zone: Column) -> Column:
    return lookup({z[0]: z[2] for z in ZONES}, zone)


def transaction_fee(amount: Column, zone: Column, card: Column) -> Column:
    """What the payer adds: 3 % rounded up, or for cards so much that the net price is left."""
    fixed = lookup({z[0]: z[5] for z in ZONES}, zone)
    by_card = ceil_div((amount + fixed) * 100, 100 - CARD_PERCENT).cast("long") - amount
    return F.when(card, by_card).otherwise(ceil_div(amount * FEE_PERCENT, 100)).cast("long")


def billable_pages(pages: Column, zone: Column, card: Column) -> Column:
    """Pages that reach the least payment of the method."""
    least = F.when(card, lookup({z[0]: z[4] for z in ZONES}, zone)).otherwise(lookup({z[0]: z[3] for z in ZONES}, zone))
    return F.greatest(pages, ceil_div(least.cast("long"), page_price(zone))).cast("long")
