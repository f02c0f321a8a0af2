"""Column functions of identity: mailboxes, domains, networks, fingerprints."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Providers whose addresses carry a tag after +, and those with a suffix after -.
GMAIL = ["gmail.com", "googlemail.com"]
PLUS_DOMAINS = ["fastmail.com", "hotmail.com", "icloud.com", "live.com", "mac.com", "me.com", "msn.com", "outlook.com", "pm.me", "proton.me", "protonmail.com"]
DASH_DOMAINS = ["yahoo.com", "yahoo.fr", "ymail.com"]


def canonical_mailbox(email: Column) -> Column:
    """The mailbox behind an address: lower case; tags, suffixes and Gmail's dots dropped where the provider ignores them."""
    address = F.lower(F.trim(email))
    domain, local = F.substring_index(address, "@", -1), F.regexp_extract(address, "^(.*)@[^@]*$", 1)
    untagged = F.substring_index(local, "+", 1)
    return (
        F.when(~address.contains("@"), address)
        .when(domain.isin(GMAIL), F.concat(F.replace(untagged, F.lit(".")), F.lit("@gmail.com")))
        .when(domain.isin(PLUS_DOMAINS), F.concat(untagged, F.lit("@"), domain))
        .when(domain.isin(DASH_DOMAINS), F.concat(F.substring_index(local, "-", 1), F.lit("@"), domain))
        .otherwise(address)
    )


@F.pandas_udf(StringType())
def network_key(peers: pd.Series) -> pd.Series:
    """IPv4 as it is, also from a mapped address; IPv6 as its /64; null if it is no address."""

    def one(peer: str | None) -> str | None:
        try:
            a = ipaddress.ip_address(peer)
        except ValueError:
            return None
        a = getattr(a, "ipv4_mapped", None) or a
        return a.compressed if a.version == 4 else ipaddress.ip_network((int(a) >> 64 << 64, 64)).compressed

    return peers.map(one)


def domain_suffixes(domain: Column) -> Column:
    """All suffixes of a domain with a dot in them."""
    parts = F.split(domain, r"\.")
    n = F.size(parts)
    all_of = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, i, n), "."))
    return F.filter(all_of, lambda x: x.contains("."))


def has_suffix(domain: Column, of: list[str]) -> Column:
    """Whether a domain or one above it is on the list."""
    return F.arrays_overlap(domain_suffixes(domain), F.array(*map(F.lit, of)))


def is_disposable(domain: Column, blocked: list[str], allowed: list[str]) -> Column:
    """Whether a domain or one above it is blocked, and none of them is allowed."""
    return has_suffix(domain, blocked) & ~has_suffix(domain, allowed)


#: First digits of Cameroon's mobile numbers by operator.
MOBILE_PREFIXES = {"mtn": ["650", "651", "652", "653", "654", "67", "680", "681", "682", "683", "684"], "orange": ["655", "656", "657", "658", "659", "685", "686", "687", "688", "689", "69"]}


def phone_operator(number: Column, prefixes: dict[str, list[str]] = MOBILE_PREFIXES, country: str = "237") -> Column:
    """Operator of a number of nine digits, after its country code is dropped; null if there is none."""
    digits = F.regexp_replace(number, r"\D", "")
    local = F.regexp_replace(digits, rf"^{country}(?=\d{{9}}$)", "")
    out = F.lit(None).cast("string")
    for operator, starts in prefixes.items():
        out = F.when(local.rlike(rf"^(?:{'|'.join(starts)})") & (F.length(local) == 9), operator).otherwise(out)
    return out


def fingerprint(source: Column, level: Column, location: Column, message: Column) -> Column:
    """Group of an error: 32 hex digits over source, level, place and the head of the message."""
    head = F.substring(F.trim(F.coalesce(message, F.lit(""))), 1, 200)
    return F.substring(F.sha2(F.concat_ws("|", source, level, location, head), 256), 1, 32)


def truncated(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…[tronqué]"))).otherwise(text)
