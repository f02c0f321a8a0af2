"""Limits on use: rates, relations between accounts, what was granted before, invitations, pending payments.

Times are columns of timestamps. Bounds are arguments whose defaults are those of the service.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECOND = 10**6


def micros(time: str) -> Column:
    """A time as whole microseconds, for windows of ranges."""
    return F.unix_micros(F.col(time).cast("timestamp"))


def _before(keys: list[str], time: str, seconds: int) -> Column:
    """How many other rows of the keys lie in so many seconds before a row, or at the same time."""
    return F.count("*").over(Window.partitionBy(*keys).orderBy(micros(time)).rangeBetween(-seconds * SECOND, 0)) - 1


def submission_rate(records: DataFrame, bounds: dict[str, int], time: str = "ts", seconds: int = 600, within: tuple[str, ...] = ()) -> DataFrame:
    """records with refused: a key (a column of bounds) has had as many as its bound in so many seconds before.

    The service's bounds are 5 by device and 20 by network. within: columns, as a campaign, in which keys count.
    """
    refused = F.lit(False)
    for key, most in bounds.items():
        refused = refused | (_before([*within, key], time, seconds) >= most)
    return records.withColumn("refused", refused)


def active_at(times: DataFrame, key: list[str], who: str, at: str, span: int) -> DataFrame:
    """key, at and active: for each time of a key, how many of its `who` were there in the span up to it, each counted once.

    The times of one `who` that follow each other within the span are one stay, which ends a span after its last; stays
    that have begun less those that have ended are counted along the key's times, so that no row holds a set.
    """
    along = Window.partitionBy(*key, who).orderBy(at)
    stays = times.select(*key, who, at).distinct().withColumn("_new", F.coalesce(F.col(at) - F.lag(at).over(along) > span, F.lit(True)).cast("int"))
    stays = stays.withColumn("_stay", F.sum("_new").over(along)).groupBy(*key, who, "_stay").agg(F.min(at).alias("_from"), (F.max(at) + span).alias("_to"))
    # at one time stays begin, then rows ask, then stays end
    steps = stays.select(*key, F.explode(F.array(F.struct(F.col("_from").alias(at), F.lit(0).alias("_kind"), F.lit(1).alias("_step")), F.struct(F.col("_to").alias(at), F.lit(2).alias("_kind"), F.lit(-1).alias("_step")))).alias("_e")).select(*key, "_e.*")
    asks = times.select(*key, at).distinct().select(*key, at, F.lit(1).alias("_kind"), F.lit(0).alias("_step"))
    open_now = F.sum("_step").over(Window.partitionBy(*key).orderBy(at, "_kind").rowsBetween(Window.unboundedPreceding, 0))
    return steps.unionByName(asks).withColumn("active", open_now).where("_kind = 1").select(*key, at, "active")


def _company(records: DataFrame, key: str, email: str, day: Column, days: int | None, most: int) -> DataFrame:
    """_key, _day, n and least: of each key and day that records have, the e-mails within `days` of it, and the first of them."""
    seen = records.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), (day if days is not None else F.lit(0)).alias("_day"), F.col(email).alias("_email")).distinct()
    if days is not None:
        near = F.explode(F.sequence(F.col("_day") - days, F.col("_day") + days)).alias("_day")
        # only days on which the key has records are asked for
        seen = seen.select("_key", "_email", near).distinct().join(seen.select("_key", "_day").distinct(), ["_key", "_day"])
    first = Window.partitionBy("_key", "_day").orderBy("_email")
    least = seen.where("_email is not null").withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most + 1).groupBy("_key", "_day").agg(F.array_sort(F.collect_list("_email")).alias("least"))
    return seen.groupBy("_key", "_day").agg(F.count("_email").alias("n")).join(least, ["_key", "_day"], "left")


def account_relations(records: DataFrame, mailbox: str = "mailbox", email: str = "email", signals: tuple[str, ...] = ("ip", "browser"), time: str = "ts", days: int = 30, rapid: int = 3, seconds: int = 3600, most: int = 10) -> DataFrame:
    """records with same_mailbox and same_<signal> (other e-mails that share it), rapid_sequence, and related.

    A signal counts if it is at most `days` older or newer than the record's. rapid_sequence: a signal was used by
    `rapid` e-mails or more in so many seconds up to the record. related: up to `most` other e-mails, in order.
    Keys, days and e-mails are made distinct first and counted; of a key and day only the first e-mails are held, so
    that a network that very many share makes no long rows and no pairs. A null signal is shared with nobody. Columns that are
    named like the new ones are replaced.
    """
    names = [f"same_{'mailbox' if k == mailbox else k}" for k in (mailbox, *signals)]
    columns = [c for c in records.columns if c not in (*names, "rapid_sequence", "related")]
    whole = F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_record")
    day, at = F.unix_date(F.to_date(F.col(time))), micros(time)
    out, shared, sudden = records.select(whole, F.col(email).alias("_own"), day.alias("_on"), at.alias("_at")), [], F.lit(False)
    for i, key in enumerate((mailbox, *signals)):
        company = _company(records, key, email, day, None if key == mailbox else days, most)
        on = (F.col(f"_record.{key}") == company["_key"]) & (company["_day"] == (F.lit(0) if key == mailbox else F.col("_on")))
        company = company.withColumnsRenamed({"n": f"_n{i}", "least": f"_least{i}"})
        out = out.join(company, on, "left").drop("_key", "_day")
        shared.append(F.greatest(F.coalesce(F.col(f"_n{i}"), F.lit(0)) - F.when(F.col("_own").isNull(), 0).otherwise(1), F.lit(0)).cast("long"))
        if key != mailbox:
            used = records.where(F.col(key).isNotNull() & F.col(email).isNotNull()).select(F.col(key).alias("_key"), F.col(email).alias("_email"), at.alias("_time"))
            active = active_at(used, ["_key"], "_email", "_time", seconds * SECOND).withColumnRenamed("active", f"_active{i}")
            out = out.join(active, (F.col(f"_record.{key}") == active["_key"]) & (F.col("_at") == active["_time"]), "left").drop("_key", "_time")
            sudden = sudden | (F.coalesce(F.col(f"_active{i}"), F.lit(0)) >= rapid)
    lists = [F.coalesce(F.col(f"_least{i}"), F.array().cast("array<string>")) for i in range(len(signals) + 1)]
    others = F.filter(F.array_sort(F.array_distinct(F.concat(*lists))), lambda x: F.coalesce(x != F.col("_own"), F.lit(True)))
    return out.select("_record.*", *(c.alias(n) for c, n in zip(shared, names, strict=True)), sudden.alias("rapid_sequence"), F.slice(others, 1, most).alias("related"))


def purge_signals(records: DataFrame, signals: tuple[str, ...], now: str, time: str = "ts", days: int = 30) -> DataFrame:
    """records with signals older than so many days set to null."""
    fresh = F.expr(f"{time} >= {now} - interval {days} days")
    for s in signals:
        records = records.withColumn(s, F.when(fresh, F.col(s)))
    return records


def purge_grants(grants: DataFrame, now: str, kind: str = "kind", time: str = "ts", days: dict[str, int] | None = None, rest: int | None = None) -> DataFrame:
    """grants that are kept: links for 60 days, grants for 35, preview grants for 2. rest: days of kinds not named."""
    days = days or {"link": 60, "grant": 35, "preview": 2}
    keep = F.lit(True) if rest is None else F.expr(f"{time} >= {now} - interval {rest} days")
    for name, n in days.items():
        keep = F.when(F.col(kind) == name, F.expr(f"{time} >= {now} - interval {n} days")).otherwise(keep)
    return grants.where(keep)


def technical_bounds(calls: DataFrame, page: list[str], kind: str, order: list[str], bounds: dict[str, int] | None = None, rest: int | None = None) -> DataFrame:
    """calls with allowed: up to 100 batches, 120 analyses and 20 captures a page. rest: the bound of other kinds."""
    bounds = bounds or {"batch": 100, "analysis": 120, "capture": 20}
    n = F.row_number().over(Window.partitionBy(*page, kind).orderBy(*order))
    allowed = F.lit(True) if rest is None else n <= rest
    for name, most in bounds.items():
        allowed = F.when(F.col(kind) == name, n <= most).otherwise(allowed)
    return calls.withColumn("allowed", allowed)


def already_seen(texts: DataFrame, keys: list[str], text: str, time: str, order: list[str], days: int = 30) -> DataFrame:
    """texts with seen: the same text of the same keys (account and language) was met in so many days before."""
    last = F.lag(micros(time)).over(Window.partitionBy(*keys, F.sha2(text, 256)).orderBy(time, *order))
    return texts.withColumn("seen", F.coalesce(micros(time) - last <= days * 86400 * SECOND, F.lit(False)))


def invitation_rules(asked: DataFrame, members: DataFrame, sender: str = "sender", target: str = "target", own: str = "own", time: str = "ts", order: str = "event_id", pair: int = 3, address: int = 5, days: int = 7, minutes: int = 10, per_day: int = 20) -> DataFrame:
    """asked with refused: the first rule that an invitation breaks, or null.

    own: a sender's own address; member: the address has an account (members has target); pair and address: as many
    as that to the address in so many days, by the sender and by all; resend: sent to it within so many minutes;
    day: the sender's bound in 24 hours. Rows count whether refused or not.
    """
    day = 86400
    both = Window.partitionBy(sender, target).orderBy(time, order)
    soon = micros(time) - F.lag(micros(time)).over(both) < minutes * 60 * SECOND
    known = members.select(target).distinct().withColumn("_member", F.lit(True))
    rules = [
        ("own", F.col(target) == F.col(own)),
        ("member", F.coalesce("_member", F.lit(False))),
        ("resend", F.coalesce(soon, F.lit(False))),
        ("pair", _before([sender, target], time, days * day) >= pair),
        ("address", _before([target], time, days * day) >= address),
        ("day", _before([sender], time, day) >= per_day),
    ]
    first = F.coalesce(*(F.when(broken, F.lit(name)) for name, broken in rules))
    return asked.join(known, target, "left").withColumn("refused", first).drop("_member")


def pending_guard(payments: DataFrame, user: str = "user_id", time: str = "created_at", seconds: int = 180) -> DataFrame:
    """Pending payments with blocked: the user has another one in so many seconds before."""
    return payments.withColumn("blocked", _before([user], time, seconds) > 0)


def reopened(payments: DataFrame, now: str, keys: list[str], time: str = "created_at", minutes: int = 15) -> DataFrame:
    """Of pending card payments, the newest of each key in so many minutes before now: it is taken up again."""
    recent = payments.where(f"{time} <= {now} and {time} >= {now} - interval {minutes} minutes")
    newest = Window.partitionBy(*keys).orderBy(F.desc(time), F.desc("payment_id"))
    return recent.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def spend(readings: DataFrame, key: str, value: str, order: list[str], time: str, now: str, hours: int = 24) -> DataFrame:
    """key and spent: drops of a balance in so many hours before now; the last earlier reading is the base."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    recent = readings.withColumn("_before", before).where(f"_before is not null and {time} > {now} - interval {hours} hours and {time} <= {now}")
    return recent.groupBy(key).agg(F.sum(F.greatest(F.col("_before") - F.col(value), F.lit(0))).alias("spent"))


def client_dedup(errors: DataFrame, keys: list[str], time: str, order: list[str], message: str = "message", seconds: int = 10, benign: tuple[str, ...] = ()) -> DataFrame:
    """errors at most once per keys in so many seconds, without those whose message matches a benign pattern."""
    for pattern in benign:
        errors = errors.where(~F.col(message).rlike(pattern))
    gap = micros(time) - F.lag(micros(time)).over(Window.partitionBy(*keys).orderBy(time, *order))
    return errors.withColumn("_gap", gap).where(F.col("_gap").isNull() | (F.col("_gap") > seconds * SECOND)).drop("_gap")


def top_errors(errors: DataFrame, since: str, until: str, time: str = "ts", most: int = 3) -> DataFrame:
    """fingerprint and n of the most frequent new errors, warnings apart, in a span of time."""
    new = errors.where(f"status = 'new' and level <> 'warning' and {time} > {since} and {time} <= {until}")
    return new.groupBy("fingerprint").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "fingerprint").limit(most)


def younger(rows: DataFrame, now: str, days: int = 30, time: str = "ts") -> DataFrame:
    """rows not older than so many days: invitations that are kept."""
    return rows.where(f"{time} >= {now} - interval {days} days")
