"""Payments: which events prove one, which methods can take a currency, and a user's plans over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The greatest drift of an event's time in seconds, its size in bytes, what a reference looks like, and
#: what evidence may not carry.
DRIFT, MOST_BYTES = 300, 8192
REFERENCE, SIGNATURE = "^[A-Za-z0-9_:-]{1,160}$", "^v1=[0-9a-f]{64}$"
FORBIDDEN = ["pages", "credits", "grant", "phone", "email", "userId"]
_BODY = "version int, type string, eventId string, environment string, projectId string, paymentId string, effectKey string, data struct<eventType: string, projectId: string, paymentId: string, merchantId: string, externalReference: string, providerReference: string, provider: string, currency: string, amountMinor: string, environment: string>"


def hmac_sha256(secret: bytes, message: Column) -> Column:
    """The HMAC of a binary column with a key of up to 64 bytes, as lower-case hex."""
    key = secret.ljust(64, b"\0")
    inner, outer = (F.lit(bytes(k ^ pad for k in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)


def conforming(events: DataFrame, secret: bytes, key_id: str, project: str, environment: str, provider: str, currency: str, least: int = 100, drift: int = DRIFT) -> DataFrame:
    """events with refused: the first check that an event fails, or null for evidence of a payment.

    events has body (JSON text), event_id, key_id, stamp and signature (its headers, text) and received (seconds since the epoch). In order:
    size; headers that aren't a reference, the key's name, digits and a signature (authentication); a stamp more than drift seconds away (window);
    an HMAC of version, stamp, id and body that isn't the signature (signature); text that isn't an object with an object data
    (malformed); and contents that are of another version, type, project, environment, provider or currency, that contradict
    themselves, lack a reference, have less than the least amount, or carry what evidence may not (evidence). Nulls fail.
    """
    body, e = F.col("body"), F.from_json("body", _BODY)
    ref = lambda c: F.coalesce(c.rlike(REFERENCE), F.lit(False))
    size = F.coalesce(F.octet_length("body"), F.lit(0)).between(1, MOST_BYTES)
    headers = ref(F.col("event_id")) & F.coalesce((F.col("key_id") == key_id) & F.col("stamp").rlike("^[0-9]{1,12}$") & F.col("signature").rlike(SIGNATURE), F.lit(False))
    near = F.abs(F.col("received") - F.expr("try_cast(stamp as bigint)")) <= drift
    message = F.concat(F.lit("v1\n"), F.col("stamp"), F.lit("\n"), F.col("event_id"), F.lit("\n"), body).cast("binary")
    signed = F.concat(F.lit("v1="), hmac_sha256(secret, message)) == F.col("signature")
    names = F.json_object_keys(F.get_json_object("body", "$.data"))
    d = e["data"]
    same = {"projectId": F.lit(project), "eventType": F.lit("payment.confirmed"), "provider": F.lit(provider), "currency": F.lit(currency), "paymentId": e["paymentId"]}
    proof = (
        (e["version"] == 1) & (e["type"] == "payment.confirmed") & (e["eventId"] == F.col("event_id")) & (e["environment"] == environment) & (e["projectId"] == project)
        & ref(e["paymentId"]) & ref(e["effectKey"]) & ref(d["merchantId"]) & ref(d["externalReference"]) & ref(d["providerReference"])
        & d["amountMinor"].rlike("^[0-9]+$") & (F.try_to_number(d["amountMinor"], F.lit("9" * 18)) >= least) & (d["environment"].isNull() | (d["environment"] == environment))
        & ~F.get_json_object("body", "$.data.amountMinor").isNull() & ~body.rlike(r'"amountMinor"\s*:\s*"') & (F.size(F.array_intersect(names, F.array(*map(F.lit, FORBIDDEN)))) == 0)
    )
    for name, value in same.items():
        proof = proof & (d[name] == value)
    checks = [("size", size), ("authentication", headers), ("window", near), ("signature", signed), ("malformed", names.isNotNull() & F.json_object_keys("body").isNotNull()), ("evidence", proof)]
    return events.withColumn("refused", F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks)))


def method_availability(asked: DataFrame, routing: DataFrame, providers: DataFrame, methods: DataFrame, currencies: DataFrame, method: str = "method", currency: str = "currency") -> DataFrame:
    """asked with provider and reason: who takes a method's payments in a currency, or why nobody does.

    routing: method, provider (blank: none); providers: provider, configured; methods and currencies: what a provider takes
    (provider, method; provider, currency). In order: unknown (a method without a route), no_provider, unsupported, not_configured, currency.
    """
    name = lambda c: F.lower(F.trim(c))
    r = routing.select(F.col("method").alias(method), name("provider").alias("_to"), F.lit(True).alias("_routed")).dropDuplicates([method])
    p = providers.select(name("provider").alias("_to"), F.coalesce("configured", F.lit(False)).alias("_configured")).dropDuplicates(["_to"])
    m = methods.select(name("provider").alias("_to"), F.col("method").alias(method), F.lit(True).alias("_takes")).distinct()
    c = currencies.select(name("provider").alias("_to"), F.col("currency").alias(currency), F.lit(True).alias("_pays")).distinct()
    j = asked.join(r, method, "left").join(p, "_to", "left").join(m, ["_to", method], "left").join(c, ["_to", currency], "left")
    reason = F.when(F.col("_routed").isNull(), "unknown").when(F.col("_configured").isNull(), "no_provider").when(F.col("_takes").isNull(), "unsupported").when(~F.col("_configured"), "not_configured").when(F.col("_pays").isNull(), "currency")
    return j.withColumn("reason", reason).select(*asked.columns, F.when(F.col("reason").isNull(), F.col("_to")).alias("provider"), "reason")


def plan_history(events: DataFrame, users: DataFrame, user: str = "user_id") -> DataFrame:
    """user, place (from 1, the newest first), kind, plan, months, happened, expires_at; and subscriptions, expiries, renewals.

    events has user, event_id, kind, plan, months, happened, expires_at; users has user and created_at. The last row of each
    user is the sign-up, on the free plan; it counts as the first subscription, as do those that an administrator gave.
    """
    signup = users.select(user, F.lit("signup").alias("kind"), F.lit("free").alias("plan"), F.lit(None).cast("int").alias("months"), F.col("created_at").alias("happened"), F.lit(None).cast(events.schema["expires_at"].dataType).alias("expires_at"))
    known = events.join(users.select(user), user, "left_semi")
    rows = known.select(user, "event_id", "kind", "plan", F.col("months").cast("int").alias("months"), "happened", "expires_at").unionByName(signup, allowMissingColumns=True)
    newest = Window.partitionBy(user).orderBy((F.col("kind") == "signup").cast("int"), F.desc("happened"), "event_id")
    n = lambda *kinds: F.count_if(F.col("kind").isin(*kinds)).over(Window.partitionBy(user))
    totals = {"subscriptions": n("signup", "subscription", "admin"), "expiries": n("expiry"), "renewals": n("renewal")}
    return rows.select(user, F.row_number().over(newest).cast("long").alias("place"), "kind", "plan", "months", "happened", "expires_at", *(c.alias(k) for k, c in totals.items()))
