"""Plans of payments: evidence of events (I16), methods (I15), a user's plans (I13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tramaline.operators.payments import FORBIDDEN, conforming, hmac_sha256, method_availability, plan_history
from tramaline.plans.base import Plans
from tramaline.plans.ledger import PAYMENTS, USERS, payments, users, values
from tramaline.session import table

plan = Plans()
QUERIES, SQL = plan.queries, plan.sql

# ---- evidence ----

#: The key of the plan's own events; a service passes its own.
SECRET = b"a key of this plan, for its own events"
_BODY = """case event_id % 29 when 0 then '{broken' when 1 then '[1]' when 2 then '' when 3 then '{"version":1}' else '{"version":1,"type":"payment.confirmed","eventId":"e' || event_id || '","environment":"live","projectId":"p1","paymentId":"pay:' || event_id || '","effectKey":"k' || event_id || '","data":{"eventType":"payment.confirmed","projectId":"p1","paymentId":"pay:'
 || (event_id + case when event_id % 31 = 0 then 1 else 0 end) || '","merchantId":"m-1","externalReference":"' || case when event_id % 37 = 0 then 'not a reference' else 'x' end || '","providerReference":"r","provider":"fapshi","currency":"' || case when event_id % 7 = 0 then 'EUR' else 'XAF' end || '","amountMinor":'
 || case when event_id % 41 = 0 then '"900"' when event_id % 43 = 0 then '150.5' else cast(cast(floor(value * 100) as bigint) as varchar) end || case when event_id % 13 = 0 then ',"credits":5' else '' end || case event_id % 17 when 0 then ',"environment":"sandbox"' when 1 then ',"environment":"live"' else '' end || '}}' end"""
_HEADERS = ["case when event_id % 19 = 0 then 'other' else 'e' || event_id end as header", "case when event_id % 47 = 0 then 'old' else 'k1' end as key_id"]


def _pad(byte: int) -> str:
    return "'" + "".join(f"\\x{b ^ byte:02X}" for b in SECRET.ljust(64, b"\0")) + "'::blob"


_SIGNED = f"""(select *, 'v1=' || case when event_id % 23 = 0 then repeat('0', 64) else sha256({_pad(0x5C)} || unhex(sha256({_pad(0x36)} || encode('v1' || chr(10) || stamp || chr(10) || header || chr(10) || body)))) end as signature from (
select event_id, {_BODY} as body, {', '.join(_HEADERS)}, epoch(ts)::bigint as received, (epoch(ts)::bigint + event_id % 40 * 20 - 100)::varchar as stamp from events where event_type = 'purchase'))"""
_MAC = f"'v1=' || sha256({_pad(0x5C)} || unhex(sha256({_pad(0x36)} || encode('v1' || chr(10) || stamp || chr(10) || header || chr(10) || body))))"
_REF = "coalesce(regexp_full_match({}, '[A-Za-z0-9_:-]{{1,160}}'), false)"


def _field(name: str) -> str:
    return f"json_extract_string(j, '$.{name}')"


_PROOF = " and ".join([
    _field("version") + " = '1'", _field("type") + " = 'payment.confirmed'", _field("eventId") + " = header", _field("environment") + " = 'live'", _field("projectId") + " = 'p1'",
    *(_REF.format(_field(x)) for x in ("paymentId", "effectKey", "data.merchantId", "data.externalReference", "data.providerReference")),
    _field("data.eventType") + " = 'payment.confirmed'", _field("data.projectId") + " = 'p1'", _field("data.paymentId") + " = " + _field("paymentId"), _field("data.provider") + " = 'fapshi'", _field("data.currency") + " = 'XAF'",
    "json_type(j, '$.data.amountMinor') in ('UBIGINT', 'BIGINT')", f"try_cast({_field('data.amountMinor')} as bigint) >= 100", f"coalesce({_field('data.environment')}, 'live') = 'live'", f"not list_has_any(json_keys(j, '$.data'), {FORBIDDEN})",
])


@plan("event_conformity", f"""select event_id, case when not strlen(body) between 1 and 8192 then 'size' when not ({_REF.format('header')} and key_id = 'k1' and regexp_full_match(stamp, '[0-9]{{1,12}}') and regexp_full_match(signature, 'v1=[0-9a-f]{{64}}')) then 'authentication'
when abs(received - stamp::bigint) > 300 then 'window' when signature <> {_MAC} then 'signature' when not coalesce(json_type(j) = 'OBJECT' and json_type(j, '$.data') = 'OBJECT', false) then 'malformed' when not coalesce({_PROOF}, false) then 'evidence' end as refused
from (select *, case when json_valid(body) then body::json end as j from {_SIGNED})""")
def event_conformity(spark, d):
    events = table(spark, d, "events").where("event_type = 'purchase'").withColumn("received", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 10**6))
    events = events.selectExpr("event_id as id", f"{_BODY} as body".replace("as varchar", "as string"), *_HEADERS, "received", "cast(received + event_id % 40 * 20 - 100 as string) as stamp")
    message = F.concat(F.lit("v1\n"), "stamp", F.lit("\n"), "header", F.lit("\n"), "body").cast("binary")
    signed = events.withColumn("signature", F.concat(F.lit("v1="), F.when(F.col("id") % 23 == 0, "0" * 64).otherwise(hmac_sha256(SECRET, message)))).withColumnRenamed("header", "event_id")
    return conforming(signed, SECRET, "k1", "p1", "live", "fapshi", "XAF").select(F.col("id").alias("event_id"), "refused")


# ---- methods ----

_METHODS, _CURRENCIES = ["card", "momo", "orange", "paypal", "cash"], ["XAF", "EUR", "USD"]
_ROUTES = values([("card", "Paddle "), ("momo", "campay"), ("orange", "fapshi"), ("paypal", "")], "method, provider")
_PROVIDERS = values([("campay", True), ("fapshi", False), ("paddle", True)], "provider, configured")
_TAKES = values([("campay", "momo"), ("campay", "orange"), ("fapshi", "momo"), ("fapshi", "orange"), ("paddle", "card")], "provider, method")
_PAYS = values([("campay", "XAF"), ("fapshi", "XAF"), ("paddle", "EUR"), ("paddle", "USD")], "provider, currency")
_ASKS = "payment_id, case payment_id % 5 " + " ".join(f"when {i} then '{m}'" for i, m in enumerate(_METHODS)) + " end as method, case amount % 3 " + " ".join(f"when {i} then '{c}'" for i, c in enumerate(_CURRENCIES)) + " end as currency"


@plan("method_availability", f"""select a.payment_id, a.method, a.currency, case when r.provider is not null and p.configured and t.provider is not null and c.provider is not null then p.provider end as provider,
case when r.method is null then 'unknown' when p.provider is null then 'no_provider' when t.provider is null then 'unsupported' when not p.configured then 'not_configured' when c.provider is null then 'currency' end as reason
from (select {_ASKS} from {PAYMENTS}) a left join (select method, lower(trim(provider)) as provider from {_ROUTES}) r on r.method = a.method left join {_PROVIDERS} p on p.provider = r.provider
left join {_TAKES} t on t.provider = p.provider and t.method = a.method left join {_PAYS} c on c.provider = p.provider and c.currency = a.currency""")
def methods(spark, d):
    rows = lambda sql: spark.sql(sql[1:-1])
    asked = payments(spark, d).selectExpr(*(x for x in (_ASKS.split(", case ")[0], "case " + _ASKS.split(", case ")[1], "case " + _ASKS.split(", case ")[2])))
    return method_availability(asked, rows(_ROUTES), rows(_PROVIDERS), rows(_TAKES), rows(_PAYS))


# ---- a user's plans ----

_KINDS = "case payment_id % 5 when 0 then 'renewal' when 1 then 'expiry' when 2 then 'admin' else 'subscription' end"
_PLANS = f"(select user_id, payment_id as event_id, {_KINDS} as kind, plan, months::int as months, created_at as happened, case when payment_id % 5 <> 1 then created_at + to_days((months * 30)::int) end as expires_at from {PAYMENTS} where status = 'SUCCESSFUL' and plan is not null)"


@plan("plan_history", f"""select user_id, row_number() over (partition by user_id order by kind = 'signup', happened desc, event_id) as place, kind, plan, months, cast(happened as timestamp) as happened, cast(expires_at as timestamp) as expires_at,
count(*) filter (where kind in ('signup', 'subscription', 'admin')) over u as subscriptions, count(*) filter (where kind = 'expiry') over u as expiries, count(*) filter (where kind = 'renewal') over u as renewals
from (select user_id, event_id, kind, plan, months, happened, expires_at from {_PLANS} where user_id in (select c_custkey from customer) union all select user_id, null, 'signup', 'free', null, created_at, null from {USERS}) window u as (partition by user_id)""")
def histories(spark, d):
    paid = payments(spark, d).where("status = 'SUCCESSFUL' and plan is not null").selectExpr("user_id", "payment_id as event_id", f"{_KINDS} as kind", "plan", "months", "cast(created_at as timestamp) as happened", "cast(if(payment_id % 5 <> 1, created_at + make_dt_interval(cast(months * 30 as int)), null) as timestamp) as expires_at")
    return plan_history(paid, users(spark, d).select("user_id", F.col("created_at").cast("timestamp").alias("created_at")))
