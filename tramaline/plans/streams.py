"""Streaming plans (S) over the events; each has a batch query with the same result where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tramaline.plans.base import Plans
from tramaline.plans.layout import walk
from tramaline.session import table
from tramaline.streaming.jobs import bounded_alerts, cooldown_alerts, drained, event_stream, streamed_again
from tramaline.streaming.states import balance_watch, busy_minutes, error_digests, page_bounds, settled_payments, sliding_counts

plan = Plans()
QUERIES, SQL = plan.queries, plan.sql


@plan("page_progress", "select user_id as job, event_id % 9 as page, max_by(event_type, ts) as status from events group by 1, 2")
def page_progress(spark, d):
    s = event_stream(spark, d).groupBy(F.col("user_id").alias("job"), F.expr("event_id % 9").alias("page"))
    return drained(s.agg(F.max_by("event_type", "ts").alias("status")), "complete")


_FAULTS = "(select 'page' || user_id % 7 as fingerprint, ts, row_number() over (partition by user_id % 7 order by ts, event_id) as r from events where event_type = 'error')"
_GAP = "s.ts - f.last >= interval 1 hour"
_ALERTS = walk(_FAULTS, "fingerprint", "ts, last, alerts", "ts, ts, true", f"s.ts, case when {_GAP} then s.ts else f.last end, {_GAP}", "ts") + " where alerts"


@plan("critical_alerts", f"select fingerprint, cast(ts as timestamp) as ts from (select *, row_number() over (partition by date_trunc('hour', ts) order by ts, fingerprint) as n from ({_ALERTS})) where n <= 5")
def critical_alerts(spark, d):
    errors = event_stream(spark, d).where("event_type = 'error'").withColumn("fingerprint", F.expr("concat('page', user_id % 7)"))
    alerts = drained(cooldown_alerts(errors.select("fingerprint", "ts"), "fingerprint", 3600), "append")
    return drained(bounded_alerts(streamed_again(alerts), "fingerprint", 3600, 5), "append")


#: What the stream's watermark is once all rows are read.
_SURE = "(select max(ts) - interval 1 day from events)"
_SOURCE, _PRINT = "user_id % 3", "'page' || user_id % 7"
_DUE = "f.sent + interval 1 hour"
_LATER = f"s.ts >= {_DUE} + interval 1 hour"
_SLOTS = walk(
    f"(select {_SOURCE} as source, {_PRINT} as fingerprint, ts, row_number() over (partition by {_SOURCE} order by ts, event_id) as r from events where event_type = 'error')", "source", "fingerprint, sent, held, slot", "fingerprint, ts, 0, ts",
    f"s.fingerprint, case when s.ts < {_DUE} then f.sent when f.held > 0 and not ({_LATER}) then {_DUE} else s.ts end, case when s.ts < {_DUE} then f.held + 1 when f.held > 0 and not ({_LATER}) then 1 else 0 end, case when s.ts < {_DUE} then {_DUE} when f.held > 0 and not ({_LATER}) then {_DUE} + interval 1 hour else s.ts end",
    "fingerprint, slot",
)


@plan("error_digest", f"""select source, cast(slot as timestamp) as ts, sum(n)::bigint as errors, string_agg(fingerprint || ':' || n, ',' order by n desc, fingerprint) filter (where place <= 3) as most
from (select *, row_number() over (partition by source, slot order by n desc, fingerprint) as place from (select source, slot, fingerprint, count(*) as n from ({_SLOTS}) group by all))
join (select {_SOURCE} as source, max(ts) as last from events where event_type = 'error' group by 1) using (source) where slot <= greatest(last, {_SURE}) group by source, slot""")
def error_digest(spark, d):
    errors = event_stream(spark, d).where("event_type = 'error'").withColumn("source", F.expr("user_id % 3")).withColumn("fingerprint", F.expr("concat('page', user_id % 7)"))
    return drained(error_digests(errors, "source", "fingerprint"), "append")


#: Rows of one time count those before them by event_id, not those after.
_WITHIN = "count(*) over (partition by {0} order by ts range between interval 600 seconds preceding and current row) - count(*) over (partition by {0}, ts) + row_number() over (partition by {0}, ts order by event_id)"


@plan("rate_windows", f"select kind, event_id, n from (select event_id, {_WITHIN.format('user_id')} as device, {_WITHIN.format('user_id % 5')} as network from events) unpivot (n for kind in (device, network))")
def rate_windows(spark, d):
    events = event_stream(spark, d).withColumn("network", F.expr("user_id % 5"))
    counts = [drained(sliding_counts(events, key, "event_id"), "append").select(F.lit(kind).alias("kind"), "event_id", F.col("within").alias("n")) for kind, key in (("device", "user_id"), ("network", "network"))]
    return counts[0].unionByName(counts[1])


@plan("request_rate", f"select caller, cast(start as timestamp) as start, n, n - 1 as refused from (select user_id % 5 as caller, date_trunc('minute', ts) as start, count(*) as n from events group by 1, 2) where n > 1 and start + interval 1 minute <= {_SURE}")
def request_rate(spark, d):
    return drained(busy_minutes(event_stream(spark, d).withColumn("caller", F.expr("user_id % 5")), "caller", 1), "append")


_CALLS = "(select user_id % 10 as account, user_id % 40 as page, event_id, ts, case event_type when 'click' then 'batch' when 'view' then 'analysis' when 'error' then 'capture' else '' end as kind, row_number() over (partition by user_id % 40 order by ts, event_id) as r from events)"
_FRESH = "s.ts - f.seen > interval 6 hours"
_FULL = f"not ({_FRESH}) and case s.kind when 'batch' then f.b >= 2 when 'analysis' then f.a >= 2 when 'capture' then f.c >= 1 else false end"
_USED = ", ".join(f"case when {_FRESH} then 0 else f.{c} end + (s.kind = '{k}' and not ({_FULL}))::int" for c, k in (("b", "batch"), ("a", "analysis"), ("c", "capture")))


@plan("technical_bounds_stream", "select account, event_id, refused from (" + walk(_CALLS, "account, page", "event_id, seen, b, a, c, refused", "event_id, ts, (kind = 'batch')::int, (kind = 'analysis')::int, (kind = 'capture')::int, cast(null as varchar)", f"s.event_id, case when {_FULL} then f.seen else s.ts end, {_USED}, case when {_FULL} then s.kind end", "event_id, refused") + ")")
def technical_bounds_stream(spark, d):
    kinds = F.expr("case event_type when 'click' then 'batch' when 'view' then 'analysis' when 'error' then 'capture' end")
    calls = event_stream(spark, d).withColumn("account", F.expr("user_id % 10")).withColumn("page", F.expr("user_id % 40")).withColumn("kind", kinds)
    return drained(page_bounds(calls, "account", "page", "kind", "event_id", bounds={"batch": 2, "analysis": 2, "capture": 1}), "append")


@plan("seen_ttl", "select distinct user_id, props from events")
def seen_ttl(spark, d):
    # a fingerprint lives for the stream's watermark beyond its first sight
    s = event_stream(spark, d, "30 days").select("user_id", "props", "ts").dropDuplicatesWithinWatermark(["user_id", "props"])
    return drained(s.select("user_id", "props"), "append")


@plan("payment_events", "select event_id % 5000 as effect, c_mktsegment as plan from (select distinct event_id % 5000 as event_id, user_id from events where event_type = 'purchase') e join customer on c_custkey = user_id")
def payment_events(spark, d):
    paid = event_stream(spark, d, "40 days").where("event_type = 'purchase'").withColumn("effect", F.expr("event_id % 5000"))
    once = paid.dropDuplicatesWithinWatermark(["effect", "user_id"])
    return drained(once.join(table(spark, d, "customer"), F.expr("c_custkey = user_id")).select("effect", F.col("c_mktsegment").alias("plan")), "append")


_STATUS = "case event_type when 'purchase' then 'SUCCESSFUL' when 'error' then 'FAILED' else 'PENDING' end"
_PAYMENT = "event_id // 4 % 1000"
_LIVES = f"(select *, sum(fresh) over (partition by payment order by ts, event_id) as life from (select {_PAYMENT} as payment, ts, event_id, {_STATUS} as status, (coalesce(ts - lag(ts) over (partition by {_PAYMENT} order by ts, event_id) > interval 2 days, true))::int as fresh from events))"


@plan("late_payment_status", f"""select payment, cast(coalesce(terminal, last) as timestamp) as ts, coalesce(status, 'PENDING') as status, coalesce(status = 'SUCCESSFUL', false) as credited
from (select payment, life, min(ts) filter (where status <> 'PENDING') as terminal, max(ts) as last, arg_min(status, ts) filter (where status <> 'PENDING') as status, max(life) over (partition by payment) as lives from {_LIVES} group by payment, life)
where terminal is not null or life < lives or last + interval 2 days <= {_SURE}""")
def late_payment_status(spark, d):
    status = F.expr("case event_type when 'purchase' then 'SUCCESSFUL' when 'error' then 'FAILED' else 'PENDING' end")
    notices = event_stream(spark, d).withColumn("payment", F.expr("event_id div 4 % 1000")).withColumn("status", status)
    return drained(settled_payments(notices, "payment", "status", "event_id"), "append")


_READ = "(select user_id, ts, event_id, value, lag(value) over w as prev, row_number() over w as r from events window w as (partition by user_id order by ts, event_id))"
_SPENT = f"(select *, round(coalesce(sum(greatest(prev - value, 0)) over (partition by user_id order by ts range between interval 24 hours preceding and current row), 0), 4) as spent from {_READ})"
_TOLD = "s.spent > 12 and (f.told is null or s.ts - f.told >= interval 24 hours)"
_SPENDS = walk(_SPENT, "user_id", "ts, spent, told, alert", "ts, spent, case when spent > 12 then ts end, spent > 12", f"s.ts, s.spent, case when {_TOLD} then s.ts else f.told end, {_TOLD}", "ts, spent, alert")


@plan("balance_alerts", f"select user_id, cast(ts as timestamp) as ts, 'low' as alert, value as amount from {_READ} where value < 5 and coalesce(prev >= 5, true) union all select user_id, cast(ts as timestamp), 'spend', spent from ({_SPENDS}) where alert")
def balance_alerts(spark, d):
    return drained(balance_watch(event_stream(spark, d), "user_id", "value", "event_id", low=5.0, spend=12.0), "append")
