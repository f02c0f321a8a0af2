"""Plans over identities, programmes, logs and libraries (J, K, L, M), which come from events, customers and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tramaline.functions import identity as I
from tramaline.operators import limits as L
from tramaline.plans.base import NOW_EVENTS, Plans
from tramaline.operators.tables import insert_if_absent
from tramaline.session import table

plan = Plans()
QUERIES, SQL = plan.queries, plan.sql
NOW = f"timestamp '{NOW_EVENTS}'"
DOMAINS = ["gmail.com", "googlemail.com", "outlook.com", "yahoo.fr", "example.org", "x.mailinator.com", "trash.example.net"]
#: Fixed blocklist and allowlist of the plans.
BLOCKED, ALLOWED = ["mailinator.com", "trash.example.net"], ["example.org"]

_LOCAL = "' User.' || (c_custkey // 2)::varchar || case when c_custkey % 3 = 0 then '+tag' when c_custkey % 3 = 1 then '-suffix' else '' end"
_DOMAIN = "case c_custkey % 7 " + " ".join(f"when {i} then '{x}'" for i, x in enumerate(DOMAINS)) + " end"
EMAILS = f"(select c_custkey, {_LOCAL} || '@' || {_DOMAIN} || ' ' as email, {_DOMAIN} as domain from customer)"


def emails(spark: SparkSession, d: str) -> DataFrame:
    local = _LOCAL.replace("(c_custkey // 2)::varchar", "cast(c_custkey div 2 as string)")
    return table(spark, d, "customer").selectExpr("c_custkey", f"{local} || '@' || {_DOMAIN} || ' ' as email", f"{_DOMAIN} as domain")


#: Events as requests: account, network, browser and record by arithmetic on the event.
SIGNALS = "(select event_id, ts, user_id, event_type, value, '10.0.' || (user_id % 5) || '.' || (event_id % 40) as ip, 'b' || (user_id % 60) as browser, 'u' || user_id || '@example.org' as email from events)"


def signals(spark, d):
    return table(spark, d, "events").selectExpr("event_id", "cast(ts as timestamp_ntz) as ts", "user_id", "event_type", "value", "concat('10.0.', user_id % 5, '.', event_id % 40) as ip", "concat('b', user_id % 60) as browser", "concat('u', user_id, '@example.org') as email")


def seconds(c="ts"):
    return F.unix_micros(F.col(c).cast("timestamp"))


# ---- abuse and identity ----

_L, _A = "lower(trim(email))", "split_part(lower(trim(email)), '@', 1)"
_CANON = f"case when domain in ('gmail.com', 'googlemail.com') then replace(split_part({_A}, '+', 1), '.', '') || '@gmail.com' when domain = 'outlook.com' then split_part({_A}, '+', 1) || '@' || domain when domain = 'yahoo.fr' then split_part({_A}, '-', 1) || '@' || domain else {_L} end"


@plan("canonical_mailbox", f"select c_custkey, {_CANON} as mailbox from {EMAILS}")
def canonical_mailbox(spark, d):
    return emails(spark, d).select("c_custkey", I.canonical_mailbox(F.col("email")).alias("mailbox"))


@plan("is_disposable", f"select c_custkey, domain similar to '(.*[.])?(mailinator[.]com|trash[.]example[.]net)' and not domain similar to '(.*[.])?example[.]org' as disposable from {EMAILS}")
def is_disposable(spark, d):
    return emails(spark, d).select("c_custkey", I.is_disposable(F.col("domain"), BLOCKED, ALLOWED).alias("disposable"))


@plan("network_key", "select event_id, case event_id % 4 when 0 then '10.0.0.' || (event_id % 250) when 1 then '2001:db8:0:' || printf('%x', 1 + event_id % 60) || '::/64' when 2 then '10.0.1.' || (event_id % 250) end as network from events")
def network_key(spark, d):
    peer = F.expr("case event_id % 4 when 0 then concat('10.0.0.', event_id % 250) when 1 then concat('2001:db8:0:', lower(hex(1 + event_id % 60)), ':', lower(hex(event_id % 999)), '::1') when 2 then concat('::ffff:10.0.1.', event_id % 250) else 'not an address' end")
    return table(spark, d, "events").select("event_id", I.network_key(peer).alias("network"))


_RISK = f"""select s.user_id, case when disposable then 'disposable' when others > 0 then 'mailbox' when verified then null when accounts >= 2 then 'device' when pages > 30 then 'ip' when fresh then 'new_account' end as risk from (
select user_id, user_id % 17 = 0 as disposable, user_id % 3 = 0 as verified, user_id % 5 = 0 as fresh, coalesce(o.others, 0) as others, coalesce(a.accounts, 0) as accounts, coalesce(p.pages, 0) as pages from (select distinct user_id, user_id % 60 as machine, user_id // 2 as mailbox, user_id % 5 as net from events where event_type = 'signup') u
left join (select mailbox, case when count(distinct user_id) > 1 then 1 else 0 end as others from (select user_id, user_id // 2 as mailbox from events where event_type = 'signup' and user_id % 11 = 0 and ts >= date_trunc('month', {NOW})) group by 1) o using (mailbox)
left join (select machine, count(distinct user_id) - 1 as accounts from (select user_id, user_id % 60 as machine from events where event_type = 'signup' and ts >= date_trunc('month', {NOW})) group by 1) a using (machine)
left join (select net, count(*) as pages from (select user_id % 5 as net from events where event_type = 'signup' and ts >= {NOW} - interval 24 hours and ts <= {NOW}) group by 1) p using (net)) s"""


@plan("free_risk", _RISK)
def free_risk(spark, d):
    s = table(spark, d, "events").where("event_type = 'signup'").withColumn("ts", F.col("ts").cast("timestamp_ntz")).selectExpr("user_id", "ts", "user_id % 60 as machine", "user_id div 2 as mailbox", "user_id % 5 as net")
    month = s.where(f"ts >= date_trunc('month', {NOW})")
    others = month.where("user_id % 11 = 0").groupBy("mailbox").agg(F.when(F.countDistinct("user_id") > 1, 1).otherwise(0).alias("others"))
    accounts = month.groupBy("machine").agg((F.countDistinct("user_id") - 1).alias("accounts"))
    pages = s.where(f"ts >= {NOW} - interval 24 hours and ts <= {NOW}").groupBy("net").agg(F.count("*").alias("pages"))
    u = s.select("user_id", "machine", "mailbox", "net").distinct().join(others, "mailbox", "left").join(accounts, "machine", "left").join(pages, "net", "left")
    return u.selectExpr("user_id", "case when user_id % 17 = 0 then 'disposable' when others > 0 then 'mailbox' when user_id % 3 = 0 then null when accounts >= 2 then 'device' when pages > 30 then 'ip' when user_id % 5 = 0 then 'new_account' end as risk")


@plan("preview_used", f"select user_id, least(greatest(mine, machine), 20)::bigint as used from (select user_id, count(*) as mine, max(m.n) as machine from events e join (select user_id % 60 as k, count(*) as n from events where ts > {NOW} - interval 24 hours and ts <= {NOW} group by 1) m on m.k = e.user_id % 60 where ts > {NOW} - interval 24 hours and ts <= {NOW} group by 1)")
def preview_used(spark, d):
    day = signals(spark, d).where(f"ts > {NOW} - interval 24 hours and ts <= {NOW}").withColumn("k", F.expr("user_id % 60"))
    mine, machine = day.groupBy("user_id", "k").agg(F.count("*").alias("mine")), day.groupBy("k").agg(F.count("*").alias("machine"))
    return mine.join(machine, "k").select("user_id", F.least(F.greatest("mine", "machine"), F.lit(20)).cast("long").alias("used"))


@plan("submission_rate", f"select event_id, count(*) over (partition by browser order by ts range between interval 6 hours preceding and current row) - 1 >= 5 or count(*) over (partition by ip order by ts range between interval 6 hours preceding and current row) - 1 >= 20 as refused from {SIGNALS}")
def submission_rate(spark, d):
    # a sparse table: 6 hours, where the service has 600 seconds
    return L.submission_rate(signals(spark, d), {"browser": 5, "ip": 20}, seconds=6 * 3600).select("event_id", "refused")




#: Sign-ups: two accounts share a mailbox.
_SIGNUPS = f"(select *, 'm' || (user_id // 2) as mailbox from {SIGNALS} where event_type = 'signup')"
_NEAR = "abs(cast(b.ts as date) - cast(a.ts as date)) <= 3"
_SUDDEN = " or ".join(f"len(list_distinct(list(b.email) filter (where b.{k} = a.{k} and b.ts <= a.ts and b.ts >= a.ts - interval 6 hours))) >= 2" for k in ("ip", "browser"))
_RELATED = f"""select a.event_id, a.mailbox, count(distinct b.email) filter (where b.email <> a.email and b.mailbox = a.mailbox) as same_mailbox, count(distinct b.email) filter (where b.email <> a.email and b.ip = a.ip and {_NEAR}) as same_ip,
count(distinct b.email) filter (where b.email <> a.email and b.browser = a.browser and {_NEAR}) as same_browser, {_SUDDEN} as rapid_sequence,
coalesce(array_to_string(list_sort(list_distinct(list(b.email) filter (where b.email <> a.email and (b.mailbox = a.mailbox or {_NEAR}))))[1:10], ','), '') as related
from {_SIGNUPS} a join {_SIGNUPS} b on b.ip = a.ip or b.browser = a.browser or b.mailbox = a.mailbox group by a.event_id, a.mailbox, a.ts"""


@plan("account_relations", _RELATED)
def account_relations(spark, d):
    s = signals(spark, d).where("event_type = 'signup'").withColumn("mailbox", F.expr("concat('m', user_id div 2)"))
    out = L.account_relations(s, days=3, rapid=2, seconds=6 * 3600)
    return out.select("event_id", "mailbox", "same_mailbox", "same_ip", "same_browser", "rapid_sequence", F.array_join("related", ",").alias("related"))


@plan("purge_signals", f"select event_id, case when ts >= {NOW} - interval 10 days then ip end as ip, case when ts >= {NOW} - interval 10 days then browser end as browser from {SIGNALS}")
def purge_signals(spark, d):
    return L.purge_signals(signals(spark, d), ("ip", "browser"), NOW, days=10).select("event_id", "ip", "browser")


@plan("anonymise_deleted", f"select event_id, case when user_id % 7 = 0 then sha256(email) else email end as email, case when user_id % 7 = 0 and event_type = 'view' then 'declined' else event_type end as status from {SIGNALS}")
def anonymise_deleted(spark, d):
    gone = F.expr("user_id % 7 = 0")
    return signals(spark, d).select("event_id", F.when(gone, F.sha2("email", 256)).otherwise(F.col("email")).alias("email"), F.when(gone & F.expr("event_type = 'view'"), "declined").otherwise(F.col("event_type")).alias("status"))


@plan("purge_grants", f"select event_type, count(*) as kept from events where ts >= {NOW} - case event_type when 'view' then interval 2 days when 'click' then interval 35 days else interval 5 days end group by 1")
def purge_grants(spark, d):
    kept = L.purge_grants(signals(spark, d), NOW, kind="event_type", days={"view": 2, "click": 35}, rest=5)
    return kept.groupBy("event_type").agg(F.count("*").alias("kept"))




_CHARS = "cast(floor(value * 10) as bigint)"
@plan("technical_bounds", "select event_id, row_number() over (partition by user_id, date_trunc('day', ts), event_type order by ts, event_id) <= case event_type when 'click' then 1 when 'view' then 2 else 3 end as allowed from events")
def technical_bounds(spark, d):
    calls = table(spark, d, "events").withColumn("page", F.date_trunc("day", "ts"))
    return L.technical_bounds(calls, ["user_id", "page"], "event_type", ["ts", "event_id"], {"click": 1, "view": 2}, rest=3).select("event_id", "allowed")


@plan("already_seen", "select event_id, coalesce(ts - lag(ts) over (partition by user_id, props order by ts, event_id) <= interval 10 days, false) as seen from events")
def already_seen(spark, d):
    return L.already_seen(table(spark, d, "events"), ["user_id"], "props", "ts", ["event_id"], days=10).select("event_id", "seen")


@plan("prefix_that_fits", f"select user_id, count(*) as texts from (select user_id, sum({_CHARS}) over (partition by user_id order by ts, event_id) as total from events) where total <= 1500 group by 1")
def prefix_that_fits(spark, d):
    total = F.sum(F.expr(_CHARS)).over(W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0))
    return table(spark, d, "events").withColumn("total", total).where("total <= 1500").groupBy("user_id").agg(F.count("*").alias("texts"))


_ASKED = "(select event_id, ts, user_id as sender, event_id % 97 as target, user_id % 97 as own from events where event_type = 'click')"
_RANGE = "range between interval {} preceding and current row) - 1 >= {}"


@plan("invitation_rules", f"""select event_id, case when target = own then 'own' when target in (select user_id from events where event_type = 'signup' and user_id % 4 = 0) then 'member'
  when ts - lag(ts) over (partition by sender, target order by ts, event_id) < interval 10 minutes then 'resend' when count(*) over (partition by sender, target order by ts {_RANGE.format('7 days', 1)} then 'pair'
  when count(*) over (partition by target order by ts {_RANGE.format('7 days', 5)} then 'address' when count(*) over (partition by sender order by ts {_RANGE.format('24 hours', 2)} then 'day' end as refused from {_ASKED}""")
def invitation_rules(spark, d):
    e = table(spark, d, "events")
    asked = e.where("event_type = 'click'").selectExpr("event_id", "ts", "user_id as sender", "event_id % 97 as target", "user_id % 97 as own")
    members = e.where("event_type = 'signup' and user_id % 4 = 0").select(F.col("user_id").alias("target"))
    return L.invitation_rules(asked, members, pair=1, per_day=2).select("event_id", "refused")


# ---- beta programmes: suppliers as campaigns, customers as enrolments ----

ENROL = "(select c_custkey as enrolment_id, c_custkey % (select count(*) from supplier) as campaign_id, c_custkey // 2 as mailbox, c_custkey % 11 = 0 as revoked, case when c_custkey % 3 <> 0 then timestamp '2024-01-01' + to_days((c_custkey % 25)::int) end as activated_at, timestamp '2023-12-01' + to_days((c_custkey % 40)::int) as invited_at from customer)"


def enrolments(spark, d):
    n = table(spark, d, "supplier").agg(F.count("*").alias("campaigns"))
    t = table(spark, d, "customer").join(F.broadcast(n))  # one row
    return t.selectExpr("c_custkey as enrolment_id", "c_custkey % campaigns as campaign_id", "c_custkey div 2 as mailbox", "c_custkey % 11 = 0 as revoked", "case when c_custkey % 3 <> 0 then timestamp_ntz '2024-01-01' + make_dt_interval(cast(c_custkey % 25 as int)) end as activated_at", "timestamp_ntz '2023-12-01' + make_dt_interval(cast(c_custkey % 40 as int)) as invited_at")


_STATE = f"case when revoked then 'revoked' when activated_at is null then 'invited' when activated_at + interval 10 days < {NOW} then 'expired' else 'active' end"


@plan("enrolment_state", f"select enrolment_id, {_STATE} as state from {ENROL}")
def enrolment_state(spark, d):
    return enrolments(spark, d).selectExpr("enrolment_id", f"{_STATE} as state")


@plan("capacity_used", f"select campaign_id, count(*) filter (where activated_at is not null or not revoked) as used, least(10 + campaign_id, 25) as capacity from {ENROL} group by 1")
def capacity_used(spark, d):
    return enrolments(spark, d).groupBy("campaign_id").agg(F.count_if(F.expr("activated_at is not null or not revoked")).alias("used")).selectExpr("campaign_id", "used", "least(10 + campaign_id, 25L) as capacity")


_FORMAT = "case l_linenumber % 4 when 0 then 'pdf' when 1 then 'docx' when 2 then 'pptx' else 'xlsx' end"


def format_use(spark, d):
    j = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.expr("l_orderkey = o_orderkey")).where("l_returnflag <> 'R'")
    return j.groupBy(F.col("o_custkey").alias("enrolment_id"), F.expr(_FORMAT).alias("format")).agg(F.sum(F.col("l_quantity").cast("long")).alias("units"), F.sum(F.expr("cast(l_quantity as bigint) * 90")).alias("words"))


FORMATS = f"(select o_custkey as enrolment_id, {_FORMAT} as format, sum(l_quantity)::bigint as units, sum(l_quantity * 90)::bigint as words from orders join lineitem on l_orderkey = o_orderkey where l_returnflag <> 'R' group by 1, 2)"
_LIMIT = "case format when 'pdf' then 400 when 'pptx' then 300 when 'docx' then 200 else 150 end + enrolment_id % 50"


@plan("format_totals", f"select * from {FORMATS}")
def format_totals(spark, d):
    return format_use(spark, d)


@plan("remaining_by_format", f"select enrolment_id, format, greatest({_LIMIT} - units, 0) as rest from {FORMATS}")
def remaining_by_format(spark, d):
    return format_use(spark, d).selectExpr("enrolment_id", "format", f"greatest({_LIMIT} - units, 0L) as rest")


@plan("cost_check", f"select enrolment_id, format, case when greatest({_LIMIT} - units, 0) < 20 then 'units' when format = 'xlsx' and words > 9000 then 'words' else 'ok' end as verdict from {FORMATS}")
def cost_check(spark, d):
    return format_use(spark, d).selectExpr("enrolment_id", "format", f"case when greatest({_LIMIT} - units, 0L) < 20 then 'units' when format = 'xlsx' and words > 9000 then 'words' else 'ok' end as verdict")


@plan("current_campaign", "select n_regionkey as programme, n_nationkey as campaign from (select *, row_number() over (partition by n_regionkey order by (n_nationkey % 3 = 0) desc, n_nationkey desc) as r from nation) where r = 1")
def current_campaign(spark, d):
    r = F.row_number().over(W.partitionBy("n_regionkey").orderBy(F.expr("n_nationkey % 3 = 0").desc(), F.desc("n_nationkey")))
    return table(spark, d, "nation").withColumn("r", r).where("r = 1").selectExpr("n_regionkey as programme", "n_nationkey as campaign")


@plan("best_enrolment", f"select mailbox, enrolment_id from (select *, row_number() over (partition by mailbox order by ({_STATE} = 'active') desc, activated_at desc nulls last, invited_at desc, enrolment_id) as r from {ENROL}) where r = 1")
def best_enrolment(spark, d):
    w = W.partitionBy("mailbox").orderBy(F.expr(f"{_STATE} = 'active'").desc(), F.col("activated_at").desc_nulls_last(), F.desc("invited_at"), "enrolment_id")
    return enrolments(spark, d).withColumn("r", F.row_number().over(w)).where("r = 1").select("mailbox", "enrolment_id")


@plan("access_elsewhere", f"select distinct a.enrolment_id from {ENROL} a join {ENROL} b on a.mailbox = b.mailbox and a.campaign_id <> b.campaign_id where {_STATE.replace('revoked', 'b.revoked', 1).replace('activated_at', 'b.activated_at')} = 'active'")
def access_elsewhere(spark, d):
    e = enrolments(spark, d).withColumn("state", F.expr(_STATE))
    active = e.where("state = 'active'").groupBy("mailbox").agg(F.collect_set("campaign_id").alias("c"))
    return e.join(active, "mailbox").where("size(array_remove(c, campaign_id)) > 0").select("enrolment_id")


_OUTCOME = "case when campaign_id % 4 = 0 then 'closed' when used >= least(10 + campaign_id, 25) then 'full' when activated_at is not null then 'invited already' else 'ok' end"


@plan("invite_outcome", f"select enrolment_id, {_OUTCOME} as outcome from {ENROL} join (select campaign_id, count(*) filter (where activated_at is not null or not revoked) as used from {ENROL} group by 1) using (campaign_id)")
def invite_outcome(spark, d):
    e = enrolments(spark, d)
    used = e.groupBy("campaign_id").agg(F.count_if(F.expr("activated_at is not null or not revoked")).alias("used"))
    return e.join(used, "campaign_id").selectExpr("enrolment_id", f"{_OUTCOME} as outcome")


@plan("programme_availability", f"select campaign_id, case when campaign_id % 5 = 0 then 'ended' when count(*) filter (where activated_at is not null or not revoked) >= 12 then 'full' when campaign_id % 2 = 0 then 'open' else 'closed' end as state from {ENROL} group by 1")
def programme_availability(spark, d):
    used = enrolments(spark, d).groupBy("campaign_id").agg(F.count_if(F.expr("activated_at is not null or not revoked")).alias("used"))
    return used.selectExpr("campaign_id", "case when campaign_id % 5 = 0 then 'ended' when used >= 12 then 'full' when campaign_id % 2 = 0 then 'open' else 'closed' end as state")


@plan("campaign_dashboard", f"select campaign_id, count(*) as enrolments, count(*) filter (where {_STATE} = 'active') as active, coalesce(sum(units), 0)::bigint as units from {ENROL} left join (select enrolment_id, sum(units) as units from {FORMATS} group by 1) using (enrolment_id) group by 1")
def campaign_dashboard(spark, d):
    units = format_use(spark, d).groupBy("enrolment_id").agg(F.sum("units").alias("units"))
    e = enrolments(spark, d).withColumn("active", F.expr(f"{_STATE} = 'active'")).join(units, "enrolment_id", "left")
    return e.groupBy("campaign_id").agg(F.count("*").alias("enrolments"), F.count_if("active").alias("active"), F.coalesce(F.sum("units"), F.lit(0).cast("long")).alias("units"))


@plan("beta_refund", f"select enrolment_id, format, case when format in ('pdf', 'pptx') then least(units, 60) when enrolment_id % 2 = 0 then units else 0 end as kept from {FORMATS}")
def beta_refund(spark, d):
    return format_use(spark, d).selectExpr("enrolment_id", "format", "case when format in ('pdf', 'pptx') then least(units, 60L) when enrolment_id % 2 = 0 then units else 0L end as kept")


# ---- logs: error events ----

_LEVEL = "case user_id % 3 when 0 then 'critical' when 1 then 'error' else 'warning' end"
_LOGS = f"(select event_id, ts, user_id, case event_id % 2 when 0 then 'browser' else 'server' end as source, {_LEVEL} as level, ' fault ' || props || ' ' as message, 'page' || user_id % 7 as location, case when event_id % 5 = 0 then 'handled' else 'new' end as status from events where event_type = 'error')"
_FP = "substr(sha256(source || '|' || level || '|' || location || '|' || substr(trim(message), 1, 200)), 1, 32)"


def logs(spark, d):
    t = table(spark, d, "events").where("event_type = 'error'").selectExpr("event_id", "cast(ts as timestamp_ntz) as ts", "user_id", "case event_id % 2 when 0 then 'browser' else 'server' end as source", f"{_LEVEL} as level", "' fault ' || props || ' ' as message", "concat('page', user_id % 7) as location", "case when event_id % 5 = 0 then 'handled' else 'new' end as status")
    return t.withColumn("fingerprint", I.fingerprint(*(F.col(c) for c in ("source", "level", "location", "message"))))


@plan("fingerprint", f"select event_id, {_FP} as fingerprint from {_LOGS}")
def fingerprint(spark, d):
    return logs(spark, d).select("event_id", "fingerprint")


@plan("truncate_text", "select doc_id, case when length(text) > 2000 then substr(text, 1, 2000) || '…[tronqué]' else text end as message from documents")
def truncate_text(spark, d):
    return table(spark, d, "documents").select("doc_id", I.truncated(F.col("text"), 2000).alias("message"))


@plan("error_groups", f"select {_FP} as fingerprint, source, level, max(message) as message, count(*) as n, count(*) filter (where status = 'new') as n_new, min(ts) as first_seen, max(ts) as last_seen from {_LOGS} group by 1, 2, 3 order by last_seen desc, fingerprint limit 200")
def error_groups(spark, d):
    g = logs(spark, d).groupBy("fingerprint", "source", "level").agg(F.max("message").alias("message"), F.count("*").alias("n"), F.count_if(F.col("status") == "new").alias("n_new"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return g.orderBy(F.desc("last_seen"), "fingerprint").limit(200)  # a page of the report


@plan("log_filters", f"select event_id from {_LOGS} where source = 'server' and level <> 'warning' and status = 'new' and strpos(lower(message), '\"k\": 9') > 0")
def log_filters(spark, d):
    return logs(spark, d).where("source = 'server' and level <> 'warning' and status = 'new'").where(F.lower("message").contains('"k": 9')).select("event_id")


@plan("group_occurrences", f"select fingerprint, event_id from (select event_id, {_FP} as fingerprint, row_number() over (partition by {_FP} order by ts desc, event_id desc) as r from {_LOGS}) where r <= 5")
def group_occurrences(spark, d):
    r = F.row_number().over(W.partitionBy("fingerprint").orderBy(F.desc("ts"), F.desc("event_id")))
    return logs(spark, d).withColumn("r", r).where("r <= 5").select("fingerprint", "event_id")


@plan("delete_guard", f"select {_FP} as fingerprint, bool_and(status <> 'new') as deletable from {_LOGS} group by 1")
def delete_guard(spark, d):
    return logs(spark, d).groupBy("fingerprint").agg(F.bool_and(F.col("status") != "new").alias("deletable"))


@plan("alert_level", f"select event_id, case when source = 'browser' and level = 'critical' then 'error' else level end as level from {_LOGS}")
def alert_level(spark, d):
    return logs(spark, d).selectExpr("event_id", "case when source = 'browser' and level = 'critical' then 'error' else level end as level")


@plan("top_errors", f"select {_FP} as fingerprint, count(*) as n from {_LOGS} where status = 'new' and level <> 'warning' and ts > {NOW} - interval 7 days and ts <= {NOW} group by 1 order by n desc, fingerprint limit 3")
def top_errors(spark, d):
    return L.top_errors(logs(spark, d), f"{NOW} - interval 7 days", NOW)


@plan("daily_recap", f"select day::varchar as day, accounts, warnings from (select cast(ts as date) as day, count(*) filter (where event_type = 'signup') as accounts, count(*) filter (where event_type = 'error' and user_id % 3 = 2) as warnings from events group by 1) where accounts + warnings > 0 and day < date '2024-01-20' and day not in (select cast(ts as date) from events where event_id % 9973 = 1)")
def daily_recap(spark, d):
    s = signals(spark, d).withColumn("day", F.to_date("ts"))
    days = s.groupBy("day").agg(F.count_if(F.expr("event_type = 'signup'")).alias("accounts"), F.count_if(F.expr("event_type = 'error' and user_id % 3 = 2")).alias("warnings"))
    sent = s.where("event_id % 9973 = 1").select("day").distinct()  # the ledger of recaps sent
    return days.where("accounts + warnings > 0 and day < date '2024-01-20'").join(sent, "day", "left_anti").withColumn("day", F.col("day").cast("string"))


@plan("client_dedup", f"select event_id from (select event_id, ts - lag(ts) over (partition by user_id, location order by ts, event_id) as gap from {_LOGS}) where gap is null or gap > interval 10 hours")
def client_dedup(spark, d):
    return L.client_dedup(logs(spark, d), ["user_id", "location"], "ts", ["event_id"], seconds=36_000).select("event_id")


@plan("ticket_list", f"select location as category, status, count(*) as n, max(ts) as newest from {_LOGS} where strpos(lower(message), 'fault') > 0 group by 1, 2")
def ticket_list(spark, d):
    return logs(spark, d).where(F.lower("message").contains("fault")).groupBy(F.col("location").alias("category"), "status").agg(F.count("*").alias("n"), F.max("ts").alias("newest"))


# ---- library and retention: documents, with a customer as owner ----

_DOCS = "(select doc_id, source, lang, n_chars, doc_id % (select count(*) from customer) as owner, timestamp '2023-12-15' + to_days((doc_id % 40)::int) as created_at from documents)"


def library(spark, d):
    n = table(spark, d, "customer").agg(F.count("*").alias("n"))
    return table(spark, d, "documents").join(F.broadcast(n)).selectExpr("doc_id", "source", "lang", "n_chars", "doc_id % n as owner", "timestamp_ntz '2023-12-15' + make_dt_interval(cast(doc_id % 40 as int)) as created_at")  # n is one row


@plan("admin_documents", f"select doc_id, c_name, created_at from {_DOCS} join customer on c_custkey = owner where strpos(lower(c_name), '1') > 0 order by created_at desc, doc_id limit 50")
def admin_documents(spark, d):
    j = library(spark, d).join(table(spark, d, "customer"), F.expr("c_custkey = owner")).where(F.lower("c_name").contains("1"))
    return j.orderBy(F.desc("created_at"), "doc_id").limit(50).select("doc_id", "c_name", "created_at")  # a page of the listing


@plan("user_documents", f"select owner, doc_id, row_number() over (partition by owner order by created_at desc, doc_id) as place from {_DOCS}")
def user_documents(spark, d):
    return library(spark, d).select("owner", "doc_id", F.row_number().over(W.partitionBy("owner").orderBy(F.desc("created_at"), "doc_id")).alias("place"))


@plan("scan_follow_up", "select conv_id, count(*) as pending from conversations c where turn % 3 = 1 and not exists (select 1 from conversations x where x.conv_id = c.conv_id and x.turn = c.turn + 2) group by 1")
def scan_follow_up(spark, d):
    c = table(spark, d, "conversations")
    decided = c.select("conv_id", (F.col("turn") - 2).alias("turn"))
    return c.where("turn % 3 = 1").join(decided, ["conv_id", "turn"], "left_anti").groupBy("conv_id").agg(F.count("*").alias("pending"))


_CLASS = f"case when doc_id % 5 = 0 then 'render' when doc_id % 5 = 1 and created_at < {NOW} - interval 7 days then 'old translation' when lang = 'fr' then 'job' else 'kept' end"


@plan("store_sweep", f"select {_CLASS} as class, count(*) as files, sum(n_chars)::bigint as bytes from {_DOCS} group by 1")
def store_sweep(spark, d):
    return library(spark, d).groupBy(F.expr(_CLASS).alias("class")).agg(F.count("*").alias("files"), F.sum("n_chars").alias("bytes"))


_AGE = "select doc_id from (select doc_id, source, sum(n_chars) over (partition by source order by created_at desc, doc_id desc) as newer, sum(n_chars) over (partition by source) as total from " + _DOCS + ") where newer > 50000"


@plan("lru_to_size", _AGE)
def lru_to_size(spark, d):
    # one store per source: what no longer fits, from the newest on
    newer = F.sum("n_chars").over(W.partitionBy("source").orderBy(F.desc("created_at"), F.desc("doc_id")).rowsBetween(W.unboundedPreceding, 0))
    return library(spark, d).withColumn("newer", newer).where("newer > 50000").select("doc_id")


@plan("memory_evict", f"select doc_id from (select doc_id, created_at, count(*) over w as k, sum(n_chars) over w as size from {_DOCS} window w as (partition by source order by created_at desc, doc_id desc)) where created_at < {NOW} - interval 30 days or k > 40 or size > 90000")
def memory_evict(spark, d):
    w = W.partitionBy("source").orderBy(F.desc("created_at"), F.desc("doc_id")).rowsBetween(W.unboundedPreceding, 0)
    t = library(spark, d).withColumn("k", F.count("*").over(w)).withColumn("size", F.sum("n_chars").over(w))
    return t.where(f"created_at < {NOW} - interval 30 days or k > 40 or size > 90000").select("doc_id")


_PURGE = f"case when created_at <= {NOW} - interval 30 days and doc_id % 2 = 0 then 'delete' when created_at <= {NOW} - interval 25 days then 'remind' else 'keep' end"


@plan("preview_purge", f"select owner, {_PURGE} as action, string_agg(doc_id::varchar, ',' order by doc_id) as docs from {_DOCS} group by 1, 2")
def preview_purge(spark, d):
    g = library(spark, d).groupBy("owner", F.expr(_PURGE).alias("action")).agg(F.array_sort(F.collect_list("doc_id")).alias("docs"))
    return g.select("owner", "action", F.array_join(F.transform("docs", lambda x: x.cast("string")), ",").alias("docs"))


@plan("storage_balance", f"select owner, greatest(sum(case when doc_id % 3 = 0 then -n_chars else n_chars end), 0)::bigint as used from {_DOCS} group by 1")
def storage_balance(spark, d):
    return library(spark, d).groupBy("owner").agg(F.greatest(F.sum(F.expr("case when doc_id % 3 = 0 then -n_chars else n_chars end")), F.lit(0)).alias("used"))


@plan("interrupted_jobs", "select o_orderkey, 'interrupted' as status, count(l_linenumber) filter (where l_linestatus = 'F') as done from orders left join lineitem on l_orderkey = o_orderkey where o_orderstatus = 'P' group by 1")
def interrupted_jobs(spark, d):
    j = table(spark, d, "orders").where("o_orderstatus = 'P'").join(table(spark, d, "lineitem"), F.expr("l_orderkey = o_orderkey"), "left")
    return j.groupBy("o_orderkey").agg(F.lit("interrupted").alias("status"), F.count_if(F.coalesce(F.col("l_linestatus") == "F", F.lit(False))).alias("done"))


@plan("purge_invitations", f"select count(*) as kept, min(ts) as oldest from events where event_type = 'click' and ts >= {NOW} - interval 15 days")
def purge_invitations(spark, d):
    kept = L.younger(signals(spark, d).where("event_type = 'click'"), NOW, days=15)
    return kept.agg(F.count("*").alias("kept"), F.min("ts").alias("oldest"))


@plan("catalogue_flat", "select p_partkey, language, coalesce(case when language = 'en' and p_partkey % 3 <> 0 then p_name || ' (en)' end, p_name) as title from part, (values ('fr'), ('en')) l(language) where p_size <> 1")
def catalogue_flat(spark, d):
    texts = F.create_map(F.lit("fr"), F.col("p_name"), F.lit("en"), F.expr("case when p_partkey % 3 <> 0 then p_name || ' (en)' end"))
    t = table(spark, d, "part").where("p_size <> 1").withColumn("texts", texts).withColumn("language", F.explode(F.array(F.lit("fr"), F.lit("en"))))
    return t.select("p_partkey", "language", F.coalesce(F.col("texts")[F.col("language")], F.col("texts")["fr"]).alias("title"))


@plan("highlights", "select p_partkey, p_size from part where p_type = 'ECONOMY' order by p_size desc, p_partkey desc limit 4")
def highlights(spark, d):
    return table(spark, d, "part").where("p_type = 'ECONOMY'").orderBy(F.desc("p_size"), F.desc("p_partkey")).limit(4).select("p_partkey", "p_size")


_NEWS = "(select distinct cast(ts as date) as day from events where event_type = 'signup')"


@plan("since_last_visit", f"select user_id, case when seen is null then (select count(*) from (select day from {_NEWS} order by day desc limit 4)) else (select count(*) from {_NEWS} n where n.day > cast(u.seen as date)) end as news from (select user_id, max(case when event_type = 'view' then ts end) as seen from events group by 1) u")
def since_last_visit(spark, d):
    # news per day are summed from the end, so that a visit day finds its number by one equi-join
    s = signals(spark, d).withColumn("day", F.to_date("ts"))
    news = s.where("event_type = 'signup'").select("day").distinct().withColumn("n", F.lit(1))
    seen = s.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "view", F.col("day"))).alias("day"))
    days = s.select("day").distinct().join(news, "day", "left")
    later = F.coalesce(F.sum("n").over(W.partitionBy(F.lit(0)).orderBy(F.desc("day")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a day
    # who was never seen gets the highlights: the four newest
    first = news.agg(F.least(F.count("*"), F.lit(4)).alias("highlights"))
    out = seen.join(days.withColumn("news", later), "day", "left").join(F.broadcast(first))  # one row
    return out.select("user_id", F.when(F.col("day").isNull(), F.col("highlights")).otherwise(F.col("news")).cast("long").alias("news"))


@plan("recipients", "select c_custkey, row_number() over (partition by c_nationkey order by c_custkey) as place from customer where c_custkey % 4 <> 0 and c_custkey not in (select user_id from events where event_type = 'purchase')")
def recipients(spark, d):
    sent = table(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("c_custkey")).distinct()
    left = table(spark, d, "customer").where("c_custkey % 4 <> 0").join(sent, "c_custkey", "left_anti")
    return left.select("c_custkey", F.row_number().over(W.partitionBy("c_nationkey").orderBy("c_custkey")).alias("place"))


@plan("release_selection", "select p_type, p_partkey, n - 8 as others from (select p_type, p_partkey, row_number() over (partition by p_type order by p_size desc, p_partkey) as r, count(*) over (partition by p_type) as n from part) where r <= 8")
def release_selection(spark, d):
    w = W.partitionBy("p_type")
    t = table(spark, d, "part").withColumn("r", F.row_number().over(w.orderBy(F.desc("p_size"), "p_partkey"))).withColumn("n", F.count("*").over(w))
    return t.where("r <= 8").select("p_type", "p_partkey", (F.col("n") - 8).alias("others"))


@plan("insert_if_absent", "select user_id, coalesce(min(event_id) filter (where event_type = 'view'), min(event_id)) as event_id from events group by 1")
def insert_new(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    there = e.where("event_type = 'view'").groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    return insert_if_absent(there, e.select("user_id", "event_id"), ["user_id"], "event_id")
