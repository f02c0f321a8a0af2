"""Further plans: ordered rules over documents, caches, payment evidence, listings."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tramaline.functions import text as T
from tramaline.operators.folds import apply_plans, redistribute_runs, spread_sample, title_safe_batches, typed_batches
from tramaline.operators.contexts import page_context
from tramaline.plans.base import NOW_EVENTS, PAIRS, SEGMENTS, Plans, pairs, segments
from tramaline.plans.layout import walk
from tramaline.plans.ledger import PAYMENTS, payments
from tramaline.session import table

plan = Plans()
QUERIES, SQL = plan.queries, plan.sql
NOW = f"timestamp '{NOW_EVENTS}'"


_FLAGS = f"(select doc_id, seq, length(text) <= 80 and seq % 4 = 3 as title, row_number() over (partition by doc_id order by seq) as r from {SEGMENTS})"
_FILLED = walk(_FLAGS, "doc_id", "seq, title, batch, held, titles", "seq, title, 0::bigint, 1, title::int", "s.seq, s.title, f.batch + (f.held = 5)::int, case when f.held = 5 then f.titles else f.held end + 1, case when s.title then f.titles + 1 else 0 end", "seq, title, batch")


# titles go where the next other row goes; there are never five of them in a row
@plan("title_safe_batches", f"select doc_id, seq, coalesce(min(case when not title then batch end) over (partition by doc_id order by seq rows between current row and unbounded following), max(batch) over (partition by doc_id)) as batch from ({_FILLED})")
def safe_batches(spark, d):
    rows = segments(spark, d).withColumn("title", (F.length("text") <= 80) & (F.col("seq") % 4 == 3))
    return title_safe_batches(rows.select("doc_id", "seq", "title"), ["doc_id"], 5)


_NEXT = "f.n = 10 or (f.n >= 5 and s.kind <> f.kind)"
_KINDS = f"(select doc_id, seq, seq // 3 % 2 as kind, row_number() over (partition by doc_id order by seq) as r from {SEGMENTS})"


@plan("typed_batches", walk(_KINDS, "doc_id", "seq, batch, n, kind", "seq, 0::bigint, 1, kind", f"s.seq, f.batch + ({_NEXT})::int, case when {_NEXT} then 1 else f.n + 1 end, s.kind", "seq, batch"))
def kinds_apart(spark, d):
    # a batch closes once it holds 5 lines and the kind of line changes; at 10 lines in any case
    rows = segments(spark, d).selectExpr("doc_id", "seq", "seq div 3 % 2 as kind")
    return typed_batches(rows, ["doc_id"], 5, 10)


_TEXTS = f"(select doc_id, seq, trim(text) as text, length(trim(text)) as n, sum(length(trim(text))) over (partition by doc_id) as total, row_number() over (partition by doc_id order by seq) as r from {SEGMENTS})"
_STEP = "greatest(length(substr(s.text, 1, 400)) * s.total / 600.0::double, 1.0)"


@plan("spread_sample", walk(_TEXTS, "doc_id", "seq, excerpt, past, due, taken", "seq, case when total <= 600 then text else substr(text, 1, 400) end, n, " + _STEP.replace("s.", "") + ", true",
      f"s.seq, case when s.total <= 600 then s.text else substr(s.text, 1, 400) end, f.past + s.n, case when f.past >= f.due then f.due + {_STEP} else f.due end, s.total <= 600 or f.past >= f.due", "seq, excerpt") + " where taken")
def sample(spark, d):
    return spread_sample(segments(spark, d).select("doc_id", "seq", "text"), "doc_id", 600)


#: Pages of 40 lines, batches of 10; every tenth line is a title. Where each batch stands in its page's text.
_MARKED = f"(select doc_id, seq // 40 as page, seq // 10 as batch, seq, case when seq % 10 = 0 then '# ' else '' end || text as line from {SEGMENTS})"
_PLACED = f"(select *, sum(length(line) + 1) over (partition by doc_id, page order by seq) as past from {_MARKED})"
_SPANS = f"(select doc_id, page, batch, min(past - length(line) - 1) as lo, max(past - 1) as hi from {_PLACED} group by 1, 2, 3)"
_WHOLE = f"(select doc_id, page, string_agg(line, chr(10) order by seq) as text from {_MARKED} group by 1, 2)"


@plan("page_context", f"select doc_id, page, batch, substr(text, 1 + greatest(0, least(length(text) - 2500, (lo + hi) // 2 - 1250))::bigint, 2500) as context from {_SPANS} join {_WHOLE} using (doc_id, page)")
def contexts(spark, d):
    line = F.concat(F.when(F.col("seq") % 10 == 0, "# ").otherwise(""), F.col("text"))
    lines = segments(spark, d).select("doc_id", F.expr("seq div 40").alias("page"), F.expr("seq div 10").alias("batch"), "seq", line.alias("line"))
    return page_context(lines, ["doc_id", "page"])


# runs 0 and 1, which a space parts; where the translation lacks run 1, its words are shared if there are two or more
_RUN = r"regexp_extract({}, '\[\[{}\]\]([^\[]*)\[\[/{}\]\]', 1)"
_RUN_TEXTS = rf"(select conv_id, seq, strpos(target, '[[1]]') > 0 as whole, {_RUN.format('source', 0, 0)} as s0, {_RUN.format('source', 1, 1)} as s1, {_RUN.format('target', 0, 0)} as t0, {_RUN.format('target', 1, 1)} as t1, trim(regexp_replace(target, '\[\[/?\d+\]\]', '', 'g')) as bare from {PAIRS})"
_SHARES = rf"(select *, len(w) >= 2 as enough, greatest(1, least(round_even(len(w) * (length(s0) + 1) / greatest(length(s0) + 1 + length(s1), 1), 0)::int, len(w) - 1)) as n, length(trim(s0)) >= length(trim(s1)) as first from (select *, list_filter(regexp_split_to_array(bare, '\s+'), lambda x: x <> '') as w from {_RUN_TEXTS}))"


@plan("redistribute_runs", f"""select conv_id, seq, 0::bigint as run, case when whole then t0 when enough then array_to_string(w[1:n], ' ') || ' ' when first then bare else '' end as text from {_SHARES}
union all select conv_id, seq, 1, case when whole then t1 when enough then array_to_string(w[n + 1:], ' ') when first then '' else bare end from {_SHARES}""")
def runs(spark, d):
    p = pairs(spark, d)
    source = T.tag_contents("source")
    parts = F.transform(F.array_sort(F.map_keys(source)), lambda i: F.concat(F.element_at(source, i), F.when(i == 0, " ").otherwise("")))
    return redistribute_runs(p.select("conv_id", "seq", parts.alias("parts"), T.tag_contents("target").alias("found"), F.trim(T.strip_tags("target")).alias("bare")), ["conv_id", "seq"])


@plan("image_cache_hits", "select a.l_orderkey, a.l_linenumber, a.l_partkey, bool_or(b.l_shipdate is not null) as hit from lineitem a left join (select distinct l_partkey, l_shipdate from lineitem where l_returnflag = 'A') b on b.l_partkey = a.l_partkey and b.l_shipdate < a.l_shipdate and b.l_shipdate >= a.l_shipdate - interval 30 days group by a.l_orderkey, a.l_linenumber, a.l_partkey, a.l_shipdate, a.l_quantity, a.l_extendedprice")
def image_cache_hits(spark, d):
    # the last stored version before a request decides: one window per image instead of a join by time
    li = table(spark, d, "lineitem")
    day = F.unix_date(F.to_date("l_shipdate"))
    stored = F.max(F.when(F.col("l_returnflag") == "A", day)).over(W.partitionBy("l_partkey").orderBy(day).rangeBetween(-30, -1))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", stored.isNotNull().alias("hit"))


_PAID = f"(select user_id, payment_id, plan, months, case plan when 'starter' then 790 else 1990 end as price, case plan when 'starter' then 1 else 2 end as rank, created_at, row_number() over (partition by user_id order by created_at, payment_id) as r from {PAYMENTS} where status = 'SUCCESSFUL' and plan is not null)"
_RUNS, _LOWER, _SAME = "f.ends > s.created_at", "f.ends > s.created_at and f.rank > s.rank", "f.ends > s.created_at and f.plan = s.plan"
_START = f"case when {_SAME} then f.ends when {_RUNS} then s.created_at + to_seconds(floor(epoch(f.ends - s.created_at))::bigint * f.price // s.price) else s.created_at end"
_ENDS = f"{_START} + to_months(s.months::int)"
_KEPT = lambda x, new: f"case when {_LOWER} then f.{x} else {new} end"


@plan("apply_plan", walk(_PAID, "user_id", "payment_id, kind, expires_at, plan, rank, price, ends", "payment_id, 'subscription', created_at + to_months(months::int), plan, rank, price, created_at + to_months(months::int)",
      f"s.payment_id, case when {_LOWER} then 'refund_due' when {_SAME} then 'renewal' else 'subscription' end, case when not ({_LOWER}) then {_ENDS} end, {_KEPT('plan', 's.plan')}, {_KEPT('rank', 's.rank')}, {_KEPT('price', 's.price')}, {_KEPT('ends', _ENDS)}",
      "payment_id, kind, expires_at"))
def plans_applied(spark, d):
    p = payments(spark, d).where("status = 'SUCCESSFUL' and plan is not null")
    p = p.select("user_id", "payment_id", "plan", "months", F.expr("case plan when 'starter' then 790 else 1990 end").alias("price"), F.col("created_at").cast("timestamp").alias("created_at"))
    return apply_plans(p, {"starter": 1, "pro": 2})


@plan("mark_handled", "select user_id, count(*) as handled from events where event_type = 'error' and event_id % 5 <> 0 group by 1")
def mark_handled(spark, d):
    t = table(spark, d, "events").where("event_type = 'error'").selectExpr("user_id", "if(event_id % 5 = 0, 'handled', 'new') as before").withColumn("after", F.lit("handled"))
    return t.where("before <> after").groupBy("user_id").agg(F.count("*").alias("handled"))


@plan("ticket_guard", "select user_id, bool_and(event_id % 4 <> 0) as deletable from events where event_type = 'error' group by 1")
def ticket_guard(spark, d):
    t = table(spark, d, "events").where("event_type = 'error'").selectExpr("user_id", "event_id % 4 = 0 as open")
    return t.groupBy("user_id").agg((F.count_if("open") == 0).alias("deletable"))


@plan("admin_users", "select c_custkey, c_name, case c_mktsegment when 'MACHINERY' then 2 when 'BUILDING' then 1 else 0 end as priority from customer where strpos(lower(c_name), '00') > 0 order by c_custkey desc limit 100")
def admin_users(spark, d):
    t = table(spark, d, "customer").where(F.lower("c_name").contains("00"))
    return t.selectExpr("c_custkey", "c_name", "case c_mktsegment when 'MACHINERY' then 2 when 'BUILDING' then 1 else 0 end as priority").orderBy(F.desc("c_custkey")).limit(100)  # a page of the listing


@plan("recruitment_open", f"select s_suppkey, s_suppkey % 3 <> 0 and timestamp '2024-01-01' + to_days((s_suppkey % 40)::int) <= {NOW} as open, case when timestamp '2024-01-01' + to_days((s_suppkey % 40)::int) + interval 1 month > {NOW} then least(20, 10 + s_suppkey) else 10 + s_suppkey end as capacity from supplier")
def recruitment_open(spark, d):
    t = table(spark, d, "supplier").withColumn("start", F.expr("timestamp '2024-01-01' + make_dt_interval(cast(s_suppkey % 40 as int))"))
    return t.selectExpr("s_suppkey", f"s_suppkey % 3 <> 0 and start <= {NOW} as open", f"case when start + interval 1 month > {NOW} then least(20L, 10 + s_suppkey) else 10 + s_suppkey end as capacity")
