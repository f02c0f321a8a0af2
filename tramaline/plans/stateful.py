"""Plans whose rules carry state over rows, trees or graphs: budgets of pages, keyed tables, machines, tag trees, roots."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tramaline.functions.tags import tag_tree_ok
from tramaline.operators.machines import link_machines
from tramaline.operators.stores import orphan_roots
from tramaline.operators.tables import stored, upsert_latest
from tramaline.operators.usage import Allowance, page_limits
from tramaline.plans.base import PAIRS, Plans, pairs
from tramaline.session import shared_folder, table

plan = Plans()
QUERIES, SQL = plan.queries, plan.sql

# ---- budgets of pages ----

_ASKED = "cast(floor(value * 10) as bigint) as chars, case event_type when 'view' then 1 when 'click' then 2 else 0 end as images, event_type = 'error' as back"
#: As recursion: a user's pages are a list in the state, from which each request's page is taken and put back.
_TAKEN = f"""with recursive asked as (select user_id, event_id, event_id % 7 as page, cast(ts as date) as day, {_ASKED}, case user_id % 4 when 0 then 300 when 1 then 800 when 2 then null else 300 end as most_chars,
  case user_id % 4 when 0 then 1 when 1 then 2 when 2 then null else 1 end as most_images, case user_id % 4 when 0 then 2 when 1 then 3 when 2 then 4 else 2 end as most_pages, row_number() over (partition by user_id order by ts, event_id) as r from events),
f(user_id, r, event_id, pages, chars_granted, images_granted, refused) as (
  select distinct user_id, 0::bigint, null::bigint, []::struct(page bigint, chars bigint, images bigint, day date)[], 0::bigint, 0::bigint, null::varchar from events
  union all
  select user_id, r, event_id, list_concat(list_filter(pages, lambda x: x.page <> page), case when new_chars > 0 or new_images > 0 then [{{'page': page, 'chars': new_chars, 'images': new_images, 'day': coalesce(own.day, day)}}] else [] end),
    given_chars, given_images, case when back then null when closed then 'pages' when given_chars < chars then 'chars' when given_images < images then 'images' end
  from (select *, case when back then greatest(0, coalesce(own.chars, 0) - chars) else coalesce(own.chars, 0) + given_chars end as new_chars, case when back then greatest(0, coalesce(own.images, 0) - images) else coalesce(own.images, 0) + given_images end as new_images
  from (select *, case when back or closed then 0 when most_chars is null then chars else greatest(0, least(chars, most_chars - coalesce(own.chars, 0))) end as given_chars, case when back or closed then 0 when most_images is null then images else greatest(0, least(images, most_images - coalesce(own.images, 0))) end as given_images
  from (select *, own is null and len(list_filter(pages, lambda x: x.day = day)) >= most_pages as closed
  from (select a.*, f.pages, list_filter(f.pages, lambda x: x.page = a.page)[1] as own from f join asked a on a.user_id = f.user_id and a.r = f.r + 1)))))
select user_id, event_id, chars_granted, images_granted, refused from f where r > 0"""


@plan("page_limits", _TAKEN)
def limits(spark, d):
    small = {"free": Allowance(300, 1, 2), "starter": Allowance(800, 2, 3), "pro": Allowance(None, None, 4)}
    asked = table(spark, d, "events").selectExpr("user_id", "ts", "event_id", "event_id % 7 as page", "to_date(ts) as day", "cast(floor(value * 10) as bigint) as chars", "case event_type when 'view' then 1 when 'click' then 2 else 0 end as images", "event_type = 'error' as back", "case user_id % 4 when 1 then 'starter' when 2 then 'admin' when 3 then 'unknown' else 'free' end as plan")
    return page_limits(asked, "user_id", "page", "day", ["ts", "event_id"], "chars", "images", "plan", returns="back", plans=small).drop("ts")


# ---- a keyed table ----


@plan("upsert_seen", "select user_id, props as key, max(cast(ts as date))::varchar as day from events group by 1, 2")
def upsert_seen(spark, d):
    # two batches into a stored table, the second one again, as after a failure
    path = f"{shared_folder(spark)}/seen-{uuid.uuid4().hex}"
    events = table(spark, d, "events").select("event_id", "user_id", F.col("props").alias("key"), F.to_date("ts").alias("day"))
    for batch in (0, 1, 1):
        upsert_latest(events.where(F.col("event_id") % 2 == batch).drop("event_id"), batch, path, ["user_id", "key"], "day", parts=16)
    return stored(spark, path).select("user_id", "key", F.col("day").cast("string").alias("day"))


# ---- the store ----

_PATH = r"regexp_extract(url, '^https?://([^?#]+)', 1)"
_ROOTS = f"(select distinct array_to_string(string_split({_PATH}, '/')[1:n], '/') as root from pages, range(1, 3) t(n))"


@plan("orphan_roots", f"select root from {_ROOTS} r where not exists (select 1 from pages where page_id % 5 = 0 and ({_PATH} = root or starts_with({_PATH}, root || '/')))")
def roots_of_pages(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^?#]+)", 1).alias("path"))
    first = lambda n: F.array_join(F.slice(F.split("path", "/"), 1, n), "/")
    roots = pages.select(F.explode(F.array(first(1), first(2))).alias("root")).distinct()
    return orphan_roots(roots, pages.where("page_id % 5 = 0"))


# ---- machines ----

#: Visits of accounts: a browser that is cleared now and then, a copy of the extension, a print shared by many.
_VISITS = "select ts, event_id, case when event_id % 3 > 0 then user_id * 1000 + event_id // 4000 end as cookie, case when event_id % 5 > 1 then user_id * 100 + event_id // 3000 end as copy, case when event_id % 2 = 0 then user_id % 50 end as print from events where event_type = 'signup'"


@plan("link_machines", f"""with recursive v as ({_VISITS}), ids as (select * from (select row_number() over (order by ts, event_id) as v_no, 'cookie:' || cookie as cookie, 'copy:' || copy as copy, 'print:' || print as print from v) unpivot (node for kind in (cookie, copy, print))),
ranked as (select *, case kind when 'cookie' then 0 when 'copy' then 1 else 2 end as rank, min(v_no) over (partition by node) as since from ids), first as (select node, min((v_no * 3 + rank)) as age from ranked group by node),
visit as (select v_no, max(node) filter (where rank = 0) as cookie, max(node) filter (where rank = 1) as copy, max(node) filter (where rank = 2) as print, max(since) filter (where rank = 2) as print_since, coalesce(min(since) filter (where rank < 2), v_no) = v_no as strange from ranked group by v_no),
edge as (select cookie as a, copy as b from visit where cookie is not null and copy is not null union select coalesce(cookie, copy), print from visit where coalesce(cookie, copy) is not null and print is not null and (strange or print_since = v_no)),
both_ways as (select a, b from edge union select b, a from edge), reach(node, seen) as (select node, node from first union select r.node, w.b from reach r join both_ways w on w.a = r.seen)
select split_part(r.node, ':', 1) as kind, split_part(r.node, ':', 2) as id, arg_min(seen, f.age) as machine from reach r join first f on f.node = r.seen group by r.node""")
def machines(spark, d):
    visits = table(spark, d, "events").where("event_type = 'signup'").selectExpr("ts", "event_id", "if(event_id % 3 > 0, user_id * 1000 + event_id div 4000, null) as cookie", "if(event_id % 5 > 1, user_id * 100 + event_id div 3000, null) as copy", "if(event_id % 2 = 0, user_id % 50, null) as print")
    return link_machines(visits, ["ts", "event_id"])


# ---- tag trees ----

_WRAPPED = "case conv_id % 6 when 0 then '[[4]]' || target || '[[5]][[/5]][[/4]]' when 1 then target || '[[4]][[5]][[/5]][[/4]]' when 2 then '[[4]]' || target || '[[5]]x[[/5]][[/4]]' when 3 then '[[4]]' || target || '[[5]][[/4]][[/5]]' when 4 then '[[4]]' || target || target || '[[5]][[/5]][[/4]]' else ' [[4]] [[5]] [[/5]]' || target || '[[/4]]' end"
#: Texts tag by tag: the stack of open elements, all elements so far with their parents, and whether it is a tree yet.
_PARSED = rf"""with recursive t as (select conv_id, seq, '[[4]]' || source || '[[5]][[/5]][[/4]]' as source, {_WRAPPED} as target from {PAIRS}),
texts as (select conv_id, seq, 'source' as side, source as text from t union all select conv_id, seq, 'target', target from t),
tags as (select conv_id, seq, side, regexp_extract_all(text, '\[\[/?\d+\]\]') as tags from texts),
p(conv_id, seq, side, tags, i, stack, met, ok) as (select conv_id, seq, side, tags, 0::bigint, []::bigint[], []::struct(n bigint, parent bigint)[], true from tags
  union all select conv_id, seq, side, tags, i + 1, case when ends then stack[:-2] else list_append(stack, n) end, case when ends then met else list_append(met, {{'n': n, 'parent': stack[-1]}}) end,
    ok and case when ends then coalesce(stack[-1] = n, false) else len(list_filter(met, lambda x: x.n = n)) = 0 end
  from (select *, starts_with(tags[i + 1], '[[/') as ends, regexp_extract(tags[i + 1], '\d+')::bigint as n from p where i < len(tags))),
tree as (select conv_id, seq, side, ok and len(stack) = 0 as ok, list_sort(met) as met from p where i = len(tags))
select t.conv_id, t.seq, s.ok and g.ok and s.met = g.met and not (contains(target, '[[5]]') and not regexp_matches(target, '\[\[5\]\]\s*\[\[/5\]\]')) as ok
from t join tree s on s.conv_id = t.conv_id and s.seq = t.seq and s.side = 'source' join tree g on g.conv_id = t.conv_id and g.seq = t.seq and g.side = 'target'"""


@plan("tag_tree_ok", _PARSED)
def tag_trees(spark, d):
    wrapped = pairs(spark, d).select("conv_id", "seq", F.concat(F.lit("[[4]]"), "source", F.lit("[[5]][[/5]][[/4]]")).alias("source"), F.expr(_WRAPPED).alias("target"))
    return wrapped.select("conv_id", "seq", tag_tree_ok("target", "source", F.array(F.lit(5))).alias("ok"))
