"""Plans of one document at a time: memory (D), contexts (E) and admission (H14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tramaline.operators.admission import admission
from tramaline.operators.folds import spread_sample
from tramaline.operators.memory import brief_material, distinct_texts, document_memory, harmonised, neighbours
from tramaline.plans.base import SEGMENTS, TAGGED, Plans, segments, tagged
from tramaline.plans.ledger import _SUMMARY, USERS, summary
from tramaline.plans.more import SQL as MORE

plan = Plans()
QUERIES, SQL = plan.queries, plan.sql

_LETTERS = r"length(regexp_replace({}, '\P{{L}}', '', 'g'))"
#: Lines as a list of short texts that come again: their first word, with its first letter as written.
_FIRST = f"(select doc_id, seq, string_split(text, ' ')[1] as text from {SEGMENTS})"


def _first_words(spark, d):
    return segments(spark, d).select("doc_id", "seq", F.split("text", " ")[0].alias("text"))


@plan("dedup_texts", f"""select doc_id, seq, text, place from {_FIRST} left join (select doc_id, text, row_number() over (partition by doc_id order by min(seq)) as place from {_FIRST} where {_LETTERS.format('text')} > 0 group by 1, 2) using (doc_id, text)""")
def dedup_texts(spark, d):
    return distinct_texts(_first_words(spark, d), ["doc_id"], ["seq"])


#: Words translated one way or another, some left as they are, some not translated.
_VERSIONS = f"(select *, case seq % 5 when 0 then text when 4 then null else text || ' v' || seq % 3 end as translation from {_FIRST})"


@plan("harmonise", f"""select doc_id, seq, text, case when translation is not null and trim(text) <> '' then best else translation end as translation from {_VERSIONS} left join
(select doc_id, text, translation as best from (select *, row_number() over (partition by doc_id, text order by votes desc, same desc, first) as r from (
select doc_id, text, translation, count(*) as votes, text = translation as same, min(seq) as first from {_VERSIONS} where translation is not null group by all)) where r = 1) using (doc_id, text)""")
def harmonise(spark, d):
    versions = F.expr("case seq % 5 when 0 then text when 4 then null else concat(text, ' v', seq % 3) end")
    return harmonised(_first_words(spark, d).withColumn("translation", versions), ["doc_id"], ["seq"])


#: The first word of a line in tags that change now and then, with typography or without; every seventh failed.
_ITEMS = f"(select doc_id, seq, case when seq % 4 = 3 then '[[0]]' || w || '[[/0]]' || ' :' when seq % 4 = 2 then '[[0]]' || w || '[[/0]]:' else '[[0]][[1]]' || w || ':[[/1]][[/0]]' end as tagged, case when seq % 9 = 8 then null else w || ' ' || seq end as translation, seq % 7 = 6 as failed from (select doc_id, seq, string_split(text, ' ')[1] as w from {SEGMENTS}))"
_TYPO = r"replace(regexp_replace(trim(regexp_replace({}, '\s+', ' ', 'g')), ' ([:;!?%»])', '\1', 'g'), '« ', '«')"
_KEY = _TYPO.format(r"regexp_replace(tagged, '\[\[/?\d+\]\]', '', 'g')")


@plan("document_memory", rf"""with k as (select *, {_KEY} as key, {_TYPO.format('tagged')} as written from {_ITEMS}),
memo as (select doc_id, key, min(seq) as since, arg_min(written, seq) as as_written, arg_min(translation, seq) as memo from k where translation <> '' and not failed and length(key) between 1 and 120 group by 1, 2)
select doc_id, seq, case when seq > since and written = as_written then memo end as served from k left join memo using (doc_id, key)""")
def memory(spark, d):
    words = segments(spark, d).select("doc_id", "seq", F.split("text", " ")[0].alias("w"))
    items = words.selectExpr("doc_id", "seq", "case when seq % 4 = 3 then concat('[[0]]', w, '[[/0]]', ' :') when seq % 4 = 2 then concat('[[0]]', w, '[[/0]]:') else concat('[[0]][[1]]', w, ':[[/1]][[/0]]') end as tagged", "case when seq % 9 = 8 then null else concat(w, ' ', seq) end as translation", "seq % 7 = 6 as failed")
    return document_memory(items, ["doc_id"], ["seq"], failed="failed").select("doc_id", "seq", "served")


_BESIDE = f"(select doc_id, seq // 10 as batch, seq, seq % 10 between 3 and 6 as target, lag(text) over w as t0, lead(text) over w as t1 from {SEGMENTS} window w as (partition by doc_id order by seq))"
_SHORT = r"substr(trim(regexp_replace({}, '\s+', ' ', 'g')), 1, 300)"


@plan("neighbour_context", f"""select doc_id, batch, place, text from (select *, row_number() over w as place, sum(length(text)) over w as total from (
select doc_id, batch, text, min(pos) as pos from (select doc_id, batch, {_SHORT.format('t0')} as text, seq * 2 as pos from {_BESIDE} where target union all select doc_id, batch, {_SHORT.format('t1')}, seq * 2 + 1 from {_BESIDE} where target)
where {_LETTERS.format('text')} > 1 group by 1, 2, 3) window w as (partition by doc_id, batch order by pos)) where total <= 600""")
def neighbour_context(spark, d):
    blocks = segments(spark, d).select("doc_id", F.expr("seq div 10").alias("batch"), "seq", "text", F.expr("seq % 10 between 3 and 6").alias("target"))
    return neighbours(blocks, ["doc_id"], ["seq"], "target", ["doc_id", "batch"], most=600)


@plan("document_brief_material", f"""select doc_id, coalesce(titles, '') as titles, excerpts from (select doc_id, string_agg(excerpt, chr(10) order by seq) as excerpts from ({MORE['spread_sample']}) group by 1)
left join (select doc_id, string_agg(text, chr(10) order by seq) as titles from (select *, row_number() over (partition by doc_id order by seq) as r from {SEGMENTS} where length(text) <= 80) where r <= 60 group by 1) using (doc_id)""")
def brief(spark, d):
    s = segments(spark, d).select("doc_id", "seq", "text").withColumn("title", F.length("text") <= 80)
    return brief_material(s, spread_sample(s.drop("title"), "doc_id", 600), ["doc_id"], "seq", "title")


_REQUEST = "start_day * 2 as pages_asked, case when user_id % 13 = 0 then 5 else 0 end as pages_paid, plan = 'free' as free, user_id % 7 = 0 as resumes, case when user_id % 11 = 0 then 'device' end as risk, user_id % 3 = 0 as free_mode, user_id % 17 as free_used, case user_id % 4 when 0 then 'pdf' when 1 then 'pptx' when 2 then 'docx' end as format, user_id % 5 = 0 as covered_only"
#: The same cascade, with what each step needs named first.
_ASKED = f"""(select *, needed > covered and not unbounded as short, coalesce(format in ('pdf', 'pptx'), false) and covered > 0 and pages_paid = 0 as splits, resumes and needed > 0 and free and not email_verified and credits = 0 as stopped, free_mode and pages_paid = 0 and not resumes as previews from (
select *, greatest(pages_asked - pages_paid, 0) as needed, own + credits as covered, unlimited as unbounded from (select *, free and risk is not null and remaining > 0 as risky, case when free and risk is not null and remaining > 0 then 0 when unlimited then null else remaining end as own from (
select user_id, email_verified, {_REQUEST}, remaining, unlimited, s.credits from {_SUMMARY} s join (select user_id, start_day, email_verified from {USERS}) using (user_id)))))"""


@plan("admission_decision", f"""select user_id, decision, case when stopped then 'verify_email' when decision <> 'refused' then null when risky then 'free_limit_device' when previews then 'free_mode_limit' else 'need_credits' end as reason, pages, case when decision = 'preview' then needed - covered else 0 end as preview_pages,
least(pages, coalesce(own, pages)) as from_plan, pages - least(pages, coalesce(own, pages)) as from_credits, case when short then needed - covered else 0 end as missing, short and splits as partial_possible
from (select *, case decision when 'full' then needed when 'refused' then 0 else covered end as pages from (select *, case when stopped then 'refused' when not coalesce(short, false) then 'full' when previews and free_used + needed - covered <= 20 then 'preview' when covered_only and splits then 'partial' else 'refused' end as decision from {_ASKED}))""")
def admission_decision(spark, d):
    asked = summary(spark, d).selectExpr("user_id", "email_verified as verified", "start_day * 2 as pages_asked", "case when user_id % 13 = 0 then 5 else 0 end as pages_paid", "plan = 'free' as free", "user_id % 7 = 0 as resumes", "case when user_id % 11 = 0 then 'device' end as risk", "user_id % 3 = 0 as free_mode", "user_id % 17 as free_used", "case user_id % 4 when 0 then 'pdf' when 1 then 'pptx' when 2 then 'docx' end as format", "user_id % 5 = 0 as covered_only", "if(unlimited, null, remaining) as plan_left", "credits")
    return admission(asked).select("user_id", "decision", "reason", "pages", "preview_pages", "from_plan", "from_credits", "missing", "partial_possible")
