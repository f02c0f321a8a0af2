"""The numbered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramaline.llm import decontaminate, filter_audit, license_scan, mixing, pitman_yor, preferences, quality, secret_scan, sharding, simhash, suffix_repeats, token_alignment, weighted_sampling
from tramaline.session import table


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op3_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = preferences.conversations(table(spark, sf_dir, "conversations"))
    return preferences.format_preferences(preferences.paired_with_neighbour(convs))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score_texts(table(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_sampling.edited_fingerprints(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"))
    digest = [F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law")]
    return out.select("doc_id", "size", *digest, "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_tokens(table(spark, sf_dir, "documents")).drop("groups")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_repeats": op1_repeats,
    "op2_licenses": op2_licenses,
    "op3_preferences": op3_preferences,
    "op4_decontaminate": op4_decontaminate,
    "op5_language_model": op5_language_model,
    "op6_fingerprints": op6_fingerprints,
    "op7_simhash": op7_simhash,
    "op8_secrets": op8_secrets,
    "op9_quality": op9_quality,
    "op10_mixing": op10_mixing,
    "op11_sharding": op11_sharding,
    "op12_token_alignment": op12_token_alignment,
    "op13_filter_audit": op13_filter_audit,
}

#: Words of a text: A-Z lower-cased, runs of digits, letters and non-ASCII characters.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP4 = f"""
with d as (select doc_id, {_WORDS} as w from documents),
b as (select item_id, {_WORDS} as w from benchmark where item_id is not null),
win as (select distinct item_id, least(len(w), 10) as n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as g
        from b, unnest(range(1, greatest(len(w) - 8, 2))) r(i) where len(w) > 0),
sizes as (select distinct n from win),
dw as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as g
       from d, sizes, unnest(range(1, len(w) - n + 2)) r(i)),
hit as (select dw.doc_id, dw.i, dw.n, win.item_id from dw join win using (g, n)),
words as (select doc_id, count(distinct j) as n_hit from hit, unnest(range(i, i + n)) r(j) group by 1),
items as (select doc_id, count(distinct item_id) as n_items,
                 string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from hit group by 1)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join items using (doc_id)
"""

_TURN = "'<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)"


def _completion(x: str) -> str:
    """SQL of a completion and its mask, from the list of turns x that follow the prefix."""
    length = "length(t.role) + length(t.text) + 13"
    start = f"coalesce(list_sum(list_transform({x}[1:i - 1], lambda t: {length})), 0)::bigint"
    spans = f"list_transform(list_filter(range(1, len({x}) + 1), lambda i: {x}[i].role = 'assistant'), lambda i: ({start} + length({x}[i].role) + 5)::varchar || ':' || ({start} + length({x}[i].role) + length({x}[i].text) + 13)::varchar)"
    return f"coalesce(array_to_string(list_transform({x}, lambda t: {_TURN}), ''), '')", f"coalesce(array_to_string({spans}, ','), '')"


_OP3 = f"""
with c as (select conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} order by turn, coalesce(role, ''), coalesce(text, '')) as turns
           from conversations group by conv_id),
p as (select c.conv_id as pair_id, c.turns as c, case when o.conv_id is null then c.turns[1:len(c.turns) - 1]
             else list_concat(c.turns[1:len(c.turns) - 1], [{{'role': c.turns[-1].role, 'text': o.turns[-1].text}}]) end as r
      from c left join c o on o.conv_id = xor(c.conv_id, 1)),
q as (select *, cast(coalesce(list_min(list_filter(range(1, greatest(len(c), len(r)) + 1), lambda i: c[i] is distinct from r[i])) - 1, len(c)) as bigint) as n_prefix from p),
s as (select *, c[n_prefix + 1:] as c2, r[n_prefix + 1:] as r2 from q)
select pair_id, n_prefix, coalesce(array_to_string(list_transform(c[1:n_prefix], lambda t: {_TURN}), ''), '') as prompt,
       {_completion("c2")[0]} as chosen, {_completion("c2")[1]} as chosen_mask, {_completion("r2")[0]} as rejected, {_completion("r2")[1]} as rejected_mask
from s
"""

#: Source rates, copies by inverting the Poisson distribution at a uniform number from MD5.
_MIXED = """
select d.*, n_copies, unnest(range(1, n_copies + 1)) as copy from (
  select d.*, (select count(*) from cdf where cdf.source is not distinct from d.source
               and cdf.p < (cast('0x' || substr(md5(coalesce(cast(d.doc_id as varchar), '') || ':42'), 1, 13) as bigint) + 0.5) / 4503599627370496.0) as n_copies
  from {docs} d) d
where n_copies > 0
"""
_RATES = """
rates as (select source, count(*) as n, (1.0::double / (select count(*) from (select distinct source from {docs}))) * (select count(*) from {docs}) / count(*) as rate from {docs} group by source),
terms as (select source, rate, k, sum(case when k = 0 then -rate else ln(rate / k) end) over (partition by source order by k) as log_p
          from rates, unnest(range(0, cast(ceil(rate + 10 * sqrt(rate) + 20) as bigint) + 1)) r(k)),
cdf as (select source, sum(exp(log_p)) over (partition by source order by k) as p from terms)
"""
_OP10 = "with " + _RATES.format(docs="documents") + _MIXED.format(docs="documents").replace("select d.*, n_copies, unnest", "select doc_id, text, lang, source, n_chars, n_copies, unnest")

#: All 100-byte strings (as hex), those met before, their stretches, and what lies between these.
_OP1 = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
cut as (select doc_id, b, len(x) // 2 as n, substr(x, 2 * b + 1, 2198) as y from d, unnest(range(0, greatest(len(x) // 2 - 99, 0), 1000)) r(b)),
w as (select doc_id, b + i as i, hash(substr(y, 2 * i - 1, 200)) as h from cut, unnest(range(1, least(1000, n - 99 - b) + 1)) r(i)),
rep as (select doc_id, i from (select *, row_number() over (partition by h order by doc_id, i) as r from w) where r > 1),
isle as (select *, sum(new) over (partition by doc_id order by i) as g from (select *, case when i - lag(i) over (partition by doc_id order by i) <= 100 then 0 else 1 end as new from rep)),
span as (select doc_id, min(i) as a, max(i) + 99 as b from isle group by doc_id, g),
piece as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as p from span),
cuts as (select doc_id, sum(b - a + 1) as n, count(*) as k, max(b) as last, string_agg(substr(x, 2 * p + 1, 2 * (a - 1 - p)), '' order by a) as kept from piece join d using (doc_id) group by doc_id)
select d.doc_id, cast(len(x) // 2 as bigint) as n_bytes, cast(coalesce(n, 0) as bigint) as n_removed, coalesce(k, 0) as n_spans,
       sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(last, 0) + 1))) as kept_sha256
from d left join cuts using (doc_id)
"""

#: Each document's failures as a set of letters, counted by part; then all orders, a filter counting what isn't gone before.
_OP13 = r"""
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents),
first as (select text, min(doc_id) as first from d group by text),
w as (select doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from d),
marks as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
f as (select part, case when len(w) < 200 then 'A' else '' end || case when 100 * len(list_distinct(w)) < 50 * len(w) then 'B' else '' end
        || case when 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 3 * length(text) then 'C' else '' end
        || case when regexp_matches(text, '[#$%&*|]') then 'D' else '' end || case when doc_id > first then 'E' else '' end as fails,
        coalesce(good, 0) as good, coalesce(toxic, 0) as toxic
      from w join first using (text) left join marks using (doc_id)),
n as (select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by 1, 2),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (select a.x || b.x || c.x || d.x || e.x as filter_order from letters a, letters b, letters c, letters d, letters e
           where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps as (select filter_order, s as step, substr(filter_order, s, 1) as x, substr(filter_order, 1, s - 1) as gone from orders, range(1, 6) t(s)),
r as (select part, filter_order, step, x,
        sum(case when translate(fails, gone || x, '') = fails then n else 0 end) as kept,
        sum(case when contains(fails, x) and translate(fails, gone, '') = fails then n else 0 end) as removed,
        sum(case when contains(fails, x) and translate(fails, gone, '') <> fails then n else 0 end) as redundant,
        sum(case when fails = x then n else 0 end) as unique_fails,
        sum(case when contains(fails, x) and translate(fails, gone, '') = fails then good else 0 end) as good_lost,
        sum(case when contains(fails, x) and translate(fails, gone, '') = fails then toxic else 0 end) as toxic_lost
      from steps, n group by all)
select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
       good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, x))::bigint as shapley
from r
"""

ORACLE_SQL: dict[str, str] = {"op1_repeats": _OP1, "op3_preferences": _OP3, "op4_decontaminate": _OP4, "op10_mixing": _OP10, "op13_filter_audit": _OP13}
