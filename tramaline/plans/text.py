"""Plans over text: normalisation (B), pair quality (C), memory (D), batches (E), word metering (G)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tramaline.functions import text as T
from tramaline.operators.pairs import word_recall
from tramaline.operators.paragraphs import list_ordinal
from tramaline.sources.extracts import load_segments
from tramaline.plans.base import PAIRS, SEGMENTS, TAGGED, Plans, pairs, segments, tagged
from tramaline.session import table

plan = Plans()
QUERIES, SQL = plan.queries, plan.sql

_BARE = r"regexp_replace({}, '\[\[/?\d+\]\]', '', 'g')"
_SQUEEZE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_NUDE = "strip_accents(lower(" + _SQUEEZE + "))"
_KEY = "seq"


_LINES = "(select doc_id, i, parts[i] as text from (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents), unnest(range(1, len(parts) + 1)) r(i))"


@plan("load_segments", f"select doc_id, row_number() over (partition by doc_id order by i) - 1 as seq, case when doc_id % 4 < 2 then (i - 1) // 10 else 0 end as unit, text from {_LINES} where regexp_matches(text, '[^\\s]')")
def segments_of_extracts(spark, d):
    # a document as the extract of a PDF, slides, a workbook or a text file; pages and slides have ten lines
    block = lambda xs: F.transform(xs, lambda t: F.struct(t.alias("text")))
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    docs = table(spark, d, "documents").withColumn("lines", lines)
    tens = F.transform(F.sequence(F.lit(0), F.expr("(size(lines) - 1) div 10")), lambda i: F.slice("lines", i * 10 + 1, F.lit(10)))
    page = F.transform(tens, lambda t: F.struct(block(t).alias("text_blocks")))
    slide = F.transform(tens, lambda t: F.struct(block(F.slice(t, 1, 5)).alias("text_elements"), F.array(F.struct(block(F.slice(t, 6, 5)).alias("text_elements"))).alias("diagram_elements")))
    half = F.expr("cast(ceil(size(lines) / 2) as int)")
    parts = F.struct(block(F.slice("lines", F.lit(1), half)).alias("elements"), block(F.slice("lines", half + 1, F.size("lines"))).alias("footers"))
    kind = F.col("doc_id") % 4
    body = F.struct(F.when(kind == 0, page).alias("pages"), F.when(kind == 1, slide).alias("slides"), F.when(kind == 2, F.struct(block("lines").alias("elements"))).alias("workbook"), F.when(kind == 3, parts).alias("document"))
    extracts = docs.select("doc_id", F.to_json(body).alias("body"))
    return load_segments(extracts, ["doc_id"], "body").select("doc_id", "seq", "unit", "text")


@plan("strip_tags", f"select doc_id, seq, {_BARE.format('tagged')} as nude from {TAGGED}")
def strip_tags(spark, d):
    return tagged(spark, d).select("doc_id", "seq", T.strip_tags("tagged").alias("nude"))


@plan("parse_tags", rf"select doc_id, seq, i - 1 as idx, regexp_extract_all(tagged, '\[\[\d+\]\]([^\[]*)\[\[/\d+\]\]', 1)[i] as content from {TAGGED}, unnest(range(1, 3)) r(i) where regexp_extract_all(tagged, '\[\[\d+\]\]([^\[]*)\[\[/\d+\]\]', 1)[i] is not null")
def parse_tags(spark, d):
    return tagged(spark, d).select("doc_id", "seq", F.explode(T.tag_contents("tagged")).alias("idx", "content")).withColumn("idx", F.col("idx").cast("long"))


@plan("nude_form", f"select doc_id, seq, {_NUDE.format('text')} as nude from {SEGMENTS}")
def nude_form(spark, d):
    return segments(spark, d).select("doc_id", "seq", T.nude_form("text").alias("nude"))


_MEMO = "replace(regexp_replace(" + _SQUEEZE.format(_BARE.format("tagged")) + ", ' ([:;!?%»])', '\\1', 'g'), '« ', '«')"


@plan("memo_key", f"select doc_id, seq, {_MEMO} as key from {TAGGED}")
def memo_key(spark, d):
    return tagged(spark, d).select("doc_id", "seq", T.memo_key("tagged").alias("key"))


_LETTERS = r"length(regexp_replace({}, '\P{{L}}', '', 'g'))"


@plan("is_translatable", f"select doc_id, seq, {_LETTERS.format('text')} > 1 as translatable from {SEGMENTS}")
def is_translatable(spark, d):
    return segments(spark, d).select("doc_id", "seq", T.is_translatable("text").alias("translatable"))


_TOKENS = f"(select doc_id, seq, i - 1 as pos, string_split(text, ' ')[i] as token from {SEGMENTS}, unnest(range(1, len(string_split(text, ' ')) + 1)) r(i))"


def _tokens(spark, d):
    return segments(spark, d).select("doc_id", "seq", F.posexplode(F.split("text", " ")).alias("pos", "token"))


@plan("is_numeric_text", rf"select token, count(*) as n, regexp_matches(replace(regexp_replace(token, '[\s%]', '', 'g'), ',', '.'), '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$') as numeric from {_TOKENS} group by token")
def is_numeric_text(spark, d):
    return _tokens(spark, d).groupBy("token").agg(F.count("*").alias("n")).withColumn("numeric", T.is_numeric_text("token"))


@plan("has_words", rf"""select doc_id, seq, len(w) > 0 and not (len(w) = 1 and regexp_full_match(w[1], '[A-Z]+')) as words
from (select doc_id, seq, list_filter(regexp_split_to_array(text, '\s+'), lambda x: {_LETTERS.format('x')} >= 2 and not regexp_matches(x, '[0-9]')) as w from {SEGMENTS})""")
def has_words(spark, d):
    return segments(spark, d).select("doc_id", "seq", T.has_words("text").alias("words"))


#: Fixed pairs: CJK and full-width punctuation, and its Latin form.
CJK_MARKS, LATIN_MARKS = "，。！？：；（）「」", ",.!?:;()\"\""


@plan("latin_punctuation", f"select doc_id, seq, translate(translate(text, ',.!?', '，。！？'), '{CJK_MARKS}', '{LATIN_MARKS}') as latin from {SEGMENTS}")
def latin_punctuation(spark, d):
    wide = F.translate("text", ",.!?", "，。！？")  # the segments as an OCR reader for CJK would give them
    cjk = wide.rlike(r"[぀-ヿ㐀-鿿가-힯]")
    return segments(spark, d).select("doc_id", "seq", F.when(cjk, wide).otherwise(F.translate(wide, CJK_MARKS, LATIN_MARKS)).alias("latin"))


@plan("dehyphenate_join")
def dehyphenate_join(spark, d):
    lines = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"])
    joined = F.aggregate(
        lines, F.lit(""),
        lambda a, x: F.when(a == "", x).when(a.rlike(r"\p{L}-$") & x.rlike(r"^\p{Ll}"), F.concat(F.regexp_replace(a, "-$", ""), x)).otherwise(F.concat(a, F.lit(" "), x)),
    )
    return segments(spark, d).groupBy("doc_id").agg(joined.alias("text"))


SQL["dehyphenate_join"] = rf"""select doc_id, regexp_replace(regexp_replace(string_agg(text, chr(1) order by seq), '(\p{{L}})-\x01(\p{{Ll}})', '\1\2', 'g'), '\x01', ' ', 'g') as text from {SEGMENTS} group by doc_id"""


@plan("cjk_join", rf"select doc_id, seq, regexp_replace(replace(text, ' ', '  '), '\s+', ' ', 'g') as joined from {SEGMENTS}")
def cjk_join(spark, d):
    cjk = r"[぀-ヿ㐀-鿿가-힯]"
    joined = F.regexp_replace(F.array_join(F.split("text", r" +"), " "), rf"(?<={cjk}) (?={cjk})", "")
    return segments(spark, d).select("doc_id", "seq", joined.alias("joined"))


_FORMAT = "'0.00\"' || {} || '\"#,##0\" \"'"


@plan("format_literals", f"select doc_id, seq, string_split(text, ' ')[1] as literals from {SEGMENTS} where strpos(string_split(text, ' ')[1], '\"') = 0")
def format_literals(spark, d):
    code = F.concat(F.lit('0.00"'), F.split("text", " ")[0], F.lit('"#,##0" "'))
    found = F.filter(F.regexp_extract_all(code, F.lit('"([^"]*)"')), lambda x: F.trim(x) != "")
    return segments(spark, d).where(~F.split("text", " ")[0].contains('"')).select("doc_id", "seq", F.array_join(found, "|").alias("literals"))


@plan("valid_sheet_name", rf"select doc_id, seq, length(trim(substr(text, 1, seq + 20))) between 1 and 31 and not regexp_matches(substr(text, 1, seq + 20), '[:\\/?*\[\]'']') as valid from {SEGMENTS}")
def valid_sheet_name(spark, d):
    return segments(spark, d).select("doc_id", "seq", T.valid_sheet_name(F.expr("substr(text, 1, cast(seq + 20 as int))")).alias("valid"))


@plan("sanitize_filename", r"select page_id, coalesce(nullif(substr(regexp_replace(regexp_replace(url, '\.[^.]*$', ''), '[^\p{L}\p{N}]+', '_', 'g'), 1, 50), ''), 'document') as name from pages")
def sanitize_filename(spark, d):
    return table(spark, d, "pages").select("page_id", T.sanitize_filename("url").alias("name"))


_SELECTION = "o_orderkey % 7 || '-' || o_custkey % 9 || ', x, ' || o_orderkey % 13"


@plan("parse_page_range", f"""select o_orderkey, string_agg(p::varchar, ',' order by p) as pages from (select distinct o_orderkey, p from (
select o_orderkey, unnest(range(least(o_orderkey % 7, o_custkey % 9), greatest(o_orderkey % 7, o_custkey % 9) + 1)) as p from orders union all select o_orderkey, o_orderkey % 13 from orders) where p >= 1) group by 1""")
def parse_page_range(spark, d):
    s = F.expr("concat(o_orderkey % 7, '-', o_custkey % 9, ', x, ', o_orderkey % 13)")
    out = table(spark, d, "orders").select("o_orderkey", T.page_range(s).alias("p")).where("p is not null")
    return out.select("o_orderkey", F.array_join(F.transform("p", lambda x: x.cast("string")), ",").alias("pages"))


@plan("page_token", f"""select o_orderkey, case when hi - lo + 1 = n then case when lo = hi then 'p' || lo else 'p' || lo || '-' || hi end else 'p' || substr(sha1(pages), 1, 8) end as token
from (select o_orderkey, min(p) as lo, max(p) as hi, count(*) as n, string_agg(p::varchar, ',' order by p) as pages from (select distinct o_orderkey, p from (
select o_orderkey, unnest(range(least(o_orderkey % 7, o_custkey % 9), greatest(o_orderkey % 7, o_custkey % 9) + 1)) as p from orders union all select o_orderkey, o_orderkey % 13 from orders) where p >= 1) group by 1)""")
def page_token(spark, d):
    s = F.expr("concat(o_orderkey % 7, '-', o_custkey % 9, ', x, ', o_orderkey % 13)")
    return table(spark, d, "orders").select("o_orderkey", T.page_range(s).alias("p")).where("p is not null").select("o_orderkey", T.page_token("p").alias("token"))


_NUMBERED = "case seq % 6 when 0 then seq || '. ' when 1 then '(' || chr((97 + seq % 26)::int) || ') ' when 2 then chr((65 + seq % 26)::int) || '.  ' when 3 then '  ' || seq % 90 || ') ' when 4 then seq || '.5 ' else '' end || text"


@plan("list_ordinal", rf"""select doc_id, seq, case when regexp_matches(m, '^\d') then 'd' when m <> '' then 'a' end as kind, case when regexp_matches(m, '^\d') then m::bigint when m <> '' then ascii(lower(m)) end as rank
from (select doc_id, seq, regexp_extract({_NUMBERED}, '^\s*\(?(\d{{1,3}}|[a-zA-Z])[.)]\s+', 1) as m from {SEGMENTS})""")
def ordinals(spark, d):
    mark = "case seq % 6 when 0 then concat(seq, '. ') when 1 then concat('(', char(97 + seq % 26), ') ') when 2 then concat(char(65 + seq % 26), '.  ') when 3 then concat('  ', seq % 90, ') ') when 4 then concat(seq, '.5 ') else '' end"
    kind, rank = list_ordinal(F.expr(f"concat({mark}, text)"))
    return segments(spark, d).select("doc_id", "seq", kind.alias("kind"), rank.alias("rank"))


#: Fixed names of languages, by code.
LANGUAGES = {"en": "English", "fr": "French", "de": "German", "es": "Spanish", "es-mx": "Mexican Spanish", "pt": "Portuguese", "zh": "Chinese"}
_NAMES = "(values " + ", ".join(f"('{k}', '{v}')" for k, v in LANGUAGES.items()) + ") n(code, name)"


@plan("language_name", f"with n as (select * from {_NAMES}) select doc_id, code, coalesce(a.name, b.name, code) as name from (select doc_id, case when doc_id % 3 = 0 then lang || '-mx' when doc_id % 3 = 1 then lang else 'x' || lang end as code from documents) d left join n a using (code) left join n b on b.code = split_part(d.code, '-', 1)")
def language_name(spark, d):
    names = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))  # a fixed list
    code = F.expr("case when doc_id % 3 = 0 then concat(lang, '-mx') when doc_id % 3 = 1 then lang else concat('x', lang) end")
    return table(spark, d, "documents").select("doc_id", code.alias("code")).withColumn("name", F.coalesce(names[F.col("code")], names[F.substring_index("code", "-", 1)], "code"))


@plan("accept_language", "select doc_id, case when lang in ('en', 'fr') then lang else 'fr' end as language from documents")
def accept_language(spark, d):
    first = F.lower(F.substring_index(F.substring_index(F.substring_index(F.concat("lang", F.lit("-XX,en;q=0.9")), ",", 1), ";", 1), "-", 1))
    return table(spark, d, "documents").select("doc_id", F.when(first.isin("en", "fr"), first).otherwise("fr").alias("language"))


@plan("language_to_propose", "select doc_id, case when length(text) < 200 then null else nullif(case when doc_id % 2 = 0 then lang else case when doc_id % 3 = 0 then 'und' else lang end end, case when doc_id % 2 = 0 or doc_id % 3 <> 0 then 'en' else 'und' end) end as language from documents where doc_id % 2 = 0 or doc_id % 3 = 0 or lang is not null")
def language_to_propose(spark, d):
    reliable, declared = F.col("doc_id") % 2 == 0, F.when(F.col("doc_id") % 3 == 0, "und").otherwise(F.col("lang"))
    page = F.when(reliable, F.col("lang")).otherwise(declared)
    out = F.when((F.length("text") >= 200) & (page != "und") & (page != "en"), page)
    return table(spark, d, "documents").where("doc_id % 2 = 0 or doc_id % 3 = 0 or lang is not null").select("doc_id", out.alias("language"))


@plan("version_newer", "select a.r_regionkey as a, b.n_nationkey as b, (a.r_regionkey, b.n_nationkey % 3, 0) > (b.n_nationkey % 5, 1, b.n_nationkey) as newer from region a, nation b where a.r_regionkey = b.n_regionkey")
def version_newer(spark, d):
    j = table(spark, d, "region").join(table(spark, d, "nation"), F.expr("r_regionkey = n_regionkey"))
    a, b = F.expr("concat(r_regionkey, '.', n_nationkey % 3)"), F.expr("concat(n_nationkey % 5, '.1.', n_nationkey)")
    return j.select(F.col("r_regionkey").alias("a"), F.col("n_nationkey").alias("b"), T.version_newer(a, b).alias("newer"))


@plan("line_features", rf"""select doc_id, seq, regexp_matches(t, '[.!?…:;]["''»)\]]*$') as ends_sentence, regexp_matches(t, '^\p{{Lu}}') as starts_capital, regexp_matches(t, '^\p{{Ll}}') as starts_lower,
regexp_matches(t, '\p{{Lu}}') and not regexp_matches(t, '\p{{Ll}}') as all_caps, regexp_extract(t, '^(\S+)', 1) as first_word, regexp_extract(t, '(\S+)$', 1) as last_word from (select *, trim(text) as t from {SEGMENTS})""")
def line_features(spark, d):
    return segments(spark, d).select("doc_id", "seq", *(c.alias(k) for k, c in T.line_features("text").items()))


# ---- pair quality ----

_TAG0, _TAG1 = (rf"regexp_extract({{}}, '\[\[{i}\]\]([^\[]*)\[\[/{i}\]\]', 1)" for i in (0, 1))
_HAS1 = "strpos(target, '[[1]]') > 0"
_NUM = r"list_sort(regexp_extract_all({}, '[0-9]+'))"
_OPEN = r"(length({0}) - length(replace({0}, '(', '')) - len(regexp_extract_all({0}, '[a-zà-ÿ]\([a-zà-ÿ]{{1,3}}\)')))"
_S, _G = _BARE.format("source"), _BARE.format("target")
_D = {
    "tags": f"not ({_HAS1})",
    "copied": f"{_HAS1} and ((n0s = n0t and n1s <> n1t and {_LETTERS.format('n0s')} > 0) or (n1s = n1t and n0s <> n0t and {_LETTERS.format('n1s')} > 0))",
    "unchanged": f"ns = nt and {_LETTERS.format('ns')} > 0",
    "numbers": f"{_NUM.format(_S)} <> {_NUM.format(_G)}",
    "parens": f"{_OPEN.format(_G)} > {_OPEN.format(_S)}",
}
_FORMS = f"(select *, {_NUDE.format(_TAG0.format('source'))} as n0s, {_NUDE.format(_TAG0.format('target'))} as n0t, {_NUDE.format(_TAG1.format('source'))} as n1s, {_NUDE.format(_TAG1.format('target'))} as n1t, {_NUDE.format(_S)} as ns, {_NUDE.format(_G)} as nt from {PAIRS})"


def _checked(spark, d):
    p = pairs(spark, d).withColumn("ms", T.tag_contents("source")).withColumn("mt", T.tag_contents("target"))
    p = p.withColumn("tags", F.size(F.array_except(F.map_keys("ms"), F.map_keys("mt"))) > 0)
    p = p.withColumn("bs", T.strip_tags("source")).withColumn("bt", T.strip_tags("target"))
    p = p.withColumn("fs", T.run_forms("bs", "ms", F.map_keys("ms"))).withColumn("ft", T.run_forms("bt", "mt", F.map_keys("ms")))
    p = p.withColumn("copied", ~F.col("tags") & T.copied_run(F.slice("fs", F.lit(2), F.size("fs")), F.slice("ft", F.lit(2), F.size("ft"))))
    p = p.withColumn("unchanged", (F.get("fs", F.lit(0)) == F.get("ft", F.lit(0))) & (T.letters(F.get("fs", F.lit(0))) > 0))
    p = p.withColumn("numbers", F.array_sort(T.digit_runs("bs")) != F.array_sort(T.digit_runs("bt")))
    return p.withColumn("parens", T.open_parens("target") > T.open_parens("source"))


def _defect(key):
    @plan(f"defect_{key[0]}", f"select conv_id, seq, {_D[key[1]]} as defect from {_FORMS}")
    def run(spark, d):
        return _checked(spark, d).select("conv_id", "seq", F.col(key[1]).alias("defect"))


for _k in (("tags", "tags"), ("copied_run", "copied"), ("unchanged", "unchanged"), ("numbers", "numbers"), ("added_parens", "parens")):
    _defect(_k)


@plan("defects", " union all ".join(f"select '{k}' as defect, count(*) as n, count(distinct conv_id) as documents from {_FORMS} where {v} having count(*) > 0" for k, v in _D.items()))
def defects(spark, d):
    found = F.filter(F.array(*(F.when(F.col(k), k) for k in _D)), lambda x: x.isNotNull())
    return _checked(spark, d).select("conv_id", F.explode(found).alias("defect")).groupBy("defect").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("documents"))


_ALLTAGS = r"list_sort(regexp_extract_all({}, '\[\[/?[0-9]+\]\]'))"


@plan("tags_multiset_ok", f"select conv_id, seq, {_ALLTAGS.format('source')} = {_ALLTAGS.format('target')} as ok from {PAIRS}")
def tags_multiset_ok(spark, d):
    tags = lambda c: F.array_sort(F.regexp_extract_all(c, F.lit(r"(\[\[/?\d+\]\])")))
    return pairs(spark, d).select("conv_id", "seq", (tags("source") == tags("target")).alias("ok"))


_WORDS = r"list_distinct(regexp_extract_all({}, '\p{{L}}{{3,}}'))"
_SEEN = f"(select conv_id, seq, w, list_contains({_WORDS.format('nt')}, w) as kept from (select *, unnest({_WORDS.format('ns')}) as w from {_FORMS}))"
_TERMS = f"(select conv_id, w as word, count(*) filter (where kept) as kept, count(*) filter (where not kept) as translated from {_SEEN} group by 1, 2 having count(*) filter (where kept) > 0 and count(*) filter (where not kept) > 0)"


def term_uses(spark, d):
    """Each distinct source word of a pair and whether it stands in the target too."""
    words = lambda x: F.array_distinct(F.regexp_extract_all(T.nude_form(T.strip_tags(x)), F.lit(r"(\p{L}{3,})")))
    p = pairs(spark, d).select("conv_id", "seq", words("source").alias("s"), words("target").alias("t"))
    return p.select("conv_id", "seq", F.explode("s").alias("word"), "t").select("conv_id", "seq", "word", F.array_contains("t", F.col("word")).alias("kept"))


def inconsistent(uses):
    """Words of a document that some pairs keep and others translate, with how often."""
    kept = F.count_if("kept")
    return uses.groupBy("conv_id", "word").agg(kept.alias("kept"), F.count_if(~F.col("kept")).alias("translated")).where("kept > 0 and translated > 0")


@plan("inconsistent_terms", f"select * from {_TERMS}")
def inconsistent_terms(spark, d):
    return inconsistent(term_uses(spark, d))


@plan("terms_to_revisit", f"select s.conv_id, s.seq, string_agg(s.w, ',' order by s.w) as words from {_SEEN} s join {_TERMS} t on t.conv_id = s.conv_id and t.word = s.w where s.kept group by 1, 2")
def terms_to_revisit(spark, d):
    uses = term_uses(spark, d)
    left = uses.where("kept").join(inconsistent(uses).select("conv_id", "word"), ["conv_id", "word"])
    return left.groupBy("conv_id", "seq").agg(F.array_join(F.array_sort(F.collect_set("word")), ",").alias("words"))


@plan("missing_or_broken", f"select conv_id, seq, case when target = '' or conv_id % 17 = 0 then 'missing' when {_ALLTAGS.format('source')} <> {_ALLTAGS.format('target')} then 'broken' else 'ok' end as status from {PAIRS}")
def missing_or_broken(spark, d):
    tags = lambda c: F.array_sort(F.regexp_extract_all(c, F.lit(r"(\[\[/?\d+\]\])")))
    target = F.when(F.col("conv_id") % 17 != 0, F.col("target"))
    return pairs(spark, d).select("conv_id", "seq", F.when(F.coalesce(target, F.lit("")) == "", "missing").when(tags("source") != tags("target"), "broken").otherwise("ok").alias("status"))


@plan("overflow_budget", f"""select conv_id, seq, budget, n > budget as candidate, ok and m >= 0.6 * n as accepted from (select conv_id, seq, length({_G}) as n, length({_G}) * 4 // 5 as m, {_ALLTAGS.format('source')} = {_ALLTAGS.format('target')} as ok,
greatest(length({_S}) * 92 // 100, 60 * (100 - 8 * (conv_id % 3)) // 100) as budget from {PAIRS})""")
def overflow_budget(spark, d):
    n, src = F.length(T.strip_tags("target")).cast("long"), F.length(T.strip_tags("source")).cast("long")
    tags = lambda c: F.array_sort(F.regexp_extract_all(c, F.lit(r"(\[\[/?\d+\]\])")))
    # fit 60 characters, one round less per conv_id % 3; the rewrite has four fifths of the text
    p = pairs(spark, d).select("conv_id", "seq", n.alias("n"), F.expr("1L").alias("one"), (tags("source") == tags("target")).alias("ok"), src.alias("src"))
    p = p.withColumn("budget", F.expr("greatest(src * 92 div 100, 60 * (100 - 8 * (conv_id % 3)) div 100)"))
    return p.select("conv_id", "seq", "budget", (F.col("n") > F.col("budget")).alias("candidate"), F.expr("ok and (n * 4 div 5) >= 0.6 * n").alias("accepted"))


@plan("width_need", f"select conv_id, seq, least(t, 80.0 * t / greatest(s, 1)) as width from (select conv_id, seq, length({_S})::double as s, length({_G})::double as t from {PAIRS})")
def width_need(spark, d):
    s, t = F.length(T.strip_tags("source")).cast("double"), F.length(T.strip_tags("target")).cast("double")
    return pairs(spark, d).select("conv_id", "seq", F.least(t, F.lit(80.0) * t / F.greatest(s, F.lit(1.0))).alias("width"))


@plan("orphan_id_pairing", """with a as (select conv_id, turn, row_number() over (partition by conv_id order by turn) as k, count(*) over (partition by conv_id) as n from conversations where role = 'user'),
b as (select conv_id, turn, row_number() over (partition by conv_id order by turn) as k, count(*) over (partition by conv_id) as n from conversations where role = 'assistant')
select a.conv_id, a.turn as asked, b.turn as answered from a join b using (conv_id, k, n)""")
def orphan_id_pairing(spark, d):
    def numbered(role, name):
        w = W.partitionBy("conv_id")
        t = table(spark, d, "conversations").where(F.col("role") == role)
        return t.select("conv_id", F.col("turn").alias(name), F.row_number().over(w.orderBy("turn")).alias("k"), F.count("*").over(w).alias("n"))

    return numbered("user", "asked").join(numbered("assistant", "answered"), ["conv_id", "k", "n"]).drop("k", "n")


_RECALL = "(select sum(least(x.n, y.n)) from (select w, count(*) as n from unnest(string_split(a, ' ')) t(w) where w <> '' group by w) x join (select w, count(*) as n from unnest(string_split(b, ' ')) t(w) where w <> '' group by w) y using (w))"


@plan("same_text_similarity", f"select conv_id, turn as seq, levenshtein(a, b) / greatest(length(a), 1)::double as cer, coalesce({_RECALL}, 0) / greatest(len(list_filter(string_split(a, ' '), lambda w: w <> '')), 1)::double as recall from (select u.conv_id, u.turn, regexp_replace(u.text, '[^ -~]', '?', 'g') as a, regexp_replace(v.text, '[^ -~]', '?', 'g') as b from conversations u join conversations v on v.conv_id = u.conv_id and v.turn = u.turn + 1 where u.role = 'user' and v.role = 'assistant')")
def same_text_similarity(spark, d):
    # one sign for any non-ASCII character, as SQL engines differ in what they count
    c = table(spark, d, "conversations").withColumn("text", F.regexp_replace("text", "[^ -~]", "?"))
    u = c.where("role = 'user'").select("conv_id", F.col("turn").alias("seq"), F.col("text").alias("a"))
    v = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("seq"), F.col("text").alias("b"))
    both = u.join(v, ["conv_id", "seq"])
    return both.select("conv_id", "seq", T.error_rate("a", "b").alias("cer")).join(word_recall(both, ["conv_id", "seq"], "a", "b"), ["conv_id", "seq"])


# ---- memory and consistency ----


@plan("to_send", f"select distinct text from {SEGMENTS} s where source <> 'src0' and text not in (select text from {SEGMENTS} where source = 'src0')")
def to_send(spark, d):
    s = segments(spark, d)
    return s.where("source <> 'src0'").select("text").distinct().join(s.where("source = 'src0'").select("text").distinct(), "text", "left_anti")


@plan("memory_by_tagged_text", f"select tagged, min_by(doc_id, doc_id * 1000000 + seq) as doc_id from {TAGGED} where {_LETTERS.format('tagged')} > 0 group by tagged")
def memory_by_tagged_text(spark, d):
    return tagged(spark, d).where(T.letters("tagged") > 0).groupBy("tagged").agg(F.min_by("doc_id", F.expr("doc_id * 1000000 + seq")).alias("doc_id"))


_OLD = f"(select doc_id, seq, text, 'old ' || seq as translation from {SEGMENTS} where doc_id % 2 = 0 and seq % 3 <> 2)"


@plan("resume_fill", f"""select n.doc_id, n.seq, coalesce(a.translation, b.translation) as translation, coalesce(a.translation, b.translation) is null as left_over from {SEGMENTS} n left join {_OLD} a on a.doc_id = n.doc_id and a.seq = n.seq and a.text = n.text
left join (select text, min_by(translation, doc_id * 1000000 + seq) as translation from {_OLD} group by text) b on b.text = n.text""")
def resume_fill(spark, d):
    s = segments(spark, d)
    old = s.where("doc_id % 2 = 0 and seq % 3 <> 2").select("doc_id", "seq", "text", F.expr("concat('old ', seq)").alias("t"))
    by_text = old.groupBy("text").agg(F.min_by("t", F.expr("doc_id * 1000000 + seq")).alias("t2"))
    out = s.join(old, ["doc_id", "seq", "text"], "left").join(by_text, "text", "left").withColumn("translation", F.coalesce("t", "t2"))
    return out.select("doc_id", "seq", "translation", F.col("translation").isNull().alias("left_over"))


@plan("reattach_page", f"select doc_id, seq // 10 as page, bool_and(b.text is not null) as reattached from {SEGMENTS} s left join (select distinct text from {_OLD}) b on b.text = s.text group by 1, 2")
def reattach_page(spark, d):
    s = segments(spark, d)
    known = s.where("doc_id % 2 = 0 and seq % 3 <> 2").select("text").distinct().withColumn("known", F.lit(True))
    return s.join(known, "text", "left").groupBy("doc_id", F.expr("seq div 10").alias("page")).agg(F.bool_and(F.coalesce("known", F.lit(False))).alias("reattached"))


@plan("not_kept_if_equal", f"select conv_id, seq from {PAIRS} where source <> target")
def not_kept_if_equal(spark, d):
    return pairs(spark, d).where("source <> target").select("conv_id", "seq")


_PART = "octet_length(encode({0})) || ':' || {0}"


@plan("memory_key", f"select doc_id, seq, sha256({' || '.join(_PART.format(x) for x in (chr(39) + '1' + chr(39), chr(39) + 'text' + chr(39), 'source', 'lang', 'text'))}) as key from {SEGMENTS}")
def memory_key(spark, d):
    part = lambda c: F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)
    key = F.sha2(F.concat(*(part(c) for c in (F.lit("1"), F.lit("text"), F.col("source"), F.col("lang"), F.col("text")))), 256)
    return segments(spark, d).select("doc_id", "seq", key.alias("key"))


@plan("content_key", "select doc_id, substr(sha256(text), 1, 12) as key, count(*) over (partition by text) as copies from documents")
def content_key(spark, d):
    k = table(spark, d, "documents").select("doc_id", F.substring(F.sha2("text", 256), 1, 12).alias("key"), F.sha2("text", 256).alias("h"))
    return k.join(k.groupBy("h").agg(F.count("*").alias("copies")), "h").drop("h")


@plan("source_to_target_map", f"select source, min_by(bare, conv_id * 1000 + seq) as target from (select *, {_G} as bare, {_S} as s from {PAIRS}) where bare <> '' and s <> '' and s <> bare group by source")
def source_to_target_map(spark, d):
    p = pairs(spark, d).withColumn("bare", T.strip_tags("target")).withColumn("s", T.strip_tags("source")).where("bare <> '' and s <> '' and s <> bare")
    return p.groupBy("source").agg(F.min_by("bare", F.expr("conv_id * 1000 + seq")).alias("target"))


@plan("strings_by_sheet", f"select text, string_agg(distinct source, ',' order by source) as sheets from {SEGMENTS} group by text")
def strings_by_sheet(spark, d):
    return segments(spark, d).groupBy("text").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sheets"))


# ---- batches and contexts ----


@plan("fixed_batches", f"select doc_id, seq, (row_number() over (partition by doc_id order by seq) - 1) // 50 as batch from {SEGMENTS}")
def fixed_batches(spark, d):
    k = F.row_number().over(W.partitionBy("doc_id").orderBy("seq")) - 1
    return segments(spark, d).select("doc_id", "seq", F.floor(k / 50).alias("batch"))


@plan("budget_stop", f"select doc_id, seq from (select doc_id, seq, coalesce(sum((seq % 5 <> 0)::int) over (partition by doc_id order by seq rows between unbounded preceding and 1 preceding), 0) as used from {SEGMENTS}) where used < 3")
def budget_stop(spark, d):
    used = F.coalesce(F.sum((F.col("seq") % 5 != 0).cast("int")).over(W.partitionBy("doc_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return segments(spark, d).withColumn("used", used).where("used < 3").select("doc_id", "seq")


# ---- word metering ----

_COUNT = r"list_sum(list_transform(list_filter(regexp_extract_all(translate({}, '_', ' '), '[\p{{L}}\p{{N}}\p{{M}}]+(?:[''’\-][\p{{L}}\p{{N}}\p{{M}}]+)*'), lambda p: regexp_matches(p, '\p{{L}}')), lambda p: (length(p) + 49) // 50))"


@plan("word_count", f"select doc_id, coalesce({_COUNT.format('text')}, 0)::bigint as words from documents")
def word_count(spark, d):
    return table(spark, d, "documents").select("doc_id", T.word_count("text").alias("words"))


@plan("text_pages", f"select doc_id, greatest(1, (words + 499) // 500)::bigint as pages from (select doc_id, coalesce({_COUNT.format('text')}, 0)::bigint as words from documents)")
def text_pages(spark, d):
    return table(spark, d, "documents").select("doc_id", T.word_count("text").alias("w")).select("doc_id", F.expr("greatest(1L, (w + 499) div 500)").alias("pages"))


@plan("char_volume", f"select doc_id, sum(length({_BARE.format('tagged')}))::bigint as chars from {TAGGED} group by doc_id")
def char_volume(spark, d):
    return tagged(spark, d).groupBy("doc_id").agg(F.sum(F.length(T.strip_tags("tagged"))).alias("chars"))


@plan("pages_with_text", f"select doc_id, count(distinct seq // 20) as pages from {SEGMENTS} group by doc_id")
def pages_with_text(spark, d):
    return segments(spark, d).groupBy("doc_id").agg(F.countDistinct(F.expr("seq div 20")).alias("pages"))
