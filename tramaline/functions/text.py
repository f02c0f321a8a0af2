"""Column functions over translated text: tags, keys, predicates, counts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

Text = Column | str

PAIRED = r"(?s)\[\[(\d+)\]\](.*?)\[\[/\1\]\]"
ORPHAN = r"\[\[/?\d+\]\]"


def _c(x: Text) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_tags(x: Text) -> Column:
    """Text without tags: paired ones keep their content, orphans go."""
    return F.regexp_replace(F.regexp_replace(_c(x), PAIRED, "$2"), ORPHAN, "")


def tag_contents(x: Text) -> Column:
    """Contents of the paired tags by index, as a map; of an index met twice, the last counts."""
    idx = F.transform(F.regexp_extract_all(_c(x), F.lit(PAIRED), F.lit(1)), lambda i: i.cast("int"))
    found = F.arrays_zip(idx.alias("i"), F.regexp_extract_all(_c(x), F.lit(PAIRED), F.lit(2)).alias("t"))
    return F.aggregate(found, F.create_map().cast("map<int,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["i"]), F.create_map(p["i"], p["t"])))


@F.pandas_udf(StringType())
def _unaccented(s: pd.Series) -> pd.Series:
    fold = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    return s.map(lambda t: None if t is None else t if t.isascii() else fold(t))


def squeezed(x: Text) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(_c(x), r"(?U)\s+", " "))


def _beyond_ascii(x: Text) -> Column:
    return F.rlike(_c(x), F.lit(r"[^\x00-\x7F]"))


def nude_form(x: Text, accented: Column | None = None) -> Column:
    """Form to compare by: no accents, lower case, single spaces. accented: which texts may have any, else those not of ASCII."""
    # other texts don't travel to Python
    accented = _beyond_ascii(x) if accented is None else accented
    return squeezed(F.lower(F.coalesce(_unaccented(F.when(accented, _c(x))), _c(x))))


def run_forms(bare: Text, runs: Text, keys: Column) -> Column:
    """Nude forms of a text without tags and of its runs (a map) by keys, all in one call; a missing run is empty."""
    border = "\ue000"
    all_of = F.concat(F.array(_c(bare)), F.transform(keys, lambda k: F.coalesce(F.element_at(_c(runs), k), F.lit(""))))
    return F.transform(F.split(nude_form(F.array_join(all_of, border), F.exists(all_of, _beyond_ascii)), border), F.trim)


def copied_run(source: Column, target: Column) -> Column:
    """Of two runs or more, in nude form: one with a letter is as in the source, while another is not."""
    same = F.zip_with(source, target, lambda a, b: a == b)
    copied = F.exists(F.arrays_zip(source.alias("s"), same.alias("same")), lambda x: x["same"] & F.rlike(x["s"], F.lit(r"\p{L}")))
    return (F.size(source) >= 2) & copied & F.exists(same, lambda x: ~x)


def error_rate(read: Text, expected: Text) -> Column:
    """Edits between two whole texts, per character of the first."""
    return F.levenshtein(_c(read), _c(expected)) / F.greatest(F.length(_c(read)), F.lit(1)).cast("double")


def without_typography(x: Text) -> Column:
    """Single spaces, and none where French typography puts one about punctuation."""
    return F.regexp_replace(F.regexp_replace(squeezed(x), r" ([:;!?%»])", "$1"), "« ", "«")


def memo_key(x: Text) -> Column:
    """Key of a text in a document's memory: without tags and typography."""
    return without_typography(strip_tags(x))


def letters(x: Text) -> Column:
    return F.regexp_count(_c(x), F.lit(r"\p{L}"))


def is_translatable(x: Text) -> Column:
    """At least two letters."""
    return letters(x) > 1


def is_numeric_text(x: Text) -> Column:
    """A number, once spaces and % are gone and the comma is a point."""
    t = F.regexp_replace(F.regexp_replace(_c(x), r"(?U)[\s%]", ""), ",", ".")
    return t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")


def has_words(x: Text) -> Column:
    """Worth translating: CJK text, or a token of two letters or more and no digit; a lone upper-case ASCII word isn't."""
    cjk = _c(x).rlike(r"[぀-ヿ㐀-鿿가-힯]")
    words = F.filter(F.split(_c(x), r"(?U)\s+"), lambda w: (F.regexp_count(w, F.lit(r"\p{L}")) >= 2) & ~w.rlike(r"\d"))
    return cjk | ((F.size(words) > 0) & ~((F.size(words) == 1) & words[0].rlike("^[A-Z]+$")))


def digit_runs(x: Text) -> Column:
    return F.regexp_extract_all(_c(x), F.lit(r"(\d+)"))


#: Fixed values of what is billed and compared, by code point: signs of Chinese, Japanese and Korean; scripts without
#: spaces (Thai, Lao, Burmese, Khmer); an inclusive ending in parentheses, as in "étudiant(e)s".
CJK_SIGNS = r"\x{3400}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}"
UNSPACED = r"\x{0e00}-\x{0eff}\x{1000}-\x{109f}\x{1780}-\x{17ff}"
ENDING = r"[a-zà-ÿ]\([a-zà-ÿ]{1,3}\)"
#: Signs of such a script that make a word, and those of a long run.
SIGNS_PER_WORD, LONG_RUN = 5, 50


def open_parens(x: Text) -> Column:
    """Opening parentheses, full-width ones included, without short inclusive endings glued to a word."""
    rest = F.regexp_replace(strip_tags(x), f"(?<={ENDING[: ENDING.index(']') + 1]}){ENDING[ENDING.index(']') + 1 :]}", "")
    return F.regexp_count(rest, F.lit(r"[(\x{ff08}]"))


def word_count(x: Text) -> Column:
    """Words to bill: each CJK sign one; Thai, Lao, Burmese, Khmer one per 5 signs; long runs one per 50; numbers none.

    One pass takes the text apart into signs, runs of scripts without spaces, and words; each part is billed by kind.
    """
    letter = rf"[\w&&[^_{CJK_SIGNS}{UNSPACED}]]"
    part = rf"((?U)[{CJK_SIGNS}]|[{UNSPACED}]+|{letter}+(?:['’\-]{letter}+)*)"
    words = lambda p, n: F.ceil(F.length(p) / F.lit(n)).cast("int")

    def bill(p: Column) -> Column:
        return F.when(p.rlike(f"^[{UNSPACED}]"), words(p, SIGNS_PER_WORD)).when(p.rlike(r"\p{L}"), words(p, LONG_RUN)).otherwise(0)

    parts = F.regexp_extract_all(F.regexp_replace(_c(x), ORPHAN, ""), F.lit(part))
    return F.aggregate(parts, F.lit(0), lambda n, p: n + bill(p)).cast("long")


def page_range(x: Text) -> Column:
    """'1-5, 8' as sorted distinct pages from 1; reversed ranges are turned, bad tokens ignored, nothing left is null."""
    tokens = F.filter(F.transform(F.split(_c(x), ","), lambda t: F.trim(t)), lambda t: t.rlike(r"^\d{1,6}(\s*-\s*\d{1,6})?$"))
    ends = F.transform(tokens, lambda t: F.struct(F.regexp_extract(t, r"^(\d+)", 1).cast("int").alias("a"), F.regexp_extract(t, r"(\d+)$", 1).cast("int").alias("b")))
    pages = F.flatten(F.transform(ends, lambda e: F.sequence(F.least(e["a"], e["b"]), F.greatest(e["a"], e["b"]))))
    out = F.array_sort(F.array_distinct(F.filter(pages, lambda p: p >= 1)))
    return F.when(F.size(out) > 0, out)


def page_token(pages: Text) -> Column:
    """Name of a set of pages: p3-5, p7, or p and 8 hex digits of the SHA-1 of the list; empty for none."""
    p = _c(pages)
    low, high = F.array_min(p), F.array_max(p)
    listed = F.array_join(F.transform(F.array_sort(p), lambda x: x.cast("string")), ",")
    whole = high - low + 1 == F.size(p)
    return (
        F.when(p.isNull() | (F.size(p) == 0), "")
        .when(whole & (low == high), F.concat(F.lit("p"), low.cast("string")))
        .when(whole, F.concat(F.lit("p"), low.cast("string"), F.lit("-"), high.cast("string")))
        .otherwise(F.concat(F.lit("p"), F.substring(F.sha1(listed.cast("binary")), 1, 8)))
    )


def sanitize_filename(x: Text) -> Column:
    """Stem of a file name with _ for anything but letters and digits, 50 characters at most."""
    stem = F.regexp_replace(_c(x), r"\.[^.]*$", "")
    t = F.substring(F.regexp_replace(stem, r"[^\p{L}\p{N}]+", "_"), 1, 50)
    return F.coalesce(F.nullif(t, F.lit("")), F.lit("document"))


def valid_sheet_name(x: Text) -> Column:
    t = F.trim(_c(x))
    return (F.length(t) > 0) & (F.length(t) <= 31) & ~t.rlike(r"[:\\/?*\[\]']")


def version_newer(a: Text, b: Text) -> Column:
    """Whether dotted version a is newer than b; missing parts are 0, invalid versions never newer."""
    ok = r"^\d+(\.\d+)*$"
    parts = lambda x: F.transform(F.split(_c(x), r"\."), lambda p: F.expr("0") + p.try_cast("long"))
    cmp = F.zip_with(parts(a), parts(b), lambda p, q: F.coalesce(p, F.lit(0)) - F.coalesce(q, F.lit(0)))
    first = F.get(F.filter(cmp, lambda d: d != 0), F.lit(0))
    return _c(a).rlike(ok) & _c(b).rlike(ok) & F.coalesce(first > 0, F.lit(False))


def line_features(x: Text) -> dict[str, Column]:
    """What a line looks like at its ends."""
    t = F.trim(_c(x))
    return {
        "ends_sentence": t.rlike(r"[.!?…:;][\"'»)\]]*$"),
        "starts_capital": t.rlike(r"^\p{Lu}"),
        "starts_lower": t.rlike(r"^\p{Ll}"),
        "all_caps": t.rlike(r"\p{Lu}") & ~t.rlike(r"\p{Ll}"),
        "first_word": F.regexp_extract(t, r"^(\S+)", 1),
        "last_word": F.regexp_extract(t, r"(\S+)$", 1),
    }
