"""Inputs that the plans share, derived from the given tables: a DataFrame and the same as a SQL table expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramaline.session import table

Query = Callable[[SparkSession, str], DataFrame]


class Plans:
    """Queries of one module by key, each with its SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, key: str, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            self.queries[key] = f
            if sql:
                self.sql[key] = sql
            return f

        return add


#: "Now" of the plans over orders and events: parameters, so that results don't depend on the day.
NOW_ORDERS, NOW_EVENTS = "1998-03-31 12:00:00", "2024-01-20 12:00:00"

SEGMENTS = "(select doc_id, lang, source, i - 1 as seq, parts[i] as text from (select *, string_split(coalesce(text, ''), chr(10)) as parts from documents), unnest(range(1, len(parts) + 1)) r(i) where trim(parts[i]) <> '')"


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-blank lines of documents: doc_id, lang, source, seq (line, from 0), text."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "lang", "source", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("seq", "text")).where("trim(text) <> ''").withColumn("seq", F.col("seq").cast("long"))


#: A segment as two tagged runs: its first word, and the rest.
TAGGED = f"(select *, '[[0]]' || string_split(text, ' ')[1] || '[[/0]] [[1]]' || array_to_string(string_split(text, ' ')[2:], ' ') || '[[/1]]' as tagged from {SEGMENTS})"


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("text", " ")
    rest = F.array_join(F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), " ")
    return segments(spark, sf_dir).withColumn("tagged", F.concat(F.lit("[[0]]"), words[0], F.lit("[[/0]] [[1]]"), rest, F.lit("[[/1]]")))


_HEAD = "string_split(u.text, ' ')"
_TAIL = "string_split(a.text, ' ')"
#: A user turn and the next assistant turn as a translation pair with runs 0 and 1, and defects by conv_id: every
#: fifth lacks run 1, every seventh copies run 0, every eleventh copies all, every third adds a number, every
#: thirteenth a gloss.
PAIRS = f"""(select conv_id, turn as seq, source, case when conv_id % 11 = 0 then source else '[[0]]' || case when conv_id % 7 = 0 then h else t end || '[[/0]] '
  || case when conv_id % 5 = 0 then '' else '[[1]]' || tr || case when conv_id % 3 = 0 then ' 42' else '' end || case when conv_id % 13 = 0 then ' (gloss)' else '' end || '[[/1]]' end end as target
  from (select u.conv_id, u.turn, '[[0]]' || {_HEAD}[1] || '[[/0]] [[1]]' || array_to_string({_HEAD}[2:], ' ') || '[[/1]]' as source,
        {_HEAD}[1] as h, {_TAIL}[1] as t, array_to_string({_TAIL}[2:], ' ') as tr
        from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1 where u.role = 'user' and a.role = 'assistant'))"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translation pairs conv_id, seq, source, target; see PAIRS."""
    c = table(spark, sf_dir, "conversations")
    u = c.where("role = 'user'").select("conv_id", F.col("turn").alias("seq"), F.split("text", " ").alias("u"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("seq"), F.split("text", " ").alias("a"))
    both = u.join(a, ["conv_id", "seq"])
    rest = lambda x: F.array_join(F.slice(x, F.lit(2), F.greatest(F.size(x), F.lit(1))), " ")
    every = lambda n, x, y: F.when(F.col("conv_id") % n == 0, x).otherwise(y)
    source = F.concat(F.lit("[[0]]"), F.col("u")[0], F.lit("[[/0]] [[1]]"), rest("u"), F.lit("[[/1]]"))
    second = F.concat(F.lit("[[1]]"), rest("a"), every(3, F.lit(" 42"), F.lit("")), every(13, F.lit(" (gloss)"), F.lit("")), F.lit("[[/1]]"))
    target = F.concat(F.lit("[[0]]"), every(7, F.col("u")[0], F.col("a")[0]), F.lit("[[/0]] "), every(5, F.lit(""), second))
    return both.select("conv_id", "seq", source.alias("source"), every(11, source, target).alias("target"))
