"""Mixing sources to target weights by Poisson replication.

A document of a source with repetition rate r is repeated N times, N Poisson with mean r. N comes from a
uniform number seeded by the document's hash, by inverting the distribution function: N is the number of k
whose P(at most k) lies below it. All of it is DataFrame functions; the copies are dealt by a hash of copy
and seed and sorted by it within partitions, which is a global shuffle with one exchange.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Sources up to which their rates are broadcast: their number is checked first. Copies that one list names at most.
MAX_SOURCES, RUN = 10_000, 4096


def uniform(*parts: F.Column | str, seed: int) -> F.Column:
    """A number in (0, 1) from the MD5 of the parts and the seed: 52 bits, so that it is exact as a double."""
    text = F.concat_ws(":", *(F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p.cast("string"), F.lit("")) for p in parts), F.lit(str(seed)))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def poisson_count(rate: F.Column, u: F.Column) -> F.Column:
    """The number of k whose P(at most k) lies below u, for a Poisson distribution of mean rate; 0 for a rate of 0.

    Beyond ten standard deviations and twenty to either side nothing is left in a double, so that only k between
    are gone through, as a fold that holds three numbers. Where that begins above 0, its first term is Stirling's.
    """
    spread = 10 * F.sqrt(rate) + 20
    low = F.when(rate - spread < 30, F.lit(0).cast("long")).otherwise(F.floor(rate - spread))
    at = F.greatest(low, F.lit(1)).cast("double")
    stirling = at * F.log(rate / at) + at - rate - F.log(2 * math.pi * at) / 2 - 1 / (12 * at) + 1 / (360 * at * at * at)
    first = F.when(low == 0, -rate).otherwise(stirling)

    def state(log_p: F.Column, cdf: F.Column, n: F.Column) -> F.Column:
        return F.struct(log_p.alias("log_p"), cdf.alias("cdf"), n.alias("n"))

    def step(s: F.Column, k: F.Column) -> F.Column:
        log_p = s["log_p"] + F.log(rate / k)
        cdf = s["cdf"] + F.exp(log_p)
        return state(log_p, cdf, s["n"] + (cdf < u).cast("long"))

    begin = state(first, F.exp(first), low + (F.exp(first) < u).cast("long"))
    count = F.aggregate(F.sequence(low + 1, F.ceil(rate + spread)), begin, step, lambda s: s["n"])
    return F.when(rate > 0, count).otherwise(F.lit(0).cast("long"))


def repetition_rates(docs: DataFrame, weights: dict[str, float] | None, total: float | None) -> DataFrame:
    """source and rate: rate is weight share x total / documents of the source.

    Without weights all sources present count alike; a source that weights doesn't name gets rate 0. A null
    source is a source of its own. total defaults to the number of documents.
    """
    n = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        n = n.withColumn("weight", F.lit(1.0))
    else:
        named = F.create_map(*(F.lit(x) for k, v in weights.items() for x in (k, float(v))))
        n = n.withColumn("weight", F.coalesce(named[F.col("source")], F.lit(0.0)))
    sums = n.agg(F.sum(F.when(F.lit(weights is None), 1.0).otherwise(F.col("weight"))).alias("all"), F.sum("n").alias("docs"))
    if weights is not None:
        sums = sums.withColumn("all", F.lit(float(sum(weights.values()))))
    total_docs = F.col("docs") if total is None else F.lit(float(total))
    return n.join(F.broadcast(sums)).select("source", (F.col("weight") / F.col("all") * total_docs / F.col("n")).alias("rate"))  # sums is one row


def _known_rates(rates: DataFrame) -> DataFrame:
    """rates, to be sent to all tasks if it has at most MAX_SOURCES rows; else to be joined by source."""
    rows = rates.limit(MAX_SOURCES + 1).collect()
    return F.broadcast(rates.sparkSession.createDataFrame(rows, rates.schema)) if len(rows) <= MAX_SOURCES else rates


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """docs with each row repeated N times, N Poisson with the mean rate of its source, globally shuffled.

    Adds n_copies and copy (1..n_copies) to the columns of docs, after them; columns of docs with these names
    are replaced. Rows that draw 0 copies go: that is the sampling. Equal keys draw alike, so that repeated
    rows are repeated alike; a null key draws from the empty string. An empty table gives an empty table.
    The order within and across partitions is the shuffle. The rates of up to MAX_SOURCES sources are broadcast,
    so that documents move once, for the shuffle; those of more are joined, where Spark splits a hot source.
    """
    columns = [c for c in docs.columns if c not in ("n_copies", "copy")]
    docs = docs.select(*columns)
    source, rate, order = (_free(docs, x) for x in ("source", "rate", "order"))
    rates = _known_rates(repetition_rates(docs, weights, total).toDF(source, rate))
    drawn = docs.join(rates, docs["source"].eqNullSafe(rates[source])).withColumn("n_copies", poisson_count(F.col(rate), uniform(key, seed=seed)))
    # in runs of RUN copies, so that no row holds a list as long as its rate
    runs = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n_copies - 1) div {RUN}")))
    copies = drawn.where("n_copies > 0").select(*columns, "n_copies", runs.alias(order))
    of_run = F.sequence(F.col(order) * RUN + 1, F.least((F.col(order) + 1) * RUN, F.col("n_copies")))
    copies = copies.select(*columns, "n_copies", F.explode(of_run).alias("copy"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copies = copies.withColumn(order, F.xxhash64(F.lit(seed), F.col(key), F.col("copy")))
    return copies.repartition(parts, order).sortWithinPartitions(order, key, "copy").drop(order)


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    while name in docs.columns or name in ("n_copies", "copy"):
        name += "_"
    return name
