"""Document fingerprints by consistent weighted sampling, with DataFrame functions only.

A document is a bag of words weighted by count. Sample i gives each word gamma(2, 1) variables r and c and a
uniform b, all from hashes of word and i. With t = floor(ln(weight) / r + b), the sample is the word, and its t,
of least ln(c) - r (t - b) - r. Two documents agree in a sample with a probability equal to their generalised
Jaccard similarity, the sum of least weights over the sum of greatest.

The text is shuffled once by document; from there on, counting words and taking minima stay in the partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramaline.session import cut

SAMPLES = 32
_MASK = (1 << 32) - 1


def _unit(x: Column, shift: int, bits: int) -> Column:
    """A uniform number in (0, 1) from some bits of a hash."""
    return (F.shiftrightunsigned(x, shift).bitwiseAND(F.lit((1 << bits) - 1)).cast("double") + 0.5) / float(1 << bits)


def sample_keys(term: str, log_weights: list[str], i: int) -> list[Column]:
    """Sample i of a word (its 64-bit hash) at each weight: a long that orders by the sampled value.

    Its high bits are the value, its low 32 bits name word and t. Null where the weight's logarithm is null.
    """
    x, y = F.xxhash64(F.lit(2 * i), F.col(term)), F.xxhash64(F.lit(2 * i + 1), F.col(term))
    r = -F.log(_unit(x, 38, 26) * _unit(x, 12, 26))
    log_c = F.log(-F.log(_unit(y, 38, 26) * _unit(y, 12, 26)))
    b = (F.shiftleft(x.bitwiseAND(F.lit(4095)), 12).bitwiseOR(y.bitwiseAND(F.lit(4095))).cast("double") + 0.5) / float(1 << 24)
    out = []
    for w in log_weights:
        t = F.floor(F.col(w) / r + b)
        value = F.floor((log_c - r * (t - b) - r + 128.0) * float(1 << 22))
        name = F.col(term).bitwiseXOR(t * F.lit(2654435761)).bitwiseAND(F.lit(_MASK))
        out.append(F.shiftleft(value, 32).bitwiseOR(name))
    return out


def signature(keys: list[str]) -> Column:
    """8 hex digits per sample; of a text without words, all are f."""
    part = [F.lpad(F.lower(F.hex(F.coalesce(F.col(k), F.lit(-1).cast("long")).bitwiseAND(F.lit(_MASK)))), 8, "0") for k in keys]
    return F.concat(*part)


def likeness(a: str, b: str, samples: int = SAMPLES) -> Column:
    """Share of samples in which two signatures agree: an estimate of their generalised Jaccard similarity."""
    same = [F.when(F.substring(a, 8 * i + 1, 8) == F.substring(b, 8 * i + 1, 8), 1).otherwise(0) for i in range(samples)]
    total = same[0]
    for x in same[1:]:
        total = total + x
    return total.cast("double") / samples


def signatures(texts: DataFrame, first: str, second: str, samples: int = SAMPLES) -> DataFrame:
    """k, fp_first and fp_second of two texts per row; texts is dealt by its unique key k.

    Words are what white space separates, as they are written.
    """
    flat = lambda c: F.translate(c, "\t\n\x0b\f\r", "     ")
    a, b = flat(first), flat(second)
    words = texts.select("k", (F.length(a) - F.length(F.replace(a, F.lit(" "))) + 1).alias("n"), F.split(F.concat_ws(" ", a, b), " ").alias("words"))
    words = words.select("k", "n", F.posexplode("words").alias("at", "word"))
    real = F.when(F.col("word") == "", 0)
    counts = words.groupBy("k", F.xxhash64("word").alias("term")).agg(
        F.sum(real.when(F.col("at") < F.col("n"), 1).otherwise(0)).alias("w0"), F.sum(real.when(F.col("at") >= F.col("n"), 1).otherwise(0)).alias("w1")
    )
    counts = counts.select("k", "term", *(F.when(F.col(w) > 0, F.log(F.col(w).cast("double"))).alias(w) for w in ("w0", "w1")))
    keys = [sample_keys("term", ["w0", "w1"], i) for i in range(samples)]
    least = counts.groupBy("k").agg(*(F.min(key).alias(f"s{j}_{i}") for i, pair in enumerate(keys) for j, key in enumerate(pair)))
    return least.select("k", *(signature([f"s{j}_{i}" for i in range(samples)]).alias(f"fp_{name}") for j, name in enumerate(("first", "second"))))


def with_next(ids: DataFrame) -> DataFrame:
    """ids (k, doc_id, n_chars, n_rows) with next_k and next_take, by descending doc_id, the first after the last.

    Sorted across the cluster; neighbours are found within range partitions, whose ends are then tied together.
    """
    spark = ids.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("k")]
    ranged = ids.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = cut(ranged.withColumn("part", F.spark_partition_id()), "order")
    inner = ranged.withColumn("next_k", F.lead("k").over(Window.partitionBy("part").orderBy(*order)))
    # one row per partition, so bound by the number of partitions
    firsts = sorted((r[0], r[1]) for r in ranged.groupBy("part").agg(F.min_by("k", F.struct(F.col("doc_id").isNull(), -F.col("doc_id"), "k"))).collect())
    following = [(p, firsts[(i + 1) % len(firsts)][1]) for i, (p, _) in enumerate(firsts)]
    ends = F.create_map(*(F.lit(x) for pair in following for x in pair)) if following else F.create_map(F.lit(0), F.lit(0).cast("long"))
    return inner.withColumn("next_k", F.coalesce("next_k", ends[F.col("part")])).drop("part")


def edited_fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """One row per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many (or all) of the
    next document by descending doc_id. Null text counts as empty; a text without words has the fingerprint of
    all f. Rows alike in doc_id and text are one document here and come out as often as they came in; rows that
    share a doc_id only, or have none (these come last), go by a hash of their text. One document alone is its
    own next. Other columns are not read.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("k", F.xxhash64("doc_id", "text"))
    ids = with_next(base.groupBy("k", "doc_id", F.length("text").cast("long").alias("n_chars")).agg(F.count("*").alias("n_rows")))
    ids = cut(ids, "next")
    texts = base.select("k", "text")
    if ids.agg(F.max("n_rows")).first()[0] not in (None, 1):
        texts = texts.dropDuplicates(["k"])
    texts = texts.repartition(parts, "k")
    take = F.floor(F.col("n_chars") / 3).cast("int")
    lent = texts.join(ids.select(F.col("next_k").alias("k"), F.col("k").alias("to"), take.alias("take")), "k").select(F.col("to").alias("k"), F.expr("substring(text, 1, take)").alias("lent"))
    both = texts.join(lent, "k").withColumn("cut", F.length("text") - F.floor(F.length("text") / 3).cast("int"))
    both = both.select("k", "text", F.concat(F.expr("substring(text, 1, cut)"), F.col("lent")).alias("edited"))
    prints = signatures(both, "text", "edited", samples).join(both.select("k", F.sha2("edited", 256).alias("edited_sha256")), "k")
    prints = cut(prints, "fingerprints")
    following = prints.select(F.col("k").alias("next_k"), F.col("fp_first").alias("fp_next"))
    out = ids.join(prints, "k").join(following, "next_k")
    out = out.select(
        "doc_id", "n_chars", "edited_sha256", F.col("fp_first").alias("fingerprint"), F.col("fp_second").alias("edited_fingerprint"),
        likeness("fp_first", "fp_second", samples).alias("near_edited"), likeness("fp_first", "fp_next", samples).alias("near_next"), "n_rows",
    )
    return out.withColumn("n_rows", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows")))).drop("n_rows")
