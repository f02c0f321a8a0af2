"""Changes of keyed tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramaline.session import cut, discard


def insert_if_absent(there: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """there, as it is, and of new the rows whose keys it lacks: for each key the first by `order`."""
    value = [c for c in there.columns if c not in keys]
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*value), order).alias("_row")).select(*keys, "_row.*")
    return there.unionByName(first.join(there, keys, "left_anti"))


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The keyed table at a path, with its columns part and batch; None if there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def upsert_latest(new: DataFrame, batch: int, path: str, keys: list[str], value: str, parts: int = 64, keep: F.Column | None = None) -> None:
    """Put new rows into the keyed table at path: a key has the greatest value that came for it.

    The table is dealt by a hash of the keys into `parts` folders, a number that stays as it began, and only folders
    that new rows fall into are read and written again. Each holds the number of the batch that wrote it last, so
    that a batch that was stopped half way can be run again, as a stream's foreachBatch does: folders that have
    it already stay as they are. Batches come in order. keep: a condition on rows, those of the folders written that fail it go.
    Null keys are keys; null values lose to any other.
    """
    spark = new.sparkSession
    part = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")
    columns = [*keys, value]
    rows = cut(new.groupBy(*keys).agg(F.max(value).alias(value)).withColumn("part", part), "upsert")
    touched = {r[0] for r in rows.select("part").distinct().collect()}  # `parts` at most
    old = stored(spark, path)
    if old is not None and touched:
        old = old.where(F.col("part").isin(*touched))
        touched -= {r[0] for r in old.where(F.col("batch") >= batch).select("part").distinct().collect()}
    if touched:
        rows = rows.where(F.col("part").isin(*touched))
        both = rows if old is None else rows.unionByName(old.where(F.col("part").isin(*touched)).select(*columns, "part"))
        merged = both.groupBy(*keys, "part").agg(F.max(value).alias(value))
        # read before it is written over
        merged = cut(merged if keep is None else merged.where(keep), "merged")
        out = merged.select(*columns, F.lit(batch).cast("long").alias("batch"), "part").repartition("part")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
        discard(merged)
    discard(rows)
