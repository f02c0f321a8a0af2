"""Structured Streaming jobs, run to the end of what is there (availableNow)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tramaline.session import shared_folder


def event_stream(spark: SparkSession, sf_dir: str, late: str = "1 day") -> DataFrame:
    """The events table as a stream of files. Rows later than the watermark by more than `late` are dropped from
    windows; state of keys lives as long."""
    static = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(static.schema).parquet(f"{sf_dir}/event[s].parquet")
    return stream.withColumn("ts", stream.ts.cast("timestamp")).withWatermark("ts", late)


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Run the stream over all rows that are there; its result, as a table in the shared folder.

    append: rows as they come. complete: the whole result, replaced at each batch. The checkpoint is in the
    shared folder too, so that a restarted driver can go on.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{base}/out").start()
    else:
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{base}/out")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def cooldown_alerts(stream: DataFrame, key: str, seconds: int) -> DataFrame:
    """One alert per key in so many seconds of event time: key and ts of the rows that alert.

    Rows of a batch go in order of ts; one that comes later than its key's last alert's own time counts against
    it as if it were on time. State is one time stamp per key, dropped a cooldown after its last alert.
    """

    def alert(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        times = pd.concat([f.ts for f in frames]).sort_values()
        out = []
        for t in times:
            at = t.timestamp()
            if last is None or at - last >= seconds:
                out.append(t)
                last = at
        state.update((last,))
        state.setTimeoutTimestamp(max(int(last * 1000), state.getCurrentWatermarkMs()) + seconds * 1000 + 1)
        yield pd.DataFrame({key: [k[0]] * len(out), "ts": out})

    kind = stream.schema[key].dataType.simpleString()
    return stream.select(key, "ts").groupBy(key).applyInPandasWithState(alert, f"{key} {kind}, ts timestamp", "last double", "append", GroupStateTimeout.EventTimeTimeout)


def streamed_again(table: DataFrame) -> DataFrame:
    """A drained table as a stream of its files, for a job that goes on from it."""
    folder = table.inputFiles()[0].rsplit("/", 1)[0] if table.inputFiles() else None
    if folder is None:
        raise ValueError("the table has no files")
    return table.sparkSession.readStream.schema(table.schema).parquet(folder)


def bounded_alerts(stream: DataFrame, key: str, seconds: int, most: int) -> DataFrame:
    """Of alerts (key, ts) the first `most` in each span of so many seconds, counted from the epoch.

    Rows of a batch go in order of ts, then key. State is one number per span, dropped a span after its end.
    """
    kind = stream.schema[key].dataType.simpleString()

    def bound(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n = state.get[0] if state.exists else 0
        out = pd.concat(list(frames)).sort_values(["ts", key])[[key, "ts"]].head(max(0, most - n))
        state.update((n + len(out),))
        state.setTimeoutTimestamp(max((int(k[0]) + 2) * seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield out

    spans = stream.withWatermark("ts", f"{seconds} seconds").withColumn("span", F.floor(F.unix_timestamp("ts") / seconds))
    return spans.groupBy("span").applyInPandasWithState(bound, f"{key} {kind}, ts timestamp", "n long", "append", GroupStateTimeout.EventTimeTimeout)
