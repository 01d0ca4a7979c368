"""Streams: append logs whose latest record wins, accumulation over runs, window counts, late rows, request quotas.

Every query can be drained by the `availableNow` trigger and then equals its batch counterpart.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def upsert_latest(log: DataFrame, keys: list[str], order: str, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps a table of each key's latest record, merged batch by batch.

    Batch n writes folder v=n from folder v=n-1, so that a batch that is run again after a failure gives the same table.
    """
    rest = [c for c in log.columns if c not in keys]

    def merge(batch: DataFrame, n: int) -> None:
        rows = batch
        if n > 0:
            rows = batch.sparkSession.read.parquet(f"{path}/v={n - 1}").select(*batch.columns).unionByName(batch)
        rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(*keys, "_r.*").write.mode("overwrite").parquet(f"{path}/v={n}")

    return log.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(stream: DataFrame, key: str, time: str, delay: str, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the first row of each key within the watermark: what a run adds to all runs before it."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key]).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def window_counts(rows: DataFrame, time: str, width: str, by: str, delay: str | None = None) -> DataFrame:
    """Rows (start, by, n, value) by tumbling window; on a stream with a watermark."""
    timed = rows.withWatermark(time, delay) if delay else rows
    return timed.groupBy(F.window(time, width), by).agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), by, "n", "value")


def sessions(rows: DataFrame, time: str, gap: str, by: str) -> DataFrame:
    """Rows (by, start, finish, n) of activity without a longer pause."""
    return rows.groupBy(F.session_window(time, gap), by).agg(F.count("*").alias("n")).select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("finish"), "n")


def late_counts(rows: DataFrame, time: str, since: str, until: str, by: str) -> DataFrame:
    """Rows (by, n, outside): nothing is dropped; rows outside the window are counted."""
    outside = ~F.col(time).between(F.lit(since).cast("timestamp"), F.lit(until).cast("timestamp"))
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.count(F.when(outside, 1)).alias("outside"))


def daily_quota(requests: DataFrame, cap: int) -> DataFrame:
    """Adds allowed to a stream of requests (source, day, request): a counter by source and day, kept as state."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used = state.get[0] if state.exists else 0
        for batch in batches:
            batch = batch.sort_values("request")
            place = used + pd.Series(range(1, len(batch) + 1), index=batch.index)
            used += len(batch)
            yield pd.DataFrame({"source": key[0], "day": key[1], "request": batch["request"], "allowed": place <= cap})
        state.update((used,))

    return requests.groupBy("source", "day").applyInPandasWithState(run, "source string, day string, request long, allowed boolean", "used long", "append", GroupStateTimeout.NoTimeout)


def drained(query: StreamingQuery) -> None:
    """Waits until everything that is there has been worked through."""
    query.awaitTermination()


def resumable(plan: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The planned partitions that no complete record covers."""
    return plan.join(done.where("complete").select(key).distinct(), key, "left_anti")


def file_stream(spark: SparkSession, path: str, schema: StructType, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
