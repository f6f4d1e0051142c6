"""The progress log as a stream. This goes beyond batch use: late updates within the watermark count, later ones don't."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from slicewright.session import share_package


def read_log(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def deduplicated(log: DataFrame, ident: str, ts: str, lateness: str = "1 hour") -> DataFrame:
    """Each update once, however often it is delivered within the lateness."""
    return log.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness).dropDuplicatesWithinWatermark([ident])


def windowed_counts(log: DataFrame, ts: str, kind: str, width: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """start, kind, n, value: updates per window, final once the watermark has passed it."""
    timed = log.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    out = timed.groupBy(F.window(ts, width), kind).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return out.select(F.col("window.start").alias("start"), kind, "n", "value")


def throttled(log: DataFrame, key: str, ts: str, seconds: float) -> DataFrame:
    """key, ts of updates let through: at least ``seconds`` after the last one that was, per key, across batches."""
    share_package(log.sparkSession)
    kind = log.schema[key].dataType.simpleString()
    gap = pd.Timedelta(seconds=seconds)

    def step(ident: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        times = sorted(t for f in frames for t in f[ts])
        kept = []
        for t in times:
            if last is None or t - last >= gap:
                kept.append(t)
                last = t
        if last is not None:
            state.update((last.value // 1000,))
        yield pd.DataFrame({key: [ident[0]] * len(kept), ts: kept})

    timed = log.select(key, F.col(ts).cast("timestamp_ntz").alias(ts))
    return timed.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {ts} timestamp_ntz", "last bigint", "append", GroupStateTimeout.NoTimeout)


def append_once(df: DataFrame, path: str, checkpoint: str):
    """A sink that writes each batch under its number, so a batch that is run again replaces itself."""
    return df.writeStream.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")).option("checkpointLocation", checkpoint).trigger(availableNow=True)
