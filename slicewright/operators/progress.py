"""The progress log: latest states, elapsed times, flattened statistics, throttled updates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slicewright.session import share_package

#: The states that end a stage.
TERMINAL = ("success", "failed", "skipped")


def latest_state(log: DataFrame, key: list[str], ts: str, status: str, terminal: tuple[str, ...] = TERMINAL) -> DataFrame:
    """key, started_at, last_update_at, status (of the last update; of equals the greatest), finished_at (the last terminal update), n_updates."""
    return log.groupBy(*key).agg(
        F.min(ts).alias("started_at"), F.max(ts).alias("last_update_at"), F.max(F.struct(ts, status))[status].alias("status"),
        F.max(F.when(F.col(status).isin(*terminal), F.col(ts))).alias("finished_at"), F.count(F.lit(1)).alias("n_updates"),
    )


def merged_stats(log: DataFrame, key: list[str], ts: str, stats: str) -> DataFrame:
    """key, name, value: for each statistic the value written last; ``stats`` is a map. Right side wins, null keys are left out."""
    flat = log.select(*key, ts, F.explode(stats).alias("name", "value"))
    return flat.groupBy(*key, "name").agg(F.max(F.struct(ts, "value"))["value"].alias("value"))


def scalar_stats(json: str) -> Column:
    """The scalar fields of a JSON object as a map of text, nulls included; nested ones and broken objects are left out."""
    v = F.try_parse_json(json).cast("map<string,variant>")
    kind = lambda x: F.schema_of_variant(x)
    kept = F.map_filter(v, lambda k, x: ~kind(x).startswith("OBJECT") & ~kind(x).startswith("ARRAY"))
    return F.transform_values(kept, lambda k, x: x.cast("string"))


def moving_mean(df: DataFrame, by: list[str], order: list[str], value: str, k: int) -> DataFrame:
    """df with the mean of the last k values."""
    return df.withColumn("moving_mean", F.avg(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(-(k - 1), 0)))


def throttle(log: DataFrame, key: str, ts: str, seconds: float) -> DataFrame:
    """key, ts of the updates a throttled writer lets through: at least ``seconds`` after the last one it let through.

    It depends on what was let through before, so each key's log is walked in order; batches are streamed
    sorted by key, so no key is held in memory whole.
    """
    share_package(log.sparkSession)
    gap = int(seconds * 1_000_000)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last = None, None
        for pdf in batches:
            keep = []
            for k, t in zip(pdf["k"], pdf["t"]):
                if k != now:
                    now, last = k, None
                ok = last is None or t - last >= gap
                keep.append(ok)
                if ok:
                    last = t
            yield pdf[keep]

    kind = log.schema[key].dataType.simpleString()
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = log.where(F.col(ts).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), micros.alias("t"))
    walked = rows.repartition("k").sortWithinPartitions("k", "t").mapInPandas(run, f"k {kind}, t bigint")
    return walked.select(F.col("k").alias(key), F.timestamp_micros("t").cast("timestamp_ntz").alias(ts))
