"""Cutting the rows of large keys into slots of time, so that ordered work on a key needs no task that holds all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slicewright.session import materialize

#: Rows of a key that one task may hold; a larger key is cut into slots of about so many.
SLOT_ROWS = 1_000_000
#: Minutes of rows without a time: before all others.
NO_TIME = -(1 << 40)


def minute_of(t: Column) -> Column:
    return F.coalesce(F.floor(F.unix_micros(t.cast("timestamp")) / 60_000_000), F.lit(NO_TIME)).cast("bigint")


def large_keys(df: DataFrame, key: str, rows: int = SLOT_ROWS) -> DataFrame:
    """The values of ``key`` with more than ``rows`` rows, one column; counted exactly, folded before the shuffle."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows).select(key)


def slot_running_sums(df: DataFrame, key: str, t: str, ties: list[str], values: list[str], rows: int = SLOT_ROWS) -> DataFrame:
    """``df`` with ``n_<value>``: the sum of each value over the rows of the key up to and with this one by (t, ties), nulls first.

    A key with more than ``rows`` rows is cut at minutes into slots of about ``rows`` rows: the sums per minute, of
    which a decade has five million, tell where a slot begins and what comes before it; rows are ordered within
    their slot only. A single minute is never cut. How keys are cut changes no result.
    """
    large = materialize(large_keys(df, key, rows), "large")
    if large.isEmpty():
        parts, by = df, [key]
    else:
        warm = df.join(large, key, "left_semi").withColumn("_minute", minute_of(F.col(t)))
        minutes = warm.groupBy(key, "_minute").agg(F.count(F.lit(1)).alias("_n"), *(F.sum(v).alias(f"_s_{v}") for v in values))
        before = Window.partitionBy(key).orderBy("_minute").rowsBetween(Window.unboundedPreceding, -1)
        sofar = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
        placed = minutes.select(key, "_minute", F.floor(sofar("_n") / rows).alias("_slot"), *(sofar(f"_s_{v}").alias(f"_c_{v}") for v in values))
        first = Window.partitionBy(key, "_slot").orderBy("_minute")
        placed = materialize(placed.select(key, "_minute", "_slot", *(F.first(f"_c_{v}").over(first).alias(f"_c_{v}") for v in values)), "minutes")
        warm = warm.join(placed, [key, "_minute"]).drop("_minute")
        cold = df.join(large, key, "left_anti")
        parts = warm.unionByName(cold.withColumn("_slot", F.lit(0).cast("bigint")).withColumns({f"_c_{v}": F.lit(0).cast("bigint") for v in values}))
        by = [key, "_slot"]
    running = Window.partitionBy(*by).orderBy(t, *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = parts.withColumns({f"n_{v}": F.sum(v).over(running) + (F.col(f"_c_{v}") if len(by) > 1 else F.lit(0)) for v in values})
    return out.select(*df.columns, *(f"n_{v}" for v in values))
