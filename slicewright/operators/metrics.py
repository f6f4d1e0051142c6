"""Quality metrics: surface distances, weighted percentiles, worst fractions, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_mean_distance(surfels: DataFrame, key: list[str], area: Column) -> DataFrame:
    """key, mean_ab, mean_ba: mean distances weighted by area, each way; NaN without surface, infinite against none."""
    mean = lambda s: F.try_divide(F.sum(F.when(F.col("side") == s, F.col("distance") * area)), F.sum(F.when(F.col("side") == s, area)))
    return surfels.groupBy(*key).agg(mean("a").alias("mean_ab"), mean("b").alias("mean_ba"))


def surface_overlap(surfels: DataFrame, key: list[str], tolerance: float, area: Column) -> DataFrame:
    """key, overlap_a, overlap_b, surface_dice: parts of the surfaces within ``tolerance`` of the other."""
    near = F.col("distance") <= tolerance
    part = lambda s: F.try_divide(F.sum(F.when(F.col("side") == s, F.when(near, area).otherwise(0.0))), F.sum(F.when(F.col("side") == s, area)))
    whole = F.try_divide(F.sum(F.when(near, area).otherwise(0.0)), F.sum(area))
    return surfels.groupBy(*key).agg(part("a").alias("overlap_a"), part("b").alias("overlap_b"), whole.alias("surface_dice"))


def weighted_percentile(df: DataFrame, key: list[str], value: str, weight: Column, percent: float) -> DataFrame:
    """key, value: the first value, in ascending order, at which the weight so far reaches the percentage of all of it.

    Equal values are folded first, so a window holds the distinct values of a key.
    """
    folded = df.withColumn("_w", weight).groupBy(*key, value).agg(F.sum("_w").alias("_w"))
    order = Window.partitionBy(*key).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    share = F.sum("_w").over(order) / F.sum("_w").over(Window.partitionBy(*key))
    ranked = folded.withColumn("_s", share)
    # sums of floats may end a hair below 1: the last value then stands in
    return ranked.groupBy(*key).agg(F.coalesce(F.min(F.when(F.col("_s") >= percent / 100.0, F.col(value))), F.max(value)).alias(value))


def robust_hausdorff(surfels: DataFrame, key: list[str], percent: float, area: Column) -> DataFrame:
    """key, hausdorff: the larger of both sides' percentile distances."""
    return weighted_percentile(surfels, [*key, "side"], "distance", area, percent).groupBy(*key).agg(F.max("distance").alias("hausdorff"))


def surface_measures(surfels: DataFrame, key: list[str], tolerance: float, percent: float, area: Column) -> DataFrame:
    """key, mean_ab, mean_ba, overlap_a, overlap_b, surface_dice, hausdorff: all measures above from one pass over the surfels.

    Surfels of one distance are folded first, so each group holds its distinct distances.
    """
    folded = surfels.withColumn("_w", area).groupBy(*key, "side", "distance").agg(F.sum("_w").alias("_w"))
    by = Window.partitionBy(*key, "side")
    share = F.sum("_w").over(by.orderBy("distance").rowsBetween(Window.unboundedPreceding, Window.currentRow)) / F.sum("_w").over(by)
    ranked = folded.withColumn("_s", share).groupBy(*key, "side").agg(
        F.sum("_w").alias("_w"),
        F.sum(F.col("distance") * F.col("_w")).alias("_d"),
        F.sum(F.when(F.col("distance") <= tolerance, F.col("_w")).otherwise(0.0)).alias("_n"),
        F.coalesce(F.min(F.when(F.col("_s") >= percent / 100.0, F.col("distance"))), F.max("distance")).alias("_h"),
    )
    of = lambda c, s: F.max(F.when(F.col("side") == s, F.col(c)))
    return ranked.groupBy(*key).agg(
        F.try_divide(of("_d", "a"), of("_w", "a")).alias("mean_ab"),
        F.try_divide(of("_d", "b"), of("_w", "b")).alias("mean_ba"),
        F.try_divide(of("_n", "a"), of("_w", "a")).alias("overlap_a"),
        F.try_divide(of("_n", "b"), of("_w", "b")).alias("overlap_b"),
        F.try_divide(F.sum("_n"), F.sum("_w")).alias("surface_dice"),
        F.max("_h").alias("hausdorff"),
    )


def worst_fraction_mean(df: DataFrame, key: list[str], value: str, fraction: float = 0.2) -> DataFrame:
    """key, worst: mean of the lowest ``fraction`` of the values, rounded up to whole ones. NaN and null are left out.

    Equal values are folded to counts before they are ranked, so a hot key holds its distinct values only.
    """
    good = df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*key, value).agg(F.count(F.lit(1)).alias("_k"))
    order = Window.partitionBy(*key).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = good.withColumn("_upto", F.sum("_k").over(order)).withColumn("_n", F.sum("_k").over(Window.partitionBy(*key)))
    take = F.greatest(F.lit(0), F.least(F.col("_k"), F.ceil(F.col("_n") * fraction) - (F.col("_upto") - F.col("_k"))))
    return run.withColumn("_t", take).groupBy(*key).agg((F.sum(F.col(value) * F.col("_t")) / F.sum("_t")).alias("worst"))


def gain(before: Column, after: Column) -> Column:
    return after - before


def gap_closure(base: Column, ours: Column, full: Column) -> Column:
    """The part of the gap between base and full supervision that is closed; null without a gap."""
    return F.try_divide(ours - base, full - base)
