"""Scores from instances to images, cases and rounds, and the hard samples among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slicewright.operators.metrics import worst_fraction_mean


def finite(iou: Column) -> Column:
    """NaN, infinite and null overlaps count as 0."""
    return F.when(iou.isNull() | F.isnan(iou) | (F.abs(iou) == float("inf")), 0.0).otherwise(iou)


def per_image(images: DataFrame, instances: DataFrame, key: list[str], threshold: float) -> DataFrame:
    """key, num_instances, macro, least, empties, passes, hard: an image without instances has 1.0."""
    agg = instances.groupBy(*key).agg(F.count(F.lit(1)).alias("num_instances"), F.avg(finite(F.col("iou"))).alias("macro"), F.min(finite(F.col("iou"))).alias("least"), F.count_if("prediction_empty").alias("empties"))
    df = images.select(*key).distinct().join(agg, key, "left")
    df = df.select(*key, F.coalesce("num_instances", F.lit(0)).alias("num_instances"), F.coalesce("macro", F.lit(1.0)).alias("macro"), F.coalesce("least", F.lit(1.0)).alias("least"), F.coalesce("empties", F.lit(0)).alias("empties"))
    return df.withColumn("passes", F.col("least") >= threshold).withColumn("hard", F.col("least") < threshold)


def per_case(labels: DataFrame, case: list[str], threshold: float) -> DataFrame:
    """case, macro (mean of pooled class overlaps), least, worst20, missed, hard.

    ``labels``: case, slice, label, inter, uni, gt, pred for each label in the truth of a slice. Slices whose
    union is empty have no overlap of their own; a case with nothing to evaluate has 1.0.
    """
    pooled = labels.groupBy(*case, "label").agg(F.sum("inter").alias("i"), F.sum("uni").alias("u"), F.sum("gt").alias("g"), F.sum("pred").alias("p")).where("g > 0")
    by_case = pooled.groupBy(*case).agg(F.avg(F.coalesce(F.try_divide("i", "u"), F.lit(0.0))).alias("macro"), F.count_if(F.col("p") == 0).alias("missed"), F.count(F.lit(1)).alias("n_classes"))
    slices = labels.where("uni > 0").withColumn("iou", F.col("inter") / F.col("uni"))
    least = slices.groupBy(*case).agg(F.min("iou").alias("least"), F.count(F.lit(1)).alias("n_evaluated"))
    worst = worst_fraction_mean(slices, case, "iou", 0.2)
    df = labels.select(*case).distinct().join(by_case, case, "left").join(least, case, "left").join(worst, case, "left")
    df = df.na.fill(1.0, ["macro", "least", "worst"]).na.fill(0, ["missed", "n_classes", "n_evaluated"])
    return df.withColumn("hard", (F.col("least") < threshold) | (F.col("missed") > 0))


def round_summary(images: DataFrame, key: list[str]) -> DataFrame:
    """key, n, all_pass, least (1.0 if none), n_hard, empties. NaN counts as 0."""
    least = finite(F.col("image_min_iou"))
    return images.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("all_instance_iou_ge_threshold") == 1).alias("all_pass"), F.coalesce(F.min(least), F.lit(1.0)).alias("least"), F.sum("hard_candidate").alias("n_hard"), F.sum("empty_instance_count").alias("empties"))


def hard_ranking(images: DataFrame, key: list[str], ident: str, threshold: float, n: int) -> DataFrame:
    """The n hardest below the threshold: least overlap first, then more empties, then lower mean, then id, with place."""
    df = images.withColumn("_l", finite(F.col("image_min_iou"))).withColumn("_m", finite(F.col("image_macro_iou")))
    order = Window.partitionBy(*key).orderBy("_l", F.desc("empty_instance_count"), "_m", ident)
    return df.where(F.col("_l") < threshold).withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).drop("_l", "_m")
