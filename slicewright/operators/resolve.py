"""From competing evidence to one label per pixel.

``resolve_slices`` takes dense evidence, a row an instance, and works through the few instances of a slice at once: pixels
never become rows. The long forms (slice, label, pos, probability, support) are for evidence that comes by pixel;
they are DataFrame aggregations with map-side combine, and gather at most one entry a class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slicewright.functions import mask as M
from slicewright.functions import number
from slicewright.session import share_package

IGNORE = 255
TIE = 1e-6


def same_class_evidence(evidence: DataFrame) -> DataFrame:
    """slice, label, pos, support (any) and probability (the greatest of the supported, cleaned)."""
    p = F.when(F.col("support"), number.clean_probability(F.col("probability"))).otherwise(F.lit(0.0))
    return evidence.groupBy("slice", "label", "pos").agg(F.bool_or("support").alias("support"), F.max(p).alias("probability"))


def resolve(union: DataFrame, evidence: DataFrame, tie: float = TIE) -> DataFrame:
    """slice, pos, n_support, gap, value for each pixel of ``union`` (slice, pos): the pixels in any prompt.

    Without support 255; with one class that class; with more the most probable, unless the next one is within
    ``tie``: then 255. Pixels outside of the union are not in the result: they are 0. Evidence outside of it is
    ignored. Labels must be 1 to 254; others are dropped.
    """
    good = evidence.where(F.col("support") & (F.col("label") > 0) & (F.col("label") < IGNORE))
    votes = good.groupBy("slice", "pos").agg(F.sort_array(F.collect_list(F.struct("probability", (-F.col("label")).alias("neg"))), asc=False).alias("v"))
    df = union.select("slice", "pos").distinct().join(votes, ["slice", "pos"], "left")
    n = F.coalesce(F.size("v"), F.lit(0))
    n = F.when(F.col("v").isNull(), 0).otherwise(n)
    first, second = F.get("v", F.lit(0)), F.get("v", F.lit(1))
    gap = F.when(n >= 2, first["probability"] - second["probability"])
    value = F.when(n == 0, IGNORE).when((n >= 2) & (gap <= tie), IGNORE).otherwise(-first["neg"])
    return df.select("slice", "pos", n.alias("n_support"), gap.alias("gap"), value.cast("int").alias("value"))


def resolve_slices(evidence: DataFrame, union: DataFrame, tie: float = TIE) -> DataFrame:
    """slice, n_support, value: arrays over the pixels of a slice, by the rules of ``resolve`` and ``same_class_evidence``.

    ``evidence``: slice, label, probability (array<double>), support (array<boolean>), a row an instance; ``union``: slice,
    inside (array<boolean>, the pixels in any prompt). Values are 0 outside of the union. A label other than 1 to 254 is
    an error. Rows with a null slice or array are left out. What is gathered are the instances of one slice.
    """
    share_package(evidence.sparkSession)
    good = evidence.where(F.col("probability").isNotNull() & F.col("support").isNotNull() & F.col("label").isNotNull())
    held = good.groupBy("slice").agg(F.collect_list(F.struct(F.col("label").cast("int").alias("label"), F.col("probability").cast("array<double>").alias("p"), F.col("support").alias("s"))).alias("e"))
    rows = union.where(F.col("inside").isNotNull()).select("slice", "inside").join(held, "slice", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # a slice at a time: dense evidence is large
                inside = b.column(1).slice(i, 1).flatten().fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
                one = b.column(2).slice(i, 1).flatten()
                labels = one.field("label").to_numpy(zero_copy_only=False)
                if ((labels <= 0) | (labels >= IGNORE)).any():
                    raise ValueError(f"labels are 1 to {IGNORE - 1}")
                classes = np.unique(labels)
                best = np.full((len(classes), len(inside)), -1.0)
                if len(labels):
                    wide = lambda f, null: one.field(f).flatten().fill_null(null).to_numpy(zero_copy_only=False).reshape(len(labels), -1)
                    p, s = np.nan_to_num(wide("p", 0.0), nan=0.0, posinf=1.0, neginf=0.0).clip(0.0, 1.0), wide("s", False).astype(bool)
                    np.maximum.at(best, np.searchsorted(classes, labels), np.where(s, p, -1.0))
                n = (best >= 0).sum(0)
                value = np.full(len(inside), IGNORE)
                if len(classes):
                    top = best.argmax(0)  # of equals the least label; they are tied below
                    first = best.max(0)
                    second = np.partition(best, -2, axis=0)[-2] if len(classes) > 1 else np.full(len(inside), -1.0)
                    sure = (n == 1) | ((n >= 2) & (first - second > tie))
                    value = np.where(sure, classes[top], IGNORE)
                value, n = np.where(inside, value, 0), np.where(inside, n, 0)
                whole = lambda v, kind: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, kind))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), whole(n, pa.int32()), whole(value, pa.int16())], names=["slice", "n_support", "value"])

    return rows.mapInArrow(run, f"slice {union.schema['slice'].dataType.simpleString()}, n_support array<int>, value array<smallint>")


def resolver_statistics(resolved: DataFrame) -> DataFrame:
    """Per slice: pixels of the union, without support, with one class, contested, tied, confirmed, ignored."""
    n, v = F.col("n_support"), F.col("value")
    return resolved.groupBy("slice").agg(
        F.count(F.lit(1)).alias("union_pixels"), F.count_if(n == 0).alias("no_support"), F.count_if(n == 1).alias("single"), F.count_if(n >= 2).alias("contested"),
        F.count_if((n >= 2) & (v == IGNORE)).alias("tied"), F.count_if(v != IGNORE).alias("confirmed"), F.count_if(v == IGNORE).alias("ignored"),
    )


def contradictions(resolved: DataFrame, evidence: DataFrame) -> DataFrame:
    """Confirmed pixels whose class has no support there: must be empty."""
    back = evidence.where("support").select("slice", "pos", F.col("label").alias("value")).distinct()
    return resolved.where(F.col("value") != IGNORE).join(back, ["slice", "pos", "value"], "left_anti")


def rebuild(confirmed: DataFrame, cover: DataFrame) -> DataFrame:
    """slice, y, x, value: 255 in any box, then the confirmed class where it lies in a box of its own label.

    ``confirmed``: slice, y, x, value; ``cover``: slice, label, y, x. A confirmed pixel outside of its own boxes
    becomes 255 if another class's box covers it, else nothing.
    """
    own = confirmed.join(cover.select("slice", F.col("label").alias("value"), "y", "x"), ["slice", "y", "x", "value"], "left_semi")
    any_box = cover.select("slice", "y", "x").distinct()
    return any_box.join(own, ["slice", "y", "x"], "left").select("slice", "y", "x", F.coalesce("value", F.lit(IGNORE)).alias("value"))


def best_candidates(candidates: DataFrame, instance: list[str], score: str = "score") -> DataFrame:
    """The candidate of the highest score of each instance; of equals the lowest index."""
    order = Window.partitionBy(*instance).orderBy(F.desc(score), "candidate_index")
    return candidates.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def score_candidates(candidates: DataFrame, h: int, w: int, multiclass: Column, refined: str | None = None) -> DataFrame:
    """Candidates with a raw mask, with raw_area, outside, area and fused score; those with an empty mask are rejected.

    ``candidates``: logits (dense array), model_score, box, candidate_index; ``refined``: a column with the
    refined mask, else the raw mask within the box counts.
    """
    df = candidates.withColumn("raw", M.threshold(F.col("logits"))).withColumn("inside", M.box_mask(F.col("box"), h, w))
    df = df.withColumn("o", M.overlap(F.col("raw"), F.col("inside")))
    area = M.dense_area(F.col(refined)) if refined else F.col("o.inter")
    df = df.withColumn("raw_area", F.col("o.a")).withColumn("outside", F.col("o.a") - F.col("o.inter")).withColumn("area", area)
    score = number.fused_score(F.col("model_score"), F.col("area"), F.col("o.b"), F.col("outside"), F.col("raw_area"), multiclass)
    return df.where("raw_area > 0 and area > 0").withColumn("score", score).drop("o", "inside")


def reweighted_choice(candidates: DataFrame, instance: list[str], n_points: str, first: float = 1000.0) -> DataFrame:
    """The candidate with the highest predicted overlap, the first one favoured for more than two points and shunned for fewer."""
    bonus = F.when(F.col("candidate_index") == 0, (F.col(n_points) - 2.5) * first).otherwise(0.0)
    return best_candidates(candidates.withColumn("score", F.col("model_score") + bonus), instance)


def later_label_wins(pixels: DataFrame, key: list[str], label: str, order: str) -> DataFrame:
    """One label per pixel where later writes overwrite earlier ones."""
    return pixels.groupBy(*key).agg(F.max_by(label, order).alias(label))
