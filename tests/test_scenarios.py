"""Small folds from end to end."""

import numpy as np
from pyspark.sql import functions as F

from slicewright.functions import box, number
from slicewright.operators import catalog, components, raster, resolve, scoring, supervision

NAMES = [f"train__s{i:02d}.npy" for i in range(8)]


def fold(spark, names):
    m = np.zeros((16, 16), bool)
    m[3:10, 4:12] = True
    return spark.createDataFrame([(n, [16, 16], raster.encode_runs(m).tolist()) for n in names], "slice_name string, mask_hw array<int>, counts array<int>")


def test_toy_fold(spark):
    """From masks to boxes on the canvas, the first images to annotate, and their training pairs."""
    comp = components.mask_components(fold(spark, NAMES), "slice_name")
    side = F.lit(16)
    g = box.canvas_geometry(side, side, F.lit(32), F.lit(32))
    transform = F.struct(g["scale"].alias("scale_x"), g["scale"].alias("scale_y"), g["offset_x"].alias("offset_x"), g["offset_y"].alias("offset_y"), g["target_h"].alias("target_h"), g["target_w"].alias("target_w"))
    native = F.array(*(F.col(x).cast("double") for x in ("x1", "y1", "x2", "y2")))
    boxes = comp.select("slice_name", "component", native.alias("native")).withColumn("t", transform).withColumn("teacher", box.native_to_teacher(F.col("native"), F.col("t")))
    rows = boxes.collect()
    assert len(rows) == 8 and all(r.native == [4.0, 3.0, 11.0, 9.0] and r.teacher == [8.0, 6.0, 22.0, 18.0] for r in rows)
    quota = spark.range(1).select(number.quota_2d(F.lit(8))).first()[0]
    assert quota == 1
    first = catalog.sample_exact(boxes, "slice_name", quota, 2026)
    inst = F.struct(F.lit(1).alias("label_id"), F.col("component").alias("component_id"), F.col("native").alias("bbox_native"))
    prompts = boxes.where(F.col("slice_name").isin(first)).select("slice_name", F.array(inst).alias("instances"))
    pairs, problems = supervision.training_pairs(prompts, comp)
    assert [r.how for r in pairs.collect()] == ["exact"] and problems.count() == 0


def test_hard_selection(spark):
    """Of forty images with two below the threshold, two are annotated and thirty-eight keep their boxes."""
    scores = [0.1, 0.4] + [0.8] * 38
    rows = [("d", f"s{i:02d}", x, x, 0) for i, x in enumerate(scores)]
    df = spark.createDataFrame(rows, "dataset string, slice_name string, image_min_iou double, image_macro_iou double, empty_instance_count int")
    hard = scoring.hard_ranking(df, ["dataset"], "slice_name", 0.5, 1)
    assert [r.slice_name for r in hard.collect()] == ["s00"]
    known = spark.createDataFrame([("s07",)], "slice_name string")  # annotated in the round before
    full = known.unionByName(hard.select("slice_name"))
    left = df.select("slice_name").join(full, "slice_name", "left_anti")
    assert (full.count(), left.count()) == (2, 38)
    assert catalog.partition_errors(df, full, left, "slice_name").count() == 0


def test_three_state_mask(spark):
    """255 in the box, the class where it is confirmed, nothing outside."""
    conf = spark.createDataFrame([("s", y, x, 1) for y in range(5, 8) for x in range(6, 10)] + [("s", 0, 0, 1)], "slice string, y int, x int, value int")
    b = spark.createDataFrame([("s", 1, [4.0, 3.0, 11.0, 9.0])], "slice string, label int, box array<double>")
    out = resolve.rebuild(conf, raster.pixel_box_cover(b, "slice", "box", "label", 16, 16)).collect()
    assert len(out) == 8 * 7 and all(4 <= r.x <= 11 and 3 <= r.y <= 9 for r in out)
    assert sum(r.value == 1 for r in out) == 12 and {r.value for r in out} == {1, 255}
