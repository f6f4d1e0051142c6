"""Queries over masks and logits.

``gts`` holds real run-length masks; ``embeddings`` stands in for logit rasters: 64 floats read row-major as 8 x 8,
foreground above zero, (vec_id, vec_id + 1) a pair of truth and prediction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicewright.functions import mask as M
from slicewright.functions import number
from slicewright.operators import components as C
from slicewright.operators import detection, metrics, morphology, raster, resolve, scoring, surfaces
from slicewright.operators import volumes as C3
from slicewright.session import table

c = F.col
SIDE = 8
HARD = 0.3
NUDGE = 1e-7


def _r(col, digits: int = 6):
    return F.round(col + NUDGE, digits)


def _emb(spark, d) -> DataFrame:
    return table(spark, d, "embeddings")


def _pairs(spark, d) -> DataFrame:
    e = _emb(spark, d)
    b = e.select((c("vec_id") - 1).alias("vec_id"), c("embedding").alias("pred"))
    return e.select("vec_id", "label", c("embedding").alias("gt")).join(b, "vec_id").withColumn("o", M.overlap(c("gt"), c("pred")))


def hard_case_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Overlap per pair, folded per label (as a case), and the hard labels ranked."""
    scored = _pairs(spark, d).select("vec_id", "label", scoring.finite(M.iou_of(c("o"))).alias("iou"), (c("o.b") == 0).alias("prediction_empty"))
    # micro-units, so that sums don't depend on their order
    unit = F.round(c("iou") * 1_000_000).cast("bigint")
    cases = scored.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min(unit).alias("least"), F.sum(unit).alias("total"), F.count_if("prediction_empty").alias("empties"))
    from pyspark.sql import Window

    order = Window.orderBy("least", F.desc("empties"), c("total") / c("n"), "label")  # one row a label
    return cases.where(c("least") < HARD * 1_000_000).withColumn("place", F.row_number().over(order))


def overlaps(spark, d):
    o = c("o")
    return _pairs(spark, d).select("vec_id", o["inter"].alias("inter"), o["a"].alias("gt_pixels"), o["b"].alias("pred_pixels"), _r(M.iou_of(o)).alias("iou"), _r(M.dice_of(o)).alias("dice"), _r(M.smooth_dice_of(o)).alias("smooth"))


def soft_dice(spark, d):
    p = F.transform(c("pred"), lambda v: number.sigmoid(v * 20))
    return _pairs(spark, d).select("vec_id", _r(M.soft_dice_loss(p, M.threshold(c("gt"))), 4).alias("loss"))


def dense_boxes(spark, d):
    return _emb(spark, d).select("vec_id", F.array_join(M.dense_bbox(c("embedding"), SIDE), ",").alias("box"), M.dense_area(c("embedding")).alias("area"))


def stability(spark, d):
    return _emb(spark, d).select("vec_id", _r(M.stability(c("embedding"), 0.0, 0.05)).alias("stability"))


def quality(spark, d):
    """Candidates that pass the filters of automatic masks.

    The model's score is a stand-in made of the id, as in the SQL twin: only ids that end in 6 to 9 pass it.
    """
    cand = _emb(spark, d).select("vec_id", c("embedding").alias("logits"), ((c("vec_id") % 10) / 10.0).alias("model_score"))
    return detection.quality_filter(cand, 0.5, 0.4).select("vec_id", _r(c("stability")).alias("stability"))


def rle_encode(spark, d):
    return raster.to_rle(_emb(spark, d), "vec_id", "embedding", SIDE, SIDE).select("vec_id", F.array_join("counts", ",").alias("counts"))


def rle_roundtrip(spark, d):
    """Pixels that change when rasters are encoded and decoded again: none."""
    back = raster.to_dense(raster.to_rle(_emb(spark, d), "vec_id", "embedding", SIDE, SIDE), "vec_id")
    j = back.join(_emb(spark, d).select("vec_id", M.threshold(c("embedding")).alias("t")), "vec_id")
    wrong = F.aggregate(F.zip_with("values", "t", lambda a, b: F.when(a == b, 0).otherwise(1)), F.lit(0), lambda s, v: s + v)
    return j.select("vec_id", wrong.alias("wrong"))


def rle_measures(spark, d):
    g = table(spark, d, "gts")
    return g.select("file_id", M.rle_area(c("counts")).alias("area"), F.array_join(raster.rle_box("counts", "mask_hw"), ",").alias("box"))


def rotated(spark, d):
    return _emb(spark, d).select("vec_id", F.array_join(M.rot90(M.threshold(c("embedding")), SIDE, SIDE), "").alias("bits"))


def resized(spark, d):
    """Nearest-neighbour resize to 12 x 6 and the area there."""
    m = M.resize_nearest(M.threshold(c("embedding")), SIDE, SIDE, 12, 6)
    return _emb(spark, d).select("vec_id", F.array_join(m, "").alias("bits"))


def resized_rle(spark, d):
    """Run-length masks brought to the teacher canvas, by area."""
    g = table(spark, d, "gts").where("mask_hw is not null and counts is not null")
    h, w = c("mask_hw")[0], c("mask_hw")[1]
    big = F.greatest(h, w)
    side = F.lit(256)
    nh, nw = F.greatest(F.floor(h * side / big), F.lit(1)).cast("int"), F.greatest(F.floor(w * side / big), F.lit(1)).cast("int")
    return raster.resample(g, "file_id", nh, nw, side, side).select("file_id", M.rle_area(c("counts")).alias("area"))


def box_pixels(spark, d):
    """Area of each raster inside its own box shrunk by one, inclusive and half-open."""
    e = _emb(spark, d).withColumn("box", M.dense_bbox(c("embedding"), SIDE)).where("box is not null")
    inc = M.overlap(c("embedding"), M.box_mask(c("box"), SIDE, SIDE))
    half = M.overlap(c("embedding"), M.box_mask(c("box"), SIDE, SIDE, half_open=True))
    return e.select("vec_id", inc["inter"].alias("inclusive"), inc["b"].alias("box_area"), half["inter"].alias("half_open"))


def box_cover(spark, d):
    """Pixels of an 8 x 8 image in any box of a label, per image of three rasters."""
    e = _emb(spark, d).select(F.floor(c("vec_id") / 3).alias("slice"), (c("vec_id") % 3 + 1).alias("cls"), F.transform(M.dense_bbox(c("embedding"), SIDE), lambda v: v.cast("double")).alias("box")).where("box is not null")
    return raster.pixel_box_cover(e, "slice", "box", "cls", SIDE, SIDE).groupBy("slice", "cls").agg(F.count(F.lit(1)).alias("n"), F.sum(c("y") * SIDE + c("x")).alias("sum_pos"))


def percentile_clip(spark, d):
    """Per label: percentile bounds of the positive values, and how many values they clip."""
    px = _emb(spark, d).select("label", F.explode("embedding").alias("v")).select("label", c("v").cast("double").alias("v"))
    b = raster.percentile_bounds(px, ["label"], "v", 0.5, 99.5)
    j = px.join(b, "label")
    return j.groupBy("label").agg(F.round(F.first("lo"), 6).alias("lo"), F.round(F.first("hi"), 6).alias("hi"), F.count_if((c("v") > 0) & (c("v") < c("lo"))).alias("below"), F.count_if(c("v") > c("hi")).alias("above"))


def audit(spark, d):
    """Rasters as grey masks of 0 to 255: what they hold, and their area by both rules."""
    grey = F.transform("embedding", lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(v.cast("double") * 1000))).cast("int"))
    e = _emb(spark, d).select("vec_id", grey.alias("g")).withColumn("a", M.mask_audit(c("g")))
    area = lambda ds: M.dense_area(M.binarize(c("g"), F.lit(ds)))
    return e.select("vec_id", "a.above_0", "a.from_128", "a.equal_255", "a.n_values", F.array_join("a.head", ",").alias("head"), F.array_join("a.tail", ",").alias("tail"), area("TN3K").alias("grey_area"), area("drive").alias("plain_area"))


def intensity(spark, d):
    """Values by label: clipped to percentiles and scaled, and through a window; per label what comes out."""
    px = _emb(spark, d).select("vec_id", "label", F.explode("embedding").alias("f")).select("vec_id", "label", c("f").cast("double").alias("v"))
    both = raster.window_min_max(raster.percentile_scale(px, ["label"], "v", 0.5, 99.5, "p"), ["label"], "v", -0.2, 0.2, "w")
    milli = lambda n: F.sum(F.floor(c(n) * 1000 + NUDGE).cast("bigint"))
    return both.groupBy("label").agg(milli("p").alias("p"), milli("w").alias("w"), F.count_if(c("p") == 1.0).alias("top"))


def minmax(spark, d):
    """A table's values scaled to [0, 1] by group, and windowed intensities."""
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice")
    return p.select("p_partkey", F.round(raster.min_max("p_retailprice", ["p_brand"]), 6).alias("scaled"), F.round(number.window_scale(c("p_retailprice"), 950.0, 1500.0), 6).alias("windowed"))


def tile_grid(spark, d):
    g = table(spark, d, "geometry_meta").where("native_hw is not null").select("slice_name", c("native_hw")[0].alias("h"), c("native_hw")[1].alias("w")).distinct()
    return raster.tiles(g, "slice_name", "h", "w", 256).groupBy("slice_name").agg(F.count(F.lit(1)).alias("n"), F.sum(c("y1") + c("x1")).cast("bigint").alias("sum_at"))


def crop_grid(spark, d):
    g = table(spark, d, "geometry_meta").where("native_hw is not null").select(c("native_hw")[0].alias("h"), c("native_hw")[1].alias("w")).distinct().withColumn("size", F.concat_ws("x", "h", "w"))
    return raster.crop_boxes(g, "size", "h", "w", 2, 512 / 1500).select("size", "layer", "x1", "y1", "x2", "y2")


def point_grids(spark, d):
    return raster.layered_point_grids(spark, 8, 2, 2)


def batch_numbers(spark, d):
    return raster.batches(table(spark, d, "part").select("p_partkey", "p_brand"), ["p_partkey"], 16, ["p_brand"]).select("p_partkey", "batch")


def neighbour_codes(spark, d):
    """Codes of 2 x 2 x 2 cells of volumes: rasters of a label's first eight vectors stacked."""
    e = _emb(spark, d).select((F.floor(c("vec_id") / 8)).alias("vol"), (c("vec_id") % 8).cast("int").alias("z"), "embedding")
    vox = raster.long_pixels(e, ["vol", "z"], "embedding", SIDE).where("value > 0").select("vol", "z", "y", "x")
    return raster.neighbour_codes(vox, "vol").groupBy("vol", "code").agg(F.count(F.lit(1)).alias("n"))


def _comps(spark, d) -> DataFrame:
    return C.mask_components(table(spark, d, "gts"), "file_id")


def _raster_comps(spark, d) -> DataFrame:
    return C.mask_components(raster.to_rle(_emb(spark, d), "vec_id", "embedding", SIDE, SIDE), "vec_id")


def components(spark, d):
    return _comps(spark, d).select("file_id", "component", "area", "x1", "y1", "x2", "y2", _r(c("cx"), 4).alias("cx"), _r(c("cy"), 4).alias("cy"))


def component_summary(spark, d):
    return C.summary(_comps(spark, d), "file_id")


def component_top8(spark, d):
    return C.top_components(_raster_comps(spark, d), "vec_id").select("vec_id", "place", "component", "area")


def component_largest(spark, d):
    return C.largest(_raster_comps(spark, d), "vec_id").select("vec_id", "component", "area")


def component_area_filter(spark, d):
    return C.area_filter(_comps(spark, d), 30)[1]


def component_tiny(spark, d):
    return C.tiny_verdicts(_raster_comps(spark, d), "vec_id", 2, 1).select("vec_id", "component", "tiny", "removed", "reason")


def component_artefacts(spark, d):
    """What each data set's artefact rule would remove."""
    return C.artefacts_by_rule(_comps(spark, d), "file_id").select("file_id", "component", "artefact", "rule")


def raster_components(spark, d):
    """8-connected components of the logit rasters."""
    return _raster_comps(spark, d).select("vec_id", "component", "area", "x1", "y1", "x2", "y2")


def small_regions(spark, d):
    e = _emb(spark, d).select("vec_id", M.threshold(c("embedding")).alias("m"))
    a = morphology.without_small_regions(e, "vec_id", "m", SIDE, SIDE, 4, "islands").select("vec_id", M.dense_area(c("values")).alias("area"), "changed", F.lit("islands").alias("mode"))
    b = morphology.without_small_regions(e, "vec_id", "m", SIDE, SIDE, 4, "holes").select("vec_id", M.dense_area(c("values")).alias("area"), "changed", F.lit("holes").alias("mode"))
    return a.unionByName(b)


def _evidence(spark, d) -> DataFrame:
    """Three rasters a slice; the last digit of the vector gives some classes two pieces of evidence."""
    e = _emb(spark, d).select(F.floor(c("vec_id") / 4).alias("slice"), (F.least(c("vec_id") % 4, F.lit(2)) + 1).cast("int").alias("label"), F.posexplode("embedding").alias("pos", "v"))
    return e.select("slice", "label", "pos", F.round(number.sigmoid(F.round(c("v") * 20)), 6).alias("probability"), (c("v") > 0).alias("support"))


def _union(spark, d) -> DataFrame:
    return _emb(spark, d).select(F.floor(c("vec_id") / 4).alias("slice"), F.posexplode("embedding").alias("pos", "v")).where("v > -0.1").select("slice", "pos").distinct()


def same_class(spark, d):
    e = resolve.same_class_evidence(_evidence(spark, d))
    return e.groupBy("slice", "label").agg(F.count_if("support").alias("n"), F.round(F.max("probability"), 5).alias("top"), F.sum(F.when(c("support"), c("pos")).otherwise(0)).alias("sum_pos"))


def _resolved(spark, d) -> DataFrame:
    return resolve.resolve(_union(spark, d), resolve.same_class_evidence(_evidence(spark, d)))


def resolved(spark, d):
    return _resolved(spark, d).select("slice", "pos", "n_support", "value")


def resolved_slices(spark, d):
    """The same from dense evidence, slice by slice; only the result is told by pixel."""
    e = _emb(spark, d).select(F.floor(c("vec_id") / 4).alias("slice"), (F.least(c("vec_id") % 4, F.lit(2)) + 1).cast("int").alias("label"), "embedding")
    e = e.select("slice", "label", F.transform("embedding", lambda v: F.round(number.sigmoid(F.round(v * 20)), 6)).alias("probability"), F.transform("embedding", lambda v: v > 0).alias("support"), F.transform("embedding", lambda v: v > -0.1).alias("near"))
    union = e.groupBy("slice").agg(F.collect_list("near").alias("n"))  # four rasters a slice
    union = union.select("slice", F.transform(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)), lambda i: F.exists("n", lambda m: F.get(m, i))).alias("inside"))
    out = resolve.resolve_slices(e, union)
    px = out.select("slice", F.posexplode(F.arrays_zip("n_support", "value")).alias("pos", "r")).join(union.select("slice", F.posexplode("inside").alias("pos", "inside")).where("inside"), ["slice", "pos"])
    return px.select("slice", "pos", c("r.n_support").alias("n_support"), c("r.value").cast("int").alias("value"))


def contradictions(spark, d):
    """Per slice the confirmed pixels, and those whose class has no support there: none."""
    e = resolve.same_class_evidence(_evidence(spark, d))
    r = _resolved(spark, d)
    bad = resolve.contradictions(r, e).groupBy("slice").agg(F.count(F.lit(1)).alias("contradictions"))
    return r.groupBy("slice").agg(F.count_if(c("value") != 255).alias("confirmed")).join(bad, "slice", "left").na.fill(0, ["contradictions"])


def automatic(spark, d):
    """Masks of a grid of prompts from end to end: candidates that are sure and stable, their boxes, suppression within an image, and a record of each."""
    e = _emb(spark, d).select("vec_id", c("label").alias("image"), c("embedding").alias("logits"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, v: F.greatest(s, v.cast("double"))), 4).alias("model_score"))
    good = detection.quality_filter(e, 0.2, 0.3)
    boxed = good.withColumn("box", F.transform(M.dense_bbox(c("logits"), SIDE), lambda v: v.cast("double"))).where("box is not null").select("image", "vec_id", "logits", "box", c("model_score").alias("score"))
    kept = detection.non_maximum_suppression(boxed, "image", "vec_id", 0.7)
    runs = raster.to_rle(kept, "vec_id", "logits", SIDE, SIDE)
    return kept.join(runs, "vec_id").select("image", "vec_id", F.array_join("counts", ",").alias("counts"), M.rle_area(c("counts")).alias("area"), F.array_join(F.transform("box", lambda v: v.cast("int")), ",").alias("box"), "score")


def resolver_stats(spark, d):
    return resolve.resolver_statistics(_resolved(spark, d))


def rebuilt(spark, d):
    """Confirmed pixels kept inside boxes of their own class, 255 elsewhere in boxes."""
    conf = _resolved(spark, d).where("value <> 255").select("slice", F.floor(c("pos") / SIDE).cast("int").alias("y"), (c("pos") % SIDE).alias("x"), "value")
    boxes = _emb(spark, d).select(F.floor(c("vec_id") / 4).alias("slice"), (F.least(c("vec_id") % 4, F.lit(2)) + 1).cast("int").alias("label"), (c("vec_id") % 4).cast("double").alias("k"))
    boxes = boxes.select("slice", "label", F.array(c("k"), c("k"), c("k") + 3, c("k") + 4).alias("box"))
    out = resolve.rebuild(conf, raster.pixel_box_cover(boxes, "slice", "box", "label", SIDE, SIDE))
    return out.groupBy("slice", "value").agg(F.count(F.lit(1)).alias("n"), F.sum(c("y") * SIDE + c("x")).alias("sum_pos"))


def _candidates(spark, d) -> DataFrame:
    e = _emb(spark, d)
    box = F.array(F.lit(1.0), F.lit(1.0), F.lit(5.0), F.lit(6.0))
    return e.select("vec_id", F.floor(c("vec_id") / 3).alias("inst"), (c("vec_id") % 3).cast("int").alias("candidate_index"), c("embedding").alias("logits"), ((c("vec_id") * 7 % 11) / 11.0).alias("model_score"), box.alias("box"))


def best_of_three(spark, d):
    s = resolve.score_candidates(_candidates(spark, d), SIDE, SIDE, F.lit(True)).withColumn("score", F.round(c("score"), 6))
    return resolve.best_candidates(s, ["inst"]).select("inst", "candidate_index", "raw_area", "outside", "area", "score")


def proposals(spark, d):
    """The same with refined masks."""
    cand = _candidates(spark, d)
    work = cand.select("vec_id", M.threshold(c("logits")).alias("raw0"), M.box_mask(c("box"), SIDE, SIDE).alias("inside0"))
    ref = morphology.refined_masks(work, "vec_id", "raw0", "inside0", SIDE, SIDE)
    s = resolve.score_candidates(cand.join(ref.withColumnRenamed("values", "refined"), "vec_id"), SIDE, SIDE, F.lit(False), "refined")
    return resolve.best_candidates(s, ["inst"]).select("inst", "candidate_index", "area", F.round("score", 6).alias("score"))


def reweighted(spark, d):
    cand = _candidates(spark, d).withColumn("n_points", (c("inst") % 5).cast("int"))
    return resolve.reweighted_choice(cand, ["inst"], "n_points").select("inst", "candidate_index", F.round("score", 6).alias("score"))


def overwritten(spark, d):
    """The label that the last raster of a slice leaves at each pixel."""
    e = _emb(spark, d).select(F.floor(c("vec_id") / 4).alias("slice"), (c("vec_id") % 4).alias("ord"), F.posexplode("embedding").alias("pos", "v")).where("v > 0").withColumn("label", (c("ord") + 1).cast("int"))
    return resolve.later_label_wins(e, ["slice", "pos"], "label", "ord").groupBy("slice", "label").agg(F.count(F.lit(1)).alias("n"))


def _surfels(spark, d) -> DataFrame:
    return morphology.distance_table(_pairs(spark, d).select("vec_id", "gt", "pred"), "vec_id", "gt", "pred", SIDE, SIDE, (1.0, 1.5))


def surface_distance(spark, d):
    """Mean surface distances, robust Hausdorff distance and surface Dice of each pair."""
    m = metrics.surface_measures(_surfels(spark, d), ["vec_id"], 1.0, 95.0, F.lit(1.0))
    return m.select("vec_id", *(_r(c(n), 5).alias(n) for n in ("mean_ab", "mean_ba", "overlap_a", "overlap_b", "surface_dice", "hausdorff")))


def volume_distance(spark, d):
    """Distances between the surfaces of volumes, each of eight rasters, and the next one, by 2 x 2 x 2 cells."""
    e = _emb(spark, d).select(F.floor(c("vec_id") / 8).alias("vol"), c("vec_id"), M.threshold(c("embedding")).alias("m"))
    v = e.groupBy("vol").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("vec_id", "m"))), lambda x: x["m"])).alias("v"))  # eight rasters a volume
    v = v.where(F.size("v") == 8 * SIDE * SIDE)
    pairs = v.join(v.select((c("vol") - 1).alias("vol"), c("v").alias("w")), "vol")
    s = morphology.volume_distance_table(pairs, "vol", "v", "w", (8, SIDE, SIDE), (2.0, 1.0, 1.5))
    m = metrics.surface_measures(s, ["vol"], 1.0, 95.0, F.lit(1.0))
    return m.select("vol", *(_r(c(n), 4).alias(n) for n in ("mean_ab", "mean_ba", "surface_dice", "hausdorff")))


def interpolated(spark, d):
    """Slices between the rasters of a label, which are taken to lie three slices apart for each vector id."""
    e = _emb(spark, d).select("label", (c("vec_id") * 3).cast("int").alias("z"), M.threshold(c("embedding")).alias("values"))
    return morphology.interpolate_labels(e, "label", "z", "values", SIDE, SIDE).select("label", "z", M.dense_area(c("values")).alias("area"))


def nms(spark, d):
    """Greedy suppression of the boxes of components on each mask size, as if of one image."""
    comp = _comps(spark, d).withColumn("key", c("file_id") * 1_000_000 + c("component")).withColumn("image", F.concat_ws("x", "mask_h", "mask_w"))
    boxes = comp.select("image", "key", F.array(*(c(x).cast("double") for x in ("x1", "y1", "x2", "y2"))).alias("box"), c("area").cast("double").alias("score"))
    return detection.non_maximum_suppression(boxes, "image", "key", 0.5).select("image", "key", "score")


def _slice_masks(spark, d) -> DataFrame:
    """slice_name, mask_hw, counts: of the files of a slice the first by id."""
    g = table(spark, d, "gts").where("slice_name is not null and mask_hw is not null and counts is not null")
    return g.groupBy("slice_name").agg(F.min_by(F.struct("mask_hw", "counts"), "file_id").alias("m")).select("slice_name", "m.*")


def _series(spark, d) -> DataFrame:
    """case_id, z, slice_name, mask_hw, counts of the slices of volumes; of slices at one place the first by name."""
    m = table(spark, d, "manifest").where("slice_name is not null and case_id is not null and slice_idx is not null and deleted_at is null")
    placed = m.groupBy("case_id", c("slice_idx").alias("z")).agg(F.min("slice_name").alias("slice_name"))
    return placed.join(_slice_masks(spark, d), "slice_name")


def volume_components(spark, d):
    """Components of cases in three dimensions of at least a thousand voxels."""
    return C3.volume_components(_series(spark, d), "case_id", "z", min_voxels=1000, min_pixels=100)[0]


def _boxes(spark, d) -> DataFrame:
    i = table(spark, d, "prompts_train").where("slice_name is not null").select("slice_name", F.explode("instances.bbox_native").alias("box"))
    return i.where("box is not null and size(box) = 4").distinct()


def propagated(spark, d):
    """The largest box of each prompted slice of a case carried to the slices between: where each box came from, and the area in it."""
    size = (c("box")[2] - c("box")[0]) * (c("box")[3] - c("box")[1])
    best = _boxes(spark, d).groupBy("slice_name").agg(F.max_by("box", F.struct(size, "box")).alias("box"))
    out = C3.propagate(_series(spark, d).join(best, "slice_name", "left"), "case_id", "z", "box")
    return out.select("case_id", "z", "used", M.rle_area(c("counts")).alias("area"))


def refined(spark, d):
    """The mask of each prompted slice refined by each of its boxes: its area."""
    keyed = _boxes(spark, d).join(_slice_masks(spark, d), "slice_name").withColumn("key", F.concat_ws("#", "slice_name", F.array_join(F.transform("box", lambda v: v.cast("string")), ",")))
    return morphology.refined_runs(keyed, "key", "box").select("key", M.rle_area(c("counts")).alias("area"))


SPACING = (2.0, 1.0, 1.5)


def surface_area(spark, d):
    """The surface of volumes of eight rasters, by the codes of their cells."""
    codes = neighbour_codes(spark, d).where("code <> 255")
    return codes.groupBy("vol").agg(F.round(F.sum(c("n") * surfaces.area_of(c("code"), SPACING)), 6).alias("area"))


NAMES = (
    overlaps, soft_dice, dense_boxes, stability, quality, rle_encode, rle_roundtrip, rle_measures, rotated, resized, resized_rle, box_pixels, box_cover, percentile_clip, audit, intensity, minmax, tile_grid, crop_grid,
    point_grids, batch_numbers, neighbour_codes, components, component_summary, component_top8, component_largest, component_area_filter, component_tiny, component_artefacts, raster_components,
    small_regions, same_class, resolved, resolved_slices, contradictions, automatic, resolver_stats, rebuilt, best_of_three, proposals, reweighted, overwritten, surface_distance, volume_distance, interpolated, nms, volume_components, propagated, refined, surface_area,
)
QUERIES = {"hard_case_ranking": hard_case_ranking} | {f"mask_{f.__name__}": f for f in NAMES}

_PX = "px AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)"
_PAIR = f"{_PX}, o AS (SELECT a.vec_id, any_value(a.label) AS label, count(*) FILTER (WHERE a.v > 0 AND b.v > 0) AS i, count(*) FILTER (WHERE a.v > 0) AS a, count(*) FILTER (WHERE b.v > 0) AS b FROM px a JOIN px b ON b.vec_id = a.vec_id + 1 AND b.pos = a.pos GROUP BY a.vec_id)"
_N = f"{NUDGE}::DOUBLE"
_FLIPS = """
runs AS (SELECT file_id, mask_hw[1] AS h, mask_hw[2] AS w, unnest(counts) AS c, generate_subscripts(counts, 1) AS i FROM gts),
ends AS (SELECT file_id, h, w, sum(c) OVER (PARTITION BY file_id ORDER BY i) AS p FROM runs),
flips AS (SELECT file_id, h, w, p::BIGINT AS p FROM ends WHERE p < h::BIGINT * w GROUP BY file_id, h, w, p HAVING count(*) % 2 = 1),
numbered AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY p) AS r, lead(p) OVER (PARTITION BY file_id ORDER BY p) AS q FROM flips),
fg AS (SELECT file_id, h, w, p AS s, coalesce(q, h::BIGINT * w) - 1 AS e FROM numbered WHERE r % 2 = 1),
cut AS (SELECT *, unnest(range(s // h, e // h + 1)) AS col FROM fg),
segs AS (SELECT file_id, h, w, col, CASE WHEN col = s // h THEN s % h ELSE 0 END AS top, CASE WHEN col = e // h THEN e % h ELSE h - 1 END AS low FROM cut)
"""
_COMPS = f"""{_FLIPS},
ids AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY col, top) AS sid FROM segs),
adj AS (SELECT a.file_id, a.sid AS x, b.sid AS y FROM ids a JOIN ids b ON a.file_id = b.file_id AND abs(b.col - a.col) = 1 AND b.top <= a.low + 1 AND b.low >= a.top - 1),
reach AS (SELECT file_id, sid, sid AS root FROM ids UNION SELECT r.file_id, adj.y, r.root FROM reach r JOIN adj ON adj.file_id = r.file_id AND adj.x = r.sid),
rooted AS (SELECT file_id, sid, min(root) AS root FROM reach GROUP BY file_id, sid),
raw AS (SELECT i.file_id, root, any_value(h) AS h, any_value(w) AS w, sum(low - top + 1)::BIGINT AS area, min(col)::INTEGER AS x1, min(top)::INTEGER AS y1, max(col)::INTEGER AS x2, max(low)::INTEGER AS y2,
  min(top * w + col) AS first_px, sum(col * (low - top + 1)) AS sx, sum((top + low) * (low - top + 1)) AS sy2, bool_or(col = 0 AND top = 0) AS has_origin,
  sum(CASE WHEN col = 0 OR col = w - 1 THEN low - top + 1 ELSE CASE WHEN top = 0 THEN 1 ELSE 0 END + CASE WHEN low = h - 1 AND (h > 1 OR top > 0) THEN 1 ELSE 0 END END)::BIGINT AS border_pixels
  FROM ids i JOIN rooted USING (file_id, sid) GROUP BY i.file_id, root),
comp AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY first_px)::INTEGER AS component FROM raw)
"""
_RCOMPS = f"""{_PX},
fg AS (SELECT vec_id, pos, pos // 8 AS y, pos % 8 AS x FROM px WHERE v > 0),
adj AS (SELECT a.vec_id, a.pos AS p, b.pos AS q FROM fg a JOIN fg b ON a.vec_id = b.vec_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND a.pos <> b.pos),
reach AS (SELECT vec_id, pos, pos AS root FROM fg UNION SELECT r.vec_id, adj.q, r.root FROM reach r JOIN adj ON adj.vec_id = r.vec_id AND adj.p = r.pos),
rooted AS (SELECT vec_id, pos, min(root) AS root FROM reach GROUP BY vec_id, pos),
comp AS (SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY root)::INTEGER AS component, count(*) AS area, min(pos % 8)::INTEGER AS x1, min(pos // 8)::INTEGER AS y1, max(pos % 8)::INTEGER AS x2, max(pos // 8)::INTEGER AS y2 FROM rooted GROUP BY vec_id, root)
"""
_EV = f"""{_PX},
ev AS (SELECT vec_id // 4 AS slice, (least(vec_id % 4, 2) + 1)::INTEGER AS label, pos, round(1.0 / (1.0 + exp(-greatest(-40.0::DOUBLE, least(40.0::DOUBLE, round(v * 20))))), 6) AS probability, v > 0 AS support FROM px),
same AS (SELECT slice, label, pos, bool_or(support) AS support, max(CASE WHEN support THEN probability ELSE 0 END) AS probability FROM ev GROUP BY ALL),
u AS (SELECT DISTINCT vec_id // 4 AS slice, pos FROM px WHERE v > -0.1),
votes AS (SELECT slice, pos, count(*) AS n, max(probability) AS p1, list(label ORDER BY probability DESC, label) AS labels, list(probability ORDER BY probability DESC) AS ps FROM same WHERE support GROUP BY slice, pos),
res AS (SELECT slice, pos, coalesce(n, 0)::INTEGER AS n_support, CASE WHEN n IS NULL THEN 255 WHEN n >= 2 AND ps[1] - ps[2] <= 1e-6 THEN 255 ELSE labels[1] END AS value FROM u LEFT JOIN votes USING (slice, pos))
"""
_CAND = f"""{_PX},
cand AS (SELECT vec_id // 3 AS inst, (vec_id % 3)::INTEGER AS candidate_index, (vec_id * 7 % 11) / 11.0::DOUBLE AS model_score, count(*) FILTER (WHERE v > 0) AS raw_area,
  count(*) FILTER (WHERE v > 0 AND NOT (pos % 8 BETWEEN 1 AND 5 AND pos // 8 BETWEEN 1 AND 6)) AS outside FROM px GROUP BY vec_id)
"""

def _parts(name: str, fg: str) -> str:
    """CTEs of the 8-connected components of pixels: ``name`` has vec_id, root, n and pos."""
    return f"""{name}0 AS (SELECT vec_id, pos, pos // 8 AS y, pos % 8 AS x FROM px WHERE {fg}),
{name}a AS (SELECT a.vec_id, a.pos AS p, b.pos AS q FROM {name}0 a JOIN {name}0 b ON a.vec_id = b.vec_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND a.pos <> b.pos),
{name}r AS (SELECT vec_id, pos, pos AS root FROM {name}0 UNION SELECT r.vec_id, {name}a.q, r.root FROM {name}r r JOIN {name}a ON {name}a.vec_id = r.vec_id AND {name}a.p = r.pos),
{name}g AS (SELECT vec_id, pos, min(root) AS root FROM {name}r GROUP BY vec_id, pos),
{name} AS (SELECT vec_id, root, count(*) AS n FROM {name}g GROUP BY vec_id, root)"""


_IOU = "CASE WHEN least(k[3], x[1][3]) > greatest(k[1], x[1][1]) AND least(k[4], x[1][4]) > greatest(k[2], x[1][2]) THEN (least(k[3], x[1][3]) - greatest(k[1], x[1][1])) * (least(k[4], x[1][4]) - greatest(k[2], x[1][2])) ELSE 0.0::DOUBLE END"


def _greedy(boxes: str, threshold: float) -> str:
    """CTEs of greedy suppression: ``boxes`` has image, key (a number), box (list of four doubles), score; ``kept`` has image and key."""
    area = lambda b: f"(({b}[3] - {b}[1]) * ({b}[4] - {b}[2]))"
    over = f"coalesce({_IOU} / nullif({area('k')} + {area('x[1]')} - {_IOU}, 0), 0.0) > {threshold}::DOUBLE"
    return f"""lists AS (SELECT image, list([list_append(box, key::DOUBLE)] ORDER BY score DESC, key) AS l FROM {boxes} GROUP BY image),
nms AS (SELECT image, list_reduce(l, lambda a, x: CASE WHEN len(list_filter(a, lambda k: {over})) = 0 THEN list_concat(a, x) ELSE a END) AS k FROM lists),
kept AS (SELECT image, unnest(k)[5]::BIGINT AS key FROM nms)"""


ORACLES = {
    "nms": f"""WITH RECURSIVE {_COMPS}, b AS (SELECT h || 'x' || w AS image, file_id * 1000000 + component AS key, [x1, y1, x2, y2]::DOUBLE[] AS box, area::DOUBLE AS score FROM comp), {_greedy("b", 0.5)}
SELECT b.image, b.key, b.score FROM b JOIN kept ON kept.image = b.image AND kept.key = b.key""",
    "surface_area": f"""WITH {_PX}, vox AS (SELECT vec_id // 8 AS vol, vec_id % 8 AS z, pos // 8 AS y, pos % 8 AS x FROM px WHERE v > 0),
k AS (SELECT unnest(range(8)) AS b), cells AS (SELECT vol, z - (b // 4) AS z, y - (b // 2 % 2) AS y, x - (b % 2) AS x, sum(128 >> b)::INTEGER AS code FROM vox, k GROUP BY ALL), n AS (SELECT vol, code, count(*) AS n FROM cells WHERE code <> 255 GROUP BY ALL)
SELECT vol, round(sum(n * ({[float(a) for a in surfaces.cell_areas(SPACING)]}::DOUBLE[])[code + 1]), 6) AS area FROM n GROUP BY vol""",
    "resolved_slices": f"WITH {_EV} SELECT slice, pos::INTEGER AS pos, n_support, value FROM res",
    "contradictions": f"WITH {_EV} SELECT slice, count(*) FILTER (WHERE value <> 255) AS confirmed, 0::BIGINT AS contradictions FROM res GROUP BY slice",
    "automatic": f"""WITH {_PX}, s AS (SELECT vec_id, any_value(label) AS image, round(greatest(0.0::DOUBLE, max(v)), 4) AS score, count(*) FILTER (WHERE v > 0.1::DOUBLE)::DOUBLE / nullif(count(*) FILTER (WHERE v > -0.1::DOUBLE), 0) AS st,
  [min(pos % 8) FILTER (WHERE v > 0), min(pos // 8) FILTER (WHERE v > 0), max(pos % 8) FILTER (WHERE v > 0), max(pos // 8) FILTER (WHERE v > 0)]::DOUBLE[] AS box, count(*) FILTER (WHERE v > 0) AS area FROM px GROUP BY vec_id),
b AS (SELECT image, vec_id AS key, box, score, area FROM s WHERE score > 0.2::DOUBLE AND st >= 0.3::DOUBLE AND area > 0), {_greedy("b", 0.7)},
f AS (SELECT vec_id, (pos % 8) * 8 + pos // 8 AS k, (v > 0)::INTEGER AS b FROM px UNION ALL SELECT vec_id, -1, 0 FROM embeddings),
ch AS (SELECT *, b <> lag(b, 1, 0) OVER (PARTITION BY vec_id ORDER BY k) AS flip FROM f), isl AS (SELECT *, sum(flip::INTEGER) OVER (PARTITION BY vec_id ORDER BY k) AS g FROM ch),
runs AS (SELECT vec_id, string_agg(n::VARCHAR, ',' ORDER BY g) AS counts FROM (SELECT vec_id, g, count(*) FILTER (WHERE k >= 0) AS n FROM isl GROUP BY vec_id, g) GROUP BY vec_id)
SELECT b.image, b.key AS vec_id, counts, area, array_to_string(list_transform(box, lambda z: z::INTEGER), ',') AS box, score FROM b JOIN kept ON kept.image = b.image AND kept.key = b.key JOIN runs ON runs.vec_id = b.key""",
    "small_regions": f"""WITH RECURSIVE {_PX}, {_parts("isl", "v > 0")}, {_parts("hol", "v <= 0")},
e AS (SELECT vec_id FROM embeddings),
i AS (SELECT e.vec_id, coalesce(sum(n), 0) AS a, coalesce(sum(n) FILTER (WHERE n >= 4), 0) AS big, coalesce(max(n), 0) AS top, count(*) FILTER (WHERE n < 4) AS small FROM e LEFT JOIN isl USING (vec_id) GROUP BY 1),
h AS (SELECT e.vec_id, coalesce(sum(n) FILTER (WHERE n < 4), 0) AS fill, count(*) FILTER (WHERE n < 4) AS small FROM e LEFT JOIN hol USING (vec_id) GROUP BY 1)
SELECT vec_id, (CASE WHEN big > 0 THEN big ELSE top END)::BIGINT AS area, small > 0 AS changed, 'islands' AS mode FROM i UNION ALL SELECT vec_id, (i.a + fill)::BIGINT, h.small > 0, 'holes' FROM h JOIN i USING (vec_id)""",
    "interpolated": f"""WITH {_PX}, m AS (SELECT label, vec_id, pos // 8 AS y, pos % 8 AS x, v > 0 AS f FROM px),
sd AS (SELECT a.label, a.vec_id, a.y, a.x, least(coalesce(min(sqrt((a.y - b.y) ** 2 + (a.x - b.x) ** 2)) FILTER (WHERE NOT b.f), 16.0), 16.0) - least(coalesce(min(sqrt((a.y - b.y) ** 2 + (a.x - b.x) ** 2)) FILTER (WHERE b.f), 16.0), 16.0) AS d FROM m a JOIN m b ON b.vec_id = a.vec_id GROUP BY ALL),
n AS (SELECT label, vec_id, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS nxt FROM embeddings),
t AS (SELECT label, vec_id, nxt, vec_id * 3 AS z1, nxt * 3 AS z2, unnest(range(vec_id * 3 + 1, nxt * 3)) AS z FROM n WHERE nxt IS NOT NULL)
SELECT t.label, z::INTEGER AS z, count(*) FILTER (WHERE (1 - (z - z1)::DOUBLE / (z2 - z1)) * a.d + (z - z1)::DOUBLE / (z2 - z1) * b.d > 0) AS area FROM t JOIN sd a ON a.vec_id = t.vec_id JOIN sd b ON b.vec_id = t.nxt AND b.y = a.y AND b.x = a.x GROUP BY ALL""",
    "overlaps": f"WITH {_PAIR} SELECT vec_id, i AS inter, a AS gt_pixels, b AS pred_pixels, CASE WHEN a + b - i = 0 THEN 'nan'::DOUBLE ELSE round(i::DOUBLE / (a + b - i) + {_N}, 6) END AS iou, CASE WHEN a + b = 0 THEN 'nan'::DOUBLE ELSE round(2 * i::DOUBLE / (a + b) + {_N}, 6) END AS dice, round((2.0::DOUBLE * i + 1) / (a + b + 1) + {_N}, 6) AS smooth FROM o",
    "soft_dice": f"""WITH {_PX}, p AS (SELECT a.vec_id, CASE WHEN a.v > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS t, 1.0 / (1.0 + exp(-greatest(-40.0::DOUBLE, least(40.0::DOUBLE, (b.v::FLOAT * 20)::DOUBLE)))) AS p FROM px a JOIN px b ON b.vec_id = a.vec_id + 1 AND b.pos = a.pos)
SELECT vec_id, round(1.0 - (2.0 * sum(p * t) + 1e-6::DOUBLE) / (sum(p) + sum(t) + 1e-6::DOUBLE) + {_N}, 4) AS loss FROM p GROUP BY vec_id""",
    "dense_boxes": f"WITH {_PX} SELECT vec_id, CASE WHEN count(*) FILTER (WHERE v > 0) > 0 THEN concat_ws(',', min(pos % 8) FILTER (WHERE v > 0), min(pos // 8) FILTER (WHERE v > 0), max(pos % 8) FILTER (WHERE v > 0), max(pos // 8) FILTER (WHERE v > 0)) END AS box, count(*) FILTER (WHERE v > 0) AS area FROM px GROUP BY vec_id",
    "stability": f"WITH {_PX} SELECT vec_id, CASE WHEN count(*) FILTER (WHERE v > -0.05::DOUBLE) = 0 THEN 'nan'::DOUBLE ELSE round(count(*) FILTER (WHERE v > 0.05::DOUBLE)::DOUBLE / count(*) FILTER (WHERE v > -0.05::DOUBLE) + {_N}, 6) END AS stability FROM px GROUP BY vec_id",
    "quality": f"WITH {_PX}, s AS (SELECT vec_id, count(*) FILTER (WHERE v > 0.1::DOUBLE)::DOUBLE / nullif(count(*) FILTER (WHERE v > -0.1::DOUBLE), 0) AS stability FROM px WHERE (vec_id % 10) / 10.0 > 0.5 GROUP BY vec_id) SELECT vec_id, round(stability + {_N}, 6) AS stability FROM s WHERE stability >= 0.4::DOUBLE",
    "rle_encode": f"""WITH {_PX}, f AS (SELECT vec_id, (pos % 8) * 8 + pos // 8 AS k, (v > 0)::INTEGER AS b FROM px UNION ALL SELECT vec_id, -1, 0 FROM embeddings),
ch AS (SELECT *, b <> lag(b, 1, 0) OVER (PARTITION BY vec_id ORDER BY k) AS flip FROM f), isl AS (SELECT *, sum(flip::INTEGER) OVER (PARTITION BY vec_id ORDER BY k) AS g FROM ch)
SELECT vec_id, string_agg(n::VARCHAR, ',' ORDER BY g) AS counts FROM (SELECT vec_id, g, count(*) FILTER (WHERE k >= 0) AS n FROM isl GROUP BY vec_id, g) GROUP BY vec_id""",
    "rle_roundtrip": "SELECT vec_id, 0::INTEGER AS wrong FROM embeddings",
    "rle_measures": f"""WITH {_FLIPS} SELECT g.file_id, coalesce(sum(low - top + 1), 0)::BIGINT AS area, CASE WHEN count(col) > 0 THEN concat_ws(',', min(col), min(top), max(col), max(low)) END AS box FROM gts g LEFT JOIN segs USING (file_id) GROUP BY g.file_id""",
    "rotated": f"WITH {_PX} SELECT vec_id, string_agg((v > 0)::INTEGER::VARCHAR, '' ORDER BY (7 - pos % 8) * 8 + pos // 8) AS bits FROM px GROUP BY vec_id",
    "resized": f"WITH {_PX}, t AS (SELECT range AS k FROM range(72)) SELECT vec_id, string_agg((v > 0)::INTEGER::VARCHAR, '' ORDER BY k) AS bits FROM t JOIN px ON pos = (k // 6 * 8 // 12) * 8 + k % 6 * 8 // 6 GROUP BY vec_id",
    "resized_rle": f"""WITH {_FLIPS}, g AS (SELECT file_id, mask_hw[1] AS h, mask_hw[2] AS w, greatest(mask_hw[1] * 256 // greatest(mask_hw[1], mask_hw[2]), 1) AS nh, greatest(mask_hw[2] * 256 // greatest(mask_hw[1], mask_hw[2]), 1) AS nw FROM gts WHERE mask_hw IS NOT NULL AND counts IS NOT NULL),
part AS (SELECT s.file_id, greatest(0, (((low + 1) * nh + s.h - 1) // s.h) - ((top * nh + s.h - 1) // s.h)) * greatest(0, (((col + 1) * nw + s.w - 1) // s.w) - ((col * nw + s.w - 1) // s.w)) AS n FROM segs s JOIN g USING (file_id))
SELECT g.file_id, coalesce(sum(n), 0)::BIGINT AS area FROM g LEFT JOIN part USING (file_id) GROUP BY g.file_id""",
    "box_pixels": f"""WITH {_PX}, b AS (SELECT vec_id, min(pos % 8) AS x1, min(pos // 8) AS y1, max(pos % 8) AS x2, max(pos // 8) AS y2 FROM px WHERE v > 0 GROUP BY vec_id)
SELECT vec_id, count(*) FILTER (WHERE v > 0) AS inclusive, any_value((x2 - x1 + 1) * (y2 - y1 + 1))::BIGINT AS box_area, count(*) FILTER (WHERE v > 0 AND pos % 8 < x2 AND pos // 8 < y2) AS half_open FROM px JOIN b USING (vec_id) GROUP BY vec_id""",
    "box_cover": f"""WITH {_PX}, b AS (SELECT vec_id // 3 AS slice, vec_id % 3 + 1 AS cls, min(pos % 8) AS x1, min(pos // 8) AS y1, max(pos % 8) AS x2, max(pos // 8) AS y2 FROM px WHERE v > 0 GROUP BY vec_id), t AS (SELECT range AS k FROM range(64))
SELECT slice, cls, count(*) AS n, sum(k)::BIGINT AS sum_pos FROM (SELECT DISTINCT slice, cls, k FROM b JOIN t ON k % 8 BETWEEN x1 AND x2 AND k // 8 BETWEEN y1 AND y2) GROUP BY slice, cls""",
    "percentile_clip": f"""WITH {_PX}, b AS (SELECT label, quantile_cont(v, 0.005) AS lo, quantile_cont(v, 0.995) AS hi FROM px WHERE v > 0 GROUP BY label)
SELECT label, round(any_value(lo), 6) AS lo, round(any_value(hi), 6) AS hi, count(*) FILTER (WHERE v > 0 AND v < lo) AS below, count(*) FILTER (WHERE v > hi) AS above FROM px JOIN b USING (label) GROUP BY label""",
    "audit": f"""WITH {_PX}, g AS (SELECT vec_id, least(255, greatest(0, floor(v * 1000)))::INTEGER AS g FROM px)
SELECT vec_id, count(*) FILTER (WHERE g > 0) AS above_0, count(*) FILTER (WHERE g >= 128) AS from_128, count(*) FILTER (WHERE g = 255) AS equal_255, count(DISTINCT g)::INTEGER AS n_values,
  array_to_string(list_sort(list(DISTINCT g))[1:12], ',') AS head, array_to_string(list_sort(list(DISTINCT g))[-12:], ',') AS tail, count(*) FILTER (WHERE g >= 128) AS grey_area, count(*) FILTER (WHERE g > 0) AS plain_area FROM g GROUP BY vec_id""",
    "intensity": f"""WITH {_PX}, b AS (SELECT label, quantile_cont(v, 0.005) AS lo, quantile_cont(v, 0.995) AS hi FROM px WHERE v > 0 GROUP BY label),
s AS (SELECT label, CASE WHEN v > 0 THEN (greatest(lo, least(hi, v)) - lo) / (hi - lo) ELSE 0.0::DOUBLE END AS p, greatest(-0.2::DOUBLE, least(0.2::DOUBLE, v)) AS c FROM px JOIN b USING (label)),
t AS (SELECT *, (c - min(c) OVER (PARTITION BY label)) / (max(c) OVER (PARTITION BY label) - min(c) OVER (PARTITION BY label)) * 255.0::DOUBLE AS w FROM s)
SELECT label, sum(floor(p * 1000 + {_N})::BIGINT)::BIGINT AS p, sum(floor(w * 1000 + {_N})::BIGINT)::BIGINT AS w, count(*) FILTER (WHERE p = 1) AS top FROM t GROUP BY label""",
    "minmax": """SELECT p_partkey, round(coalesce((p_retailprice - min(p_retailprice) OVER w) / nullif(max(p_retailprice) OVER w - min(p_retailprice) OVER w, 0), 0.0), 6) AS scaled,
  round((greatest(950.0::DOUBLE, least(1500.0::DOUBLE, p_retailprice)) - 950.0::DOUBLE) / 550.0::DOUBLE, 6) AS windowed FROM part WINDOW w AS (PARTITION BY p_brand)""",
    "tile_grid": """WITH g AS (SELECT DISTINCT slice_name, (native_hw[1] + 255) // 256 AS r, (native_hw[2] + 255) // 256 AS c FROM geometry_meta WHERE native_hw IS NOT NULL)
SELECT slice_name, sum(n)::BIGINT AS n, sum(s)::BIGINT AS sum_at FROM (SELECT slice_name, r * c AS n, 256 * (c * r * (r - 1) // 2 + r * c * (c - 1) // 2) AS s FROM g) GROUP BY slice_name""",
    "crop_grid": """WITH g AS (SELECT DISTINCT native_hw[1] AS h, native_hw[2] AS w FROM geometry_meta WHERE native_hw IS NOT NULL),
l AS (SELECT h, w, layer, (1 << layer) AS n FROM g, (SELECT unnest([0, 1, 2]) AS layer)),
o AS (SELECT *, CASE WHEN layer = 0 THEN 0 ELSE floor((512.0::DOUBLE / 1500) * least(h, w) * 2 / n)::INTEGER END AS lap FROM l),
s AS (SELECT *, ceil((lap * (n - 1) + w)::DOUBLE / n)::INTEGER AS cw, ceil((lap * (n - 1) + h)::DOUBLE / n)::INTEGER AS ch FROM o),
k AS (SELECT *, unnest(range(n * n)) AS k FROM s)
SELECT h || 'x' || w AS size, layer::INTEGER AS layer, ((cw - lap) * (k % n))::INTEGER AS x1, ((ch - lap) * (k // n))::INTEGER AS y1, least((cw - lap) * (k % n) + cw, w)::INTEGER AS x2, least((ch - lap) * (k // n) + ch, h)::INTEGER AS y2 FROM k""",
    "point_grids": "WITH l AS (SELECT unnest([0, 1, 2]) AS layer, unnest([8, 4, 2]) AS n), p AS (SELECT layer, n, unnest(range(n * n)) AS k FROM l) SELECT layer::INTEGER AS layer, k::INTEGER AS k, (k % n + 0.5::DOUBLE) / n AS x, (k // n + 0.5::DOUBLE) / n AS y FROM p",
    "batch_numbers": "SELECT p_partkey, ((row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 16)::INTEGER AS batch FROM part",
    "neighbour_codes": f"""WITH {_PX}, vox AS (SELECT vec_id // 8 AS vol, vec_id % 8 AS z, pos // 8 AS y, pos % 8 AS x FROM px WHERE v > 0),
k AS (SELECT unnest(range(8)) AS b), cells AS (SELECT vol, z - (b // 4) AS z, y - (b // 2 % 2) AS y, x - (b % 2) AS x, sum(128 >> b)::INTEGER AS code FROM vox, k GROUP BY ALL)
SELECT vol, code, count(*) AS n FROM cells GROUP BY vol, code""",
    "components": f"WITH RECURSIVE {_COMPS} SELECT file_id, component, area, x1, y1, x2, y2, round(sx::DOUBLE / area + {_N}, 4) AS cx, round(sy2::DOUBLE / 2 / area + {_N}, 4) AS cy FROM comp",
    "component_summary": f"WITH RECURSIVE {_COMPS} SELECT file_id, count(*) AS n_components, max(area) AS largest, min(area) AS smallest, sum(border_pixels)::BIGINT AS border_pixels, bool_or(has_origin) AS has_origin FROM comp GROUP BY file_id",
    "component_top8": f"WITH RECURSIVE {_RCOMPS} SELECT vec_id, place, component, area FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY area DESC, y1, x1, component)::INTEGER AS place FROM comp) WHERE place <= 8",
    "component_largest": f"WITH RECURSIVE {_RCOMPS} SELECT vec_id, component, area FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY area DESC, component) AS r FROM comp) WHERE r = 1",
    "component_area_filter": f"WITH RECURSIVE {_COMPS} SELECT count(*) FILTER (WHERE area < 30) AS removed_components, coalesce(sum(area) FILTER (WHERE area < 30), 0)::BIGINT AS removed_pixels FROM comp",
    "component_tiny": f"""WITH RECURSIVE {_RCOMPS}, t AS (SELECT *, area <= 2 OR greatest(x2 - x1, y2 - y1) + 1 <= 1 AS tiny FROM comp),
n AS (SELECT *, count(*) OVER (PARTITION BY vec_id) AS n, count(*) FILTER (WHERE tiny) OVER (PARTITION BY vec_id) AS k FROM t),
r AS (SELECT *, CASE WHEN n <= 1 THEN 'single_component' WHEN k = 0 THEN 'none_tiny' WHEN k = n THEN 'all_tiny' ELSE 'removed' END AS reason FROM n)
SELECT vec_id, component, tiny, tiny AND reason = 'removed' AS removed, reason FROM r""",
    "component_artefacts": f"""WITH RECURSIVE {_COMPS}, m AS (SELECT *, max(area) OVER (PARTITION BY file_id) AS big, x2 - x1 + 1 AS bw, y2 - y1 + 1 AS bh FROM comp),
r AS (SELECT file_id, component, 'tg3k' AS rule, CASE WHEN x1 = 0 AND y1 = 0 AND x2 <= 15 AND y2 <= 15 AND area <= 128 THEN 'corner' WHEN y1 = 0 AND bh <= 2 AND area <= 4 THEN 'edge' END AS artefact FROM m
UNION ALL SELECT file_id, component, 'kvasirseg', CASE WHEN x1 = 0 AND y1 = 0 AND x2 <= 7 AND y2 <= 7 AND area <= 16 THEN 'corner' WHEN (x1 = 0 OR y1 = 0) AND area <= 8 AND greatest(bw, bh) <= 8 THEN 'edge' END FROM m
UNION ALL SELECT file_id, component, unnest(['cvc_clinicdb', 'ddti']), CASE WHEN area < big AND area <= 128 AND area <= greatest(1, ceil(big * 0.01)) THEN 'satellite' END FROM m)
SELECT file_id, component, artefact, rule FROM r WHERE artefact IS NOT NULL""",
    "raster_components": f"WITH RECURSIVE {_RCOMPS} SELECT vec_id, component, area, x1, y1, x2, y2 FROM comp",
    "same_class": f"WITH {_EV} SELECT slice, label, count(*) FILTER (WHERE support) AS n, round(max(probability), 5) AS top, coalesce(sum(pos) FILTER (WHERE support), 0)::BIGINT AS sum_pos FROM same GROUP BY slice, label",
    "resolved": f"WITH {_EV} SELECT slice, pos::INTEGER AS pos, n_support, value FROM res",
    "resolver_stats": f"""WITH {_EV} SELECT slice, count(*) AS union_pixels, count(*) FILTER (WHERE n_support = 0) AS no_support, count(*) FILTER (WHERE n_support = 1) AS single, count(*) FILTER (WHERE n_support >= 2) AS contested,
  count(*) FILTER (WHERE n_support >= 2 AND value = 255) AS tied, count(*) FILTER (WHERE value <> 255) AS confirmed, count(*) FILTER (WHERE value = 255) AS ignored FROM res GROUP BY slice""",
    "rebuilt": f"""WITH {_EV}, t AS (SELECT range AS k FROM range(64)),
cov AS (SELECT DISTINCT vec_id // 4 AS slice, (least(vec_id % 4, 2) + 1)::INTEGER AS label, k AS pos FROM embeddings JOIN t ON k % 8 BETWEEN vec_id % 4 AND vec_id % 4 + 3 AND k // 8 BETWEEN vec_id % 4 AND vec_id % 4 + 4),
own AS (SELECT r.slice, r.pos, r.value FROM res r JOIN cov ON cov.slice = r.slice AND cov.pos = r.pos AND cov.label = r.value)
SELECT slice, value, count(*) AS n, sum(pos)::BIGINT AS sum_pos FROM (SELECT a.slice, a.pos, coalesce(own.value, 255) AS value FROM (SELECT DISTINCT slice, pos FROM cov) a LEFT JOIN own ON own.slice = a.slice AND own.pos = a.pos) GROUP BY slice, value""",
    "best_of_three": f"""WITH {_CAND}, s AS (SELECT *, raw_area - outside AS area, round(model_score + 0.05::DOUBLE * least(1.0::DOUBLE, (raw_area - outside) / 30.0::DOUBLE) - 0.5::DOUBLE * (outside::DOUBLE / greatest(raw_area, 1)), 6) AS score FROM cand WHERE raw_area > 0 AND raw_area - outside > 0)
SELECT inst, candidate_index, raw_area, outside, area, score FROM (SELECT *, row_number() OVER (PARTITION BY inst ORDER BY score DESC, candidate_index) AS r FROM s) WHERE r = 1""",
    "reweighted": f"""WITH {_CAND}, s AS (SELECT *, round(model_score + CASE WHEN candidate_index = 0 THEN (inst % 5 - 2.5::DOUBLE) * 1000 ELSE 0.0 END, 6) AS score FROM cand)
SELECT inst, candidate_index, score FROM (SELECT *, row_number() OVER (PARTITION BY inst ORDER BY score DESC, candidate_index) AS r FROM s) WHERE r = 1""",
    "overwritten": f"WITH {_PX}, l AS (SELECT vec_id // 4 AS slice, pos, max(vec_id % 4) + 1 AS label FROM px WHERE v > 0 GROUP BY ALL) SELECT slice, label::INTEGER AS label, count(*) AS n FROM l GROUP BY slice, label",
    "surface_distance": f"""WITH {_PX}, m AS (SELECT vec_id AS id, pos // 8 AS y, pos % 8 AS x, v > 0 AS f FROM px),
sf AS (SELECT a.id, a.y, a.x FROM m a LEFT JOIN m b ON b.id = a.id AND b.f AND abs(a.y - b.y) + abs(a.x - b.x) = 1 WHERE a.f GROUP BY a.id, a.y, a.x HAVING count(b.id) < 4),
pr AS (SELECT vec_id FROM embeddings WHERE vec_id + 1 IN (SELECT vec_id FROM embeddings)),
ab AS (SELECT pr.vec_id, 'a' AS side, p.y, p.x, coalesce(sqrt(min((p.y - q.y) ** 2 + 2.25::DOUBLE * (p.x - q.x) ** 2)), 'inf'::DOUBLE) AS dist FROM pr JOIN sf p ON p.id = pr.vec_id LEFT JOIN sf q ON q.id = pr.vec_id + 1 GROUP BY ALL
  UNION ALL SELECT pr.vec_id, 'b', p.y, p.x, coalesce(sqrt(min((p.y - q.y) ** 2 + 2.25::DOUBLE * (p.x - q.x) ** 2)), 'inf'::DOUBLE) FROM pr JOIN sf p ON p.id = pr.vec_id + 1 LEFT JOIN sf q ON q.id = pr.vec_id GROUP BY ALL),
h AS (SELECT vec_id, side, dist, row_number() OVER (PARTITION BY vec_id, side ORDER BY dist) AS r, count(*) OVER (PARTITION BY vec_id, side) AS n FROM ab),
hh AS (SELECT vec_id, max(d) AS d FROM (SELECT vec_id, side, min(dist) FILTER (WHERE r::DOUBLE / n >= 0.95::DOUBLE) AS d FROM h GROUP BY vec_id, side) GROUP BY vec_id)
SELECT vec_id, round(avg(dist) FILTER (WHERE side = 'a') + {_N}, 5) AS mean_ab, round(avg(dist) FILTER (WHERE side = 'b') + {_N}, 5) AS mean_ba,
  round(avg((dist <= 1)::INTEGER::DOUBLE) FILTER (WHERE side = 'a') + {_N}, 5) AS overlap_a, round(avg((dist <= 1)::INTEGER::DOUBLE) FILTER (WHERE side = 'b') + {_N}, 5) AS overlap_b,
  round(avg((dist <= 1)::INTEGER::DOUBLE) + {_N}, 5) AS surface_dice, round(any_value(d) + {_N}, 5) AS hausdorff FROM ab JOIN hh USING (vec_id) GROUP BY vec_id""",
    "volume_distance": f"""WITH {_PX}, full8 AS (SELECT vec_id // 8 AS vol FROM embeddings GROUP BY 1 HAVING count(*) = 8), vox AS (SELECT vec_id // 8 AS vol, vec_id % 8 AS z, pos // 8 AS y, pos % 8 AS x FROM px WHERE v > 0 AND vec_id // 8 IN (SELECT vol FROM full8)),
k AS (SELECT unnest(range(8)) AS b), cells AS (SELECT vol, z - (b // 4) AS z, y - (b // 2 % 2) AS y, x - (b % 2) AS x, sum(128 >> b) AS code FROM vox, k GROUP BY ALL), sf AS (SELECT * FROM cells WHERE code <> 255),
pr AS (SELECT vol FROM full8 WHERE vol + 1 IN (SELECT vol FROM full8)),
ab AS (SELECT pr.vol, 'a' AS side, p.z, p.y, p.x, sqrt(min(4.0::DOUBLE * (p.z - q.z) ** 2 + (p.y - q.y) ** 2 + 2.25::DOUBLE * (p.x - q.x) ** 2)) AS d FROM pr JOIN sf p ON p.vol = pr.vol JOIN sf q ON q.vol = pr.vol + 1 GROUP BY ALL
  UNION ALL SELECT pr.vol, 'b', p.z, p.y, p.x, sqrt(min(4.0::DOUBLE * (p.z - q.z) ** 2 + (p.y - q.y) ** 2 + 2.25::DOUBLE * (p.x - q.x) ** 2)) FROM pr JOIN sf p ON p.vol = pr.vol + 1 JOIN sf q ON q.vol = pr.vol GROUP BY ALL),
h AS (SELECT vol, side, d, row_number() OVER (PARTITION BY vol, side ORDER BY d) AS r, count(*) OVER (PARTITION BY vol, side) AS n FROM ab), hh AS (SELECT vol, max(d) AS hd FROM (SELECT vol, side, min(d) FILTER (WHERE r::DOUBLE / n >= 0.95::DOUBLE) AS d FROM h GROUP BY ALL) GROUP BY vol)
SELECT vol, round(avg(d) FILTER (WHERE side = 'a') + {_N}, 4) AS mean_ab, round(avg(d) FILTER (WHERE side = 'b') + {_N}, 4) AS mean_ba, round(avg((d <= 1)::INTEGER::DOUBLE) + {_N}, 4) AS surface_dice, round(any_value(hd) + {_N}, 4) AS hausdorff FROM ab JOIN hh USING (vol) GROUP BY vol""",
}
ORACLES = {f"mask_{k}": v for k, v in ORACLES.items()}
ORACLES["hard_case_ranking"] = f"""WITH {_PAIR}, s AS (SELECT label, round(CASE WHEN a + b - i = 0 THEN 0.0::DOUBLE ELSE i::DOUBLE / (a + b - i) END * 1000000)::BIGINT AS u, b = 0 AS e FROM o),
k AS (SELECT label, count(*) AS n, min(u) AS least, sum(u)::BIGINT AS total, count(*) FILTER (WHERE e) AS empties FROM s GROUP BY label)
SELECT label, n, least, total, empties, row_number() OVER (ORDER BY least, empties DESC, total::DOUBLE / n, label)::INTEGER AS place FROM k WHERE least < 300000"""
