"""Operators on candidate boxes and series of slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slicewright.functions import box as B
from slicewright.functions import mask as M
from slicewright.session import discard, materialize


def overlapping_pairs(boxes: DataFrame, image: str, key: str, threshold: float, cell: float) -> DataFrame:
    """image, a, b of pairs of boxes above ``threshold`` in overlap, a before b by score (descending), then key.

    Boxes meet in the grid cells they cover, and a pair is taken in one cell only: an equi-join, no cross join.
    """
    corner = lambda i: F.floor(F.get("box", F.lit(i)) / cell).cast("int")
    placed = boxes.select(image, key, "box", "score", F.explode(F.sequence(corner(0), corner(2))).alias("gx"), corner(0).alias("x0"), corner(1).alias("y0"), corner(3).alias("y3")).withColumn("gy", F.explode(F.sequence("y0", "y3")))
    a = placed.select(image, "gx", "gy", *(F.col(n).alias(f"a_{n}") for n in (key, "box", "score", "x0", "y0")))
    b = placed.select(image, "gx", "gy", *(F.col(n).alias(f"b_{n}") for n in (key, "box", "score", "x0", "y0")))
    pairs = a.join(b, [image, "gx", "gy"])
    first = (F.col("gx") == F.greatest("a_x0", "b_x0")) & (F.col("gy") == F.greatest("a_y0", "b_y0"))
    before = (F.col("a_score") > F.col("b_score")) | ((F.col("a_score") == F.col("b_score")) & (F.col(f"a_{key}") < F.col(f"b_{key}")))
    close = B.box_iou_open(F.col("a_box"), F.col("b_box")) > threshold
    return pairs.where(first & before & close).select(image, F.col(f"a_{key}").alias("a"), F.col(f"b_{key}").alias("b"))


def non_maximum_suppression(boxes: DataFrame, image: str, key: str, threshold: float = 0.7, cell: float = 128.0) -> DataFrame:
    """The boxes greedy suppression keeps: in descending score (then key), each unless it overlaps a kept one by more than ``threshold`` (half-open boxes).

    ``boxes``: image, key (unique in an image), box, score; null boxes or scores are left out. Greedy order is
    reached by rounds: a box all of whose better overlapping ones are decided is decided too, so no image
    is ever gathered in one task. Rounds are as many as the longest chain of overlaps.
    """
    good = boxes.where(F.col("box").isNotNull() & F.col("score").isNotNull())
    pairs = materialize(overlapping_pairs(good, image, key, threshold, cell), "pairs")
    free = good.select(image, F.col(key).alias("b")).join(pairs, [image, "b"], "left_anti")
    kept = materialize(free.select(image, F.col("b").alias("a")), "kept")
    gone = None
    open_pairs = pairs
    steps = [pairs]
    all_kept, all_gone = [kept], []
    while True:
        hit = open_pairs.join(kept, [image, "a"], "left_semi").select(image, "b").distinct()
        gone = materialize(hit, "gone")
        all_gone.append(gone)
        # pairs that still matter: neither side suppressed, and the better side not yet kept
        rest = open_pairs.join(gone, [image, "b"], "left_anti").join(gone.select(image, F.col("b").alias("a")), [image, "a"], "left_anti")
        rest = materialize(rest.join(kept, [image, "a"], "left_anti"), "pairs")
        touched = open_pairs.select(image, "b").distinct().join(gone, [image, "b"], "left_anti").join(rest.select(image, "b").distinct(), [image, "b"], "left_anti")
        kept = materialize(touched.select(image, F.col("b").alias("a")), "kept")
        steps.append(rest)
        all_kept.append(kept)
        open_pairs = rest
        if kept.isEmpty():
            break
    out = all_kept[0]
    for k in all_kept[1:]:
        out = out.unionByName(k)
    result = good.join(out.select(image, F.col("a").alias(key)), [image, key], "left_semi")
    discard(good.sparkSession, [*steps, *all_gone])
    return result


def quality_filter(candidates: DataFrame, least_iou: float, least_stability: float) -> DataFrame:
    """Candidates with a predicted overlap above and a stability of at least the limits; cheap conditions first."""
    good = candidates.where(F.col("model_score") > least_iou).withColumn("stability", M.stability(F.col("logits")))
    return good.where(F.col("stability") >= least_stability)


def nearest_marked(slices: DataFrame, series: list[str], z: str, marked: str) -> DataFrame:
    """series, z, nearest: the nearest z with ``marked`` in the series, the lower of two equally near; null if there is none.

    One window forward and one back over the distinct z of a series instead of all pairs.
    """
    once = slices.where(F.col(z).isNotNull()).groupBy(*series, z).agg(F.bool_or(marked).alias("m"))
    order = Window.partitionBy(*series).orderBy(z)
    at = F.when(F.col("m"), F.col(z))
    before = F.last(at, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first(at, ignorenulls=True).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    near = once.withColumn("b", before).withColumn("a", after)
    pick = F.when(F.col("a").isNull() | (F.col(z) - F.col("b") <= F.col("a") - F.col(z)), F.col("b")).otherwise(F.col("a"))
    return near.select(*series, z, F.coalesce(pick, "a").alias("nearest"))


def marked_pairs(slices: DataFrame, series: list[str], z: str, marked: str) -> DataFrame:
    """series, z1, z2, between: neighbouring marked slices and how many lie between them."""
    m = slices.where(F.col(marked) & F.col(z).isNotNull()).select(*series, z).distinct()
    return m.select(*series, F.col(z).alias("z1"), F.lead(z).over(Window.partitionBy(*series).orderBy(z)).alias("z2")).where("z2 is not null").withColumn("between", F.col("z2") - F.col("z1") - 1)


def start_slice(boxes: DataFrame, series: list[str], z: str, box: str) -> DataFrame:
    """series, z, area of the slice with the largest box; of equals the lowest z: where propagation starts."""
    sized = boxes.where(F.col(box).isNotNull() & F.col(z).isNotNull()).withColumn("_a", B.box_area(F.col(box)))
    best = sized.groupBy(*series).agg(F.max(F.struct("_a", (-F.col(z)).alias("_z"))).alias("m"))
    return best.select(*series, (-F.col("m._z")).alias(z), F.col("m._a").alias("area"))


def best_component(instances: DataFrame, components: DataFrame, image: str, key: list[str]) -> DataFrame:
    """key, component, how: the component of each instance: by its number, else by the largest overlap with its box (the first of equals), else the only one.

    ``instances``: image, key, component_id, box; ``components``: image, component, x1, y1, x2, y2. Boxes count as
    the whole pixels they touch. A box takes the best component even if none overlaps it; without a box only a
    single component is taken. An instance without any match has null. Components are matched within their image only.
    """
    c = components.select(image, "component", F.array(*(F.col(x).cast("double") for x in ("x1", "y1", "x2", "y2"))).alias("cbox"), F.count(F.lit(1)).over(Window.partitionBy(image)).alias("n"))
    corner = lambda i: (F.floor if i < 2 else F.ceil)(F.get("box", F.lit(i))).cast("double")
    whole = instances.withColumn("_box", F.when(F.col("box").isNotNull(), F.array(*(corner(i) for i in range(4)))))
    j = whole.join(c, image, "left").withColumn("exact", F.col("component_id") == F.col("component")).withColumn("iou", F.when(F.col("box").isNotNull(), B.box_iou(F.col("_box"), F.col("cbox"))))
    rank = F.when(F.col("component").isNull(), 3).when(F.col("exact"), 0).when(F.col("box").isNotNull(), 1).when(F.col("n") == 1, 2).otherwise(3)
    order = Window.partitionBy(image, *key).orderBy("_rank", F.desc("iou"), "component")
    top = j.withColumn("_rank", rank).withColumn("_r", F.row_number().over(order)).where("_r = 1")
    how = F.when(F.col("_rank") == 0, "exact").when(F.col("_rank") == 1, "overlap").when(F.col("_rank") == 2, "single")
    return top.select(image, *key, F.when(F.col("_rank") < 3, F.col("component")).alias("component"), how.alias("how"))
